"""Closed-form geometry as Column builders over arrays of (x, y) structs; all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _pairs(line: Column) -> Column:
    """Consecutive vertices, as structs a and b; none for fewer than two."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.expr("cast(array() as array<struct<a: struct<x: double, y: double>, b: struct<x: double, y: double>>>)"))


def _sum(values: Column, of) -> Column:  # noqa: ANN001
    return F.aggregate(values, F.lit(0.0), lambda total, p: total + of(p))


def length(line: Column) -> Column:
    """Planar length of a polyline; 0 for fewer than two vertices."""
    return _sum(_pairs(line), lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def great_circle_km(line: Column) -> Column:
    return _sum(_pairs(line), lambda p: haversine_km(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))


def _cross(p: Column) -> Column:
    return p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]


def closed(ring: Column) -> Column:
    """The ring with its first vertex repeated at the end, unless it is."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    return F.when((F.size(ring) > 0) & ~(first.eqNullSafe(last)), F.concat(ring, F.array(first))).otherwise(ring)


def signed_area(ring: Column) -> Column:
    return _sum(_pairs(closed(ring)), _cross) / 2


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring less that of the holes."""
    return F.abs(signed_area(F.element_at(rings, 1))) - F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda t, r: t + F.abs(signed_area(r)))


def mean_vertex(line: Column) -> Column:
    n = F.size(line)
    return vertex(_sum(line, lambda p: p["x"]) / n, _sum(line, lambda p: p["y"]) / n)


def ring_centroid(ring: Column) -> Column:
    """Area centroid of a ring; the mean of its vertices if the area is 0."""
    ring = closed(ring)
    area = signed_area(ring)
    x = _sum(_pairs(ring), lambda p: (p["a"]["x"] + p["b"]["x"]) * _cross(p)) / (6 * area)
    y = _sum(_pairs(ring), lambda p: (p["a"]["y"] + p["b"]["y"]) * _cross(p)) / (6 * area)
    return F.when(area == 0, mean_vertex(ring)).otherwise(vertex(x, y))


def bounds(line: Column) -> Column:
    """West, south, east, north; null without vertices."""
    x, y = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.when(F.size(line) > 0, F.struct(F.array_min(x).alias("w"), F.array_min(y).alias("s"), F.array_max(x).alias("e"), F.array_max(y).alias("n")))


def bbox_overlaps(a: Column, b: Column) -> Column:
    """Closed boxes that share a point."""
    return ~((a["e"] < b["w"]) | (b["e"] < a["w"]) | (a["n"] < b["s"]) | (b["n"] < a["s"]))


def bbox_covers(a: Column, b: Column, slack: float = 1e-7) -> Column:
    return (a["w"] <= b["w"] + slack) & (a["s"] <= b["s"] + slack) & (a["e"] >= b["e"] - slack) & (a["n"] >= b["n"] - slack)


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule with the half-open crossing test."""
    hits = F.filter(
        _pairs(closed(ring)),
        lambda p: ((p["a"]["y"] > y) != (p["b"]["y"] > y)) & (x < (p["b"]["x"] - p["a"]["x"]) * (y - p["a"]["y"]) / (p["b"]["y"] - p["a"]["y"]) + p["a"]["x"]),
    )
    return F.size(hits) % 2 == 1


def point_in_polygon(x: Column, y: Column, rings: Column) -> Column:
    outer = point_in_ring(x, y, F.element_at(rings, 1))
    return outer & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: point_in_ring(x, y, r))


def along(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where on a segment the nearest point to (x, y) is, from 0 to 1."""
    dx, dy = x2 - x1, y2 - y1
    whole = dx * dx + dy * dy
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / F.when(whole == 0, F.lit(1.0)).otherwise(whole))))


def point_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment."""
    t = along(x, y, x1, y1, x2, y2)
    return F.hypot(x - (x1 + t * (x2 - x1)), y - (y1 + t * (y2 - y1)))


def point_line(x: Column, y: Column, line: Column) -> Column:
    """Distance of a point to a polyline."""
    return F.array_min(F.transform(_pairs(line), lambda p: point_segment(x, y, p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"])))


def hausdorff(a: Column, b: Column) -> Column:
    """Largest distance of a vertex of either polyline to the other one."""
    there, back = F.transform(a, lambda p: point_line(p["x"], p["y"], b)), F.transform(b, lambda p: point_line(p["x"], p["y"], a))
    return F.greatest(F.array_max(there), F.array_max(back))


def turn(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    """Directed angle between two vectors, 0 to 180 degrees; 180 if one is 0."""
    whole = F.hypot(dx1, dy1) * F.hypot(dx2, dy2)
    ratio = (dx1 * dx2 + dy1 * dy2) / F.when(whole == 0, F.lit(1.0)).otherwise(whole)
    return F.when(whole == 0, F.lit(180.0)).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))))


def undirected_angle(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    """Angle between two lines, 0 to 90 degrees; 90 if one has no direction."""
    whole = F.hypot(dx1, dy1) * F.hypot(dx2, dy2)
    ratio = F.abs(dx1 * dx2 + dy1 * dy2) / F.when(whole == 0, F.lit(1.0)).otherwise(whole)
    return F.when(whole == 0, F.lit(90.0)).otherwise(F.degrees(F.acos(F.least(F.lit(1.0), ratio))))


def clip(x1: Column, y1: Column, x2: Column, y2: Column, w: float, s: float, e: float, n: float) -> Column:
    """Entry and exit of a segment through a box as t0 and t1 (Liang-Barsky); null if it stays outside, t0 = t1 where it touches."""
    lows, highs, misses = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for d, inside in ((x2 - x1, x1 - w), (x1 - x2, e - x1), (y2 - y1, y1 - s), (y1 - y2, n - y1)):
        lows.append(F.when(d > 0, -inside / d))  # greatest and least leave nulls out
        highs.append(F.when(d < 0, -inside / d))
        misses = misses | ((d == 0) & (inside < 0))
    low, high = F.greatest(*lows), F.least(*highs)
    return F.when(~misses & (low <= high), F.struct(low.alias("t0"), high.alias("t1")))


def segments_cross(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross in their insides; touching ends have distance 0 anyway."""
    side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    return (side(a, b[0], b[1]) * side(a, b[2], b[3]) < 0) & (side(b, a[0], a[1]) * side(b, a[2], a[3]) < 0)


def segment_segment(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Distance of two segments: 0 where they cross, else the least of an end to the other segment."""
    ends = [point_segment(a[0], a[1], *b), point_segment(a[2], a[3], *b), point_segment(b[0], b[1], *a), point_segment(b[2], b[3], *a)]
    return F.when(segments_cross(a, b), F.lit(0.0)).otherwise(F.least(*ends))


def mercator_to_wgs84(x: Column, y: Column) -> Column:
    """Spherical web mercator metres to degrees."""
    radius = 6378137.0
    return F.struct(F.degrees(x / radius).alias("lon"), F.degrees(2 * F.atan(F.exp(y / radius)) - F.lit(3.141592653589793) / 2).alias("lat"))


def rounded(value: Column, places: int) -> Column:
    """As ``round`` for doubles, without a decimal a row: a whole number over a power of ten is the double nearest to it.

    Values so near the middle of two steps that their product could be on the wrong side of it, and those from 2**31 steps on, are left to ``round``.
    """
    scale = F.lit(10.0**places)
    steps = value * scale
    plain = (F.abs(steps) < 2.0**31) & (F.abs(steps - F.floor(steps) - 0.5) > 1e-5)
    return F.when(plain, F.floor(steps + 0.5) / scale).otherwise(F.round(value, places))
