"""Polygons as Column builders over arrays of rings, each an array of (x, y) structs: clipping to a box and a point inside for a label."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.model import LINE

#: Heights of a label's scanlines, as shares of the outer ring's: fixed values, the first of equals wins.
HEIGHTS = (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What the body makes of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _half_plane(ring: Column, value: Callable[[Column], Column], bound: float, below: bool) -> Column:
    """An open ring cut at a line parallel to an axis: vertices on the kept side, and the places where its edges cross."""
    none = F.expr(f"cast(array() as {LINE})")
    inside = lambda p: value(p) <= bound if below else value(p) >= bound
    before = lambda ring: F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))

    def step(p: Column, q: Column) -> Column:
        t = (F.lit(bound) - value(p)) / (value(q) - value(p))
        crossing = g.vertex(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t)
        return F.concat(F.when(inside(p) != inside(q), F.array(crossing)).otherwise(none), F.when(inside(q), F.array(g.vertex(q["x"], q["y"]))).otherwise(none))

    return let(ring, lambda r: F.when(F.size(r) > 0, F.flatten(F.zip_with(before(r), r, step))).otherwise(none))


def opened(ring: Column) -> Column:
    """The ring without its last vertex where that repeats the first."""
    n = F.size(ring)
    return F.when((n > 1) & F.element_at(ring, 1).eqNullSafe(F.element_at(ring, -1)), F.slice(ring, 1, n - 1)).otherwise(ring)


def clip_ring(ring: Column, w: float | None = None, s: float | None = None, e: float | None = None, n: float | None = None) -> Column:
    """The closed ring inside a box, an open side having no bound; empty where fewer than three vertices are left.

    Sutherland and Hodgman's passes, one a side.  A concave ring that the box cuts apart stays one ring, joined along the side; its area is right.
    """
    x, y = (lambda p: p["x"]), (lambda p: p["y"])
    sides = [(value, bound, below) for value, bound, below in ((x, w, False), (x, e, True), (y, s, False), (y, n, True)) if bound is not None]
    cut = reduce(lambda r, side: _half_plane(r, *side), sides, opened(ring))
    return let(cut, lambda r: F.when(F.size(r) > 2, F.concat(r, F.slice(r, 1, 1))).otherwise(F.expr(f"cast(array() as {LINE})")))


def clip_polygon(rings: Column, w: float | None = None, s: float | None = None, e: float | None = None, n: float | None = None) -> Column:
    """The rings of a polygon inside a box; holes that lie outside go, and without an outer ring the polygon is null."""
    return let(F.transform(rings, lambda r: clip_ring(r, w, s, e, n)), lambda cut: F.when(F.size(F.get(cut, F.lit(0))) > 0, F.filter(cut, lambda r: F.size(r) > 0)))


def interior_point(rings: Column) -> Column:
    """A point for a polygon's label: the mean of the outer ring's vertices if it is inside, else the middle of the widest stretch inside on one of
    seven scanlines, else the first vertex.  Null without vertices.
    """
    none = F.expr("cast(null as struct<width: double, x: double, y: double>)")
    inside = lambda p: g.point_in_polygon(p["x"], p["y"], rings)

    def spans(level: Column) -> Column:
        """Stretches between crossings of a scanline whose middle is inside, from left to right."""
        crossing = lambda p: p["a"]["x"] + (level - p["a"]["y"]) * (p["b"]["x"] - p["a"]["x"]) / (p["b"]["y"] - p["a"]["y"])
        across = F.array_sort(F.flatten(F.transform(rings, lambda r: F.transform(F.filter(g._pairs(g.closed(r)), lambda p: (p["a"]["y"] > level) != (p["b"]["y"] > level)), crossing))))
        many = lambda c: F.greatest(F.size(c) - 1, F.lit(0))
        pairs = let(across, lambda c: F.zip_with(F.slice(c, 1, many(c)), F.slice(c, 2, many(c)), lambda a, b: F.struct((b - a).alias("width"), ((a + b) / 2).alias("x"), level.alias("y"))))
        return F.filter(pairs, inside)

    outer = F.get(rings, F.lit(0))
    y = F.transform(outer, lambda p: p["y"])
    levels = let(F.struct(F.array_min(y).alias("low"), F.array_max(y).alias("high")), lambda b: F.array(*[b["low"] + (b["high"] - b["low"]) * h for h in HEIGHTS]))
    best = F.aggregate(F.flatten(F.transform(levels, spans)), none, lambda have, c: F.when(have.isNull() | (c["width"] > have["width"]), c).otherwise(have))
    widest = let(best, lambda b: F.when(b.isNotNull(), g.vertex(b["x"], b["y"])).otherwise(F.get(outer, F.lit(0))))
    return F.when(F.size(outer) > 0, let(g.mean_vertex(outer), lambda m: F.when(inside(m), m).otherwise(widest)))
