"""Union of polygons of any shape: edges are cut where they meet, what lies inside another polygon goes, and the rest is linked to rings.

Edges meet through grid cells, so the search is an equi-join; an edge that several polygons share is compared once.  Whether a piece lies inside
another polygon is asked only of polygons whose box holds its middle, found by cells of the polygons' own size.  Nothing but the linking of a
key's outline is done in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators import grid
from wayfold.operators.components import cut
from wayfold.operators.dissolve import linked


def directed_edges(polygons: DataFrame, key: str, rings: str) -> DataFrame:
    """key, poly, ax, ay, bx, by: the edges with their polygon on the left, whichever way its rings run.  The first ring is the outer one."""
    flat = polygons.select(key, "poly", F.posexplode(rings).alias("ring", "line")).withColumn("line", g.closed(F.col("line")))
    right_way = (g.signed_area(F.col("line")) >= 0) == (F.col("ring") == 0)
    turned = flat.withColumn("line", F.when(right_way, F.col("line")).otherwise(F.reverse("line")))
    return turned.select(key, "poly", F.explode(g._pairs(F.col("line"))).alias("e")).select(key, "poly", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by")).where("ax != bx or ay != by")


def _undirected(edges: DataFrame, key: str) -> DataFrame:
    """key, poly, lx, ly, hx, hy and whether the edge runs from the lower end to the higher."""
    up = F.struct("ax", "ay") < F.struct("bx", "by")
    pick = lambda one, two: F.when(F.col("up"), F.col(one)).otherwise(F.col(two))
    return edges.withColumn("up", up).select(key, "poly", "up", pick("ax", "bx").alias("lx"), pick("ay", "by").alias("ly"), pick("bx", "ax").alias("hx"), pick("by", "ay").alias("hy"))


def _on(x: Column, y: Column, e: Column, snap: float) -> Column:
    """Whether a point lies on an edge but at neither end."""
    end = ((x == e["lx"]) & (y == e["ly"])) | ((x == e["hx"]) & (y == e["hy"]))
    return ~end & (g.point_segment(x, y, e["lx"], e["ly"], e["hx"], e["hy"]) <= snap)


def cuts(edges: DataFrame, key: str, snap: float, size: float) -> DataFrame:
    """key, lx, ly, hx, hy and px, py: where an edge is cut by an end of another edge of its key on it, or by a crossing.

    A crossing is worked out from the two edges in a fixed order, so both get the same point.
    """
    ends = ["lx", "ly", "hx", "hy"]
    put = grid.along(edges.select(key, *ends), snap, size, tuple(ends))
    one = put.select(key, "_cx", "_cy", F.struct(*ends).alias("u"))
    two = put.select(key, "_cx", "_cy", F.struct(*ends).alias("v"))
    pairs = one.join(two, [key, "_cx", "_cy"]).where("u < v").select(key, "u", "v")
    u, v = F.col("u"), F.col("v")
    none = F.expr("cast(array() as array<struct<e: struct<lx: double, ly: double, hx: double, hy: double>, x: double, y: double>>)")
    spot = lambda e, x, y: F.struct(e.alias("e"), x.alias("x"), y.alias("y"))
    touch = [F.when(_on(p[f"{c}x"], p[f"{c}y"], e, snap), F.array(spot(e, p[f"{c}x"], p[f"{c}y"]))).otherwise(none) for e, p in ((u, v), (v, u)) for c in "lh"]
    corners = lambda e: tuple(e[c] for c in ends)
    dx1, dy1, dx2, dy2 = u["hx"] - u["lx"], u["hy"] - u["ly"], v["hx"] - v["lx"], v["hy"] - v["ly"]
    det = dx1 * dy2 - dy1 * dx2
    t = ((v["lx"] - u["lx"]) * dy2 - (v["ly"] - u["ly"]) * dx2) / F.when(det == 0, F.lit(1.0)).otherwise(det)
    x, y = u["lx"] + t * dx1, u["ly"] + t * dy1
    touched = F.concat(*touch)
    crossing = F.when((F.size(touched) == 0) & (det != 0) & g.segments_cross(corners(u), corners(v)), F.array(spot(u, x, y), spot(v, x, y))).otherwise(none)
    return pairs.select(key, F.explode(F.concat(touched, crossing)).alias("c")).select(key, "c.e.*", F.col("c.x").alias("px"), F.col("c.y").alias("py")).distinct()


def pieces(edges: DataFrame, key: str, snap: float, size: float) -> DataFrame:
    """key, lx, ly, hx, hy, ups, downs, polys: the cut edges, each once, with how often they run up and down and the polygons that they are edges of."""
    names = ["lx", "ly", "hx", "hy"]
    flat = cut(_undirected(edges, key).groupBy(key, *names).agg(F.count_if("up").alias("ups"), F.count_if(~F.col("up")).alias("downs"), F.collect_set("poly").alias("polys")))
    found = cuts(flat, key, snap, size)
    far = lambda x, y: F.hypot(F.col(x) - F.col("lx"), F.col(y) - F.col("ly"))
    spots = found.groupBy(key, *names).agg(F.array_sort(F.collect_set(F.struct(far("px", "py").alias("d"), F.col("px").alias("x"), F.col("py").alias("y")))).alias("spots"))
    joined = flat.join(spots, [key, *names], "left")
    inner = F.coalesce(F.transform("spots", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))), F.expr("cast(array() as array<struct<x: double, y: double>>)"))
    whole = F.concat(F.array(F.struct(F.col("lx").alias("x"), F.col("ly").alias("y"))), inner, F.array(F.struct(F.col("hx").alias("x"), F.col("hy").alias("y"))))
    each = joined.withColumn("e", F.explode(g._pairs(whole))).where("e.a != e.b")
    forward = F.struct("e.a.x", "e.a.y") < F.struct("e.b.x", "e.b.y")  # rounding can turn a piece of no length to speak of
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    turned = each.select(key, pick("e.a.x", "e.b.x").alias("lx"), pick("e.a.y", "e.b.y").alias("ly"), pick("e.b.x", "e.a.x").alias("hx"), pick("e.b.y", "e.a.y").alias("hy"), pick("ups", "downs").alias("ups"), pick("downs", "ups").alias("downs"), "polys")
    return turned.groupBy(key, *names).agg(F.sum("ups").alias("ups"), F.sum("downs").alias("downs"), F.array_distinct(F.flatten(F.collect_list("polys"))).alias("polys"))


def covered(points: DataFrame, polygons: DataFrame, key: str, rings: str, ids: list[str]) -> DataFrame:
    """key and ids of the points (x, y, polys) that lie inside a polygon of their key which is not among their own.

    A polygon goes to the few cells of its own size that its box meets, a point to its cell of each size that the key's polygons have.
    """
    box = g.bounds(F.get(rings, F.lit(0)))
    sized = polygons.withColumn("box", box).withColumn("level", F.ceil(F.log2(F.greatest(F.col("box.e") - F.col("box.w"), F.col("box.n") - F.col("box.s"), F.lit(1e-300)))).cast("int"))
    step = F.pow(F.lit(2.0), F.col("level"))
    at = lambda v: F.floor(v / step).cast("long")
    put = sized.withColumn("cx", F.explode(F.sequence(at(F.col("box.w")), at(F.col("box.e"))))).withColumn("cy", F.explode(F.sequence(at(F.col("box.s")), at(F.col("box.n"))))).select(key, "level", "cx", "cy", "poly", "box", F.col(rings).alias("_rings"))
    levels = sized.select(key, "level").distinct()
    here = points.join(levels, key).withColumn("cx", at(F.col("x"))).withColumn("cy", at(F.col("y")))
    inside = (F.col("x") >= F.col("box.w")) & (F.col("x") <= F.col("box.e")) & (F.col("y") >= F.col("box.s")) & (F.col("y") <= F.col("box.n")) & ~F.array_contains("polys", F.col("poly"))
    return here.join(put, [key, "level", "cx", "cy"]).where(inside).where(g.point_in_polygon(F.col("x"), F.col("y"), F.col("_rings"))).select(key, *ids).distinct()


def outline(polygons: DataFrame, key: str, rings: str = "rings", snap: float = 1e-9, size: float | None = None) -> DataFrame:
    """key, ax, ay, bx, by: the directed outline of each key's union, its inside on the left.

    A piece is outline if polygons lie on one side of it only: its edges all run one way, and no other polygon holds it.
    """
    known = cut(polygons.select(key, F.xxhash64(rings).alias("poly"), F.col(rings).alias("rings")).where(F.size(F.get("rings", F.lit(0))) > 2).distinct())
    edges = cut(directed_edges(known, key, "rings"))
    if size is None:  # a cell as wide as edges are on the average
        found = edges.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0]
        size = found or 1.0
    one_way = cut(pieces(edges, key, snap, size).where((F.col("ups") == 0) | (F.col("downs") == 0)))
    names = ["lx", "ly", "hx", "hy"]
    middle = one_way.withColumn("x", (F.col("lx") + F.col("hx")) / 2).withColumn("y", (F.col("ly") + F.col("hy")) / 2)
    left = one_way.join(covered(middle, known, key, "rings", names), [key, *names], "left_anti")
    up = F.col("ups") > 0
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return left.select(key, pick("lx", "hx").alias("ax"), pick("ly", "hy").alias("ay"), pick("hx", "lx").alias("bx"), pick("hy", "ly").alias("by"))


def union(polygons: DataFrame, key: str, rings: str = "rings", snap: float = 1e-9, size: float | None = None) -> DataFrame:
    """key, rings, n_rings, area: the union of each key's polygons, overlapping or not; outer rings run with their inside on the left, holes too.

    Polygons with an outer ring of fewer than three vertices, null rings included, are left out; one given twice counts once.
    """
    return linked(outline(polygons, key, rings, snap, size), key, left=True)
