"""Features cut to a box, with their geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.functions import polygons
from wayfold.model import GEOMETRY
from wayfold.operators import polyline


def _joined(pieces: DataFrame, key: str) -> DataFrame:
    """key, fragment, line, length from pieces (seg, ``_t.t0``, ``_t.t1``) of segments: joined where one ends and the next begins at a common vertex."""
    w = Window.partitionBy(key).orderBy("seg", "_t.t0")
    goes_on = (F.col("seg") == F.lag("seg").over(w) + 1) & (F.col("_t.t0") == 0) & (F.lag("_t.t1").over(w) == 1)
    numbered = pieces.withColumn("fragment", F.sum(F.coalesce(~goes_on, F.lit(True)).cast("int")).over(w) - 1)
    place = lambda t: F.struct((F.col("x1") + F.col(t) * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col(t) * (F.col("y2") - F.col("y1"))).alias("y"))
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * (F.col("_t.t1") - F.col("_t.t0"))
    rows = F.sort_array(F.collect_list(F.struct("seg", place("_t.t0").alias("a"), place("_t.t1").alias("b"))))
    return numbered.groupBy(key, "fragment").agg(rows.alias("_r"), F.sum(size).alias("length")).select(key, "fragment", F.concat(F.array(F.element_at("_r", 1)["a"]), F.transform("_r", lambda r: r["b"])).alias("line"), "length")


def fragments(segs: DataFrame, key: str, box: tuple[float, float, float, float]) -> DataFrame:
    """key, fragment (from 0), line, length: the stretches of each line inside the box, a row a stretch; touching it in a point gives none.

    segs: key, seg, x1, y1, x2, y2.  Segments are cut one by one and joined again where the line does not leave the box between them.
    """
    cut = g.clip(*map(F.col, ("x1", "y1", "x2", "y2")), *box)
    return _joined(segs.withColumn("_t", cut).where("_t is not null and _t.t0 < _t.t1"), key)


def outside_circle(segs: DataFrame, key: str, x: float, y: float, radius: float) -> DataFrame:
    """key, fragment, line, length: the stretches of each line outside a circle; a segment that goes through it gives two."""
    dx, dy, fx, fy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x1") - x, F.col("y1") - y
    a, b, c = dx * dx + dy * dy, 2 * (dx * fx + dy * fy), fx * fx + fy * fy - radius * radius
    under = b * b - 4 * a * c
    root = F.sqrt(F.greatest(under, F.lit(0.0)))
    low, high = (-b - root) / (2 * a), (-b + root) / (2 * a)
    piece = lambda t0, t1: F.struct(t0.alias("t0"), t1.alias("t1"))
    whole = (under <= 0) | (high <= 0) | (low >= 1)
    zero, one = F.lit(0.0), F.lit(1.0)
    cut = F.when(whole, F.array(piece(zero, one))).otherwise(F.filter(F.array(piece(zero, F.greatest(low, zero)), piece(F.least(high, one), one)), lambda p: p["t0"] < p["t1"]))
    return _joined(segs.where("x1 != x2 or y1 != y2").withColumn("_t", F.explode(cut)), key)


def clip_features(rows: DataFrame, box: tuple[float, float, float, float], geom: str = "geom") -> DataFrame:
    """The rows whose geometry meets the box, with what of it is inside; all other columns stay, and rows may repeat.

    Lines become the lines of their stretches, polygons and their holes are cut, points are kept or not.  Null and empty geometries go.
    """
    w, s, e, n = box
    row = "_row"
    while row in rows.columns:
        row += "_"
    marked = rows.withColumn(row, F.monotonically_increasing_id())
    kind = F.col(f"`{geom}`.gtype")
    polys = F.col(f"`{geom}`.polys")
    points = F.filter(F.flatten(F.flatten(polys)), lambda p: p["x"].between(w, e) & p["y"].between(s, n))
    areas = F.filter(F.transform(polys, lambda rings: polygons.clip_polygon(rings, w, s, e, n)), lambda p: p.isNotNull())
    whole = (
        F.when(kind.isin("Point", "MultiPoint"), F.when(F.size(points) > 0, F.struct(kind.alias("gtype"), F.array(F.array(points)).alias("polys"))))
        .when(kind.isin("Polygon", "MultiPolygon"), F.when(F.size(areas) > 0, F.struct(F.when(F.size(areas) > 1, "MultiPolygon").otherwise("Polygon").alias("gtype"), areas.alias("polys"))))
        .cast(GEOMETRY)
    )
    lined = kind.isin("LineString", "MultiLineString")
    others = marked.where(~lined).withColumn(geom, whole).where(F.col(f"`{geom}`").isNotNull())
    parts = marked.where(lined).select(row, F.posexplode(F.element_at(polys, 1)).alias("part", "line")).select(F.struct(row, "part").alias("k"), "line")
    found = fragments(polyline.line_segments(parts, "k"), "k", box)
    joined = found.groupBy(F.col(f"k.{row}").alias(row)).agg(F.transform(F.sort_array(F.collect_list(F.struct("k.part", "fragment", "line"))), lambda r: r["line"]).alias("_lines"))
    shape = F.struct(F.when(F.size("_lines") > 1, "MultiLineString").otherwise("LineString").alias("gtype"), F.array("_lines").alias("polys")).cast(GEOMETRY)
    lines = marked.where(lined).join(joined, row).withColumn(geom, shape).drop("_lines")
    return others.select(*[F.col(f"`{c}`") for c in marked.columns]).unionByName(lines.select(*[F.col(f"`{c}`") for c in marked.columns])).drop(row)
