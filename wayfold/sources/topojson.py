"""TopoJSON: shared, delta-coded arcs to polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.model import GEOMETRY

_SCHEMA = "transform struct<scale: array<double>, translate: array<double>>, arcs array<array<array<double>>>, objects map<string, string>"


def _decoded(arc: Column, scale: Column, shift: Column) -> Column:
    """Running sums of the deltas, scaled and shifted, if the document is quantised; else the points as they are."""
    start = F.expr("named_struct('x', 0D, 'y', 0D, 'line', cast(array() as array<struct<x: double, y: double>>))")
    step = lambda s, d: F.struct((s["x"] + d[0]).alias("x"), (s["y"] + d[1]).alias("y"), F.concat(s["line"], F.array(F.struct(((s["x"] + d[0]) * scale[0] + shift[0]).alias("x"), ((s["y"] + d[1]) * scale[1] + shift[1]).alias("y")))).alias("line"))
    plain = F.transform(arc, lambda d: F.struct(d[0].alias("x"), d[1].alias("y")))
    return F.when(scale.isNull(), plain).otherwise(F.aggregate(arc, start, step, lambda s: s["line"]))


def read_topojson(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """id, properties, geom of the geometries of one object: the named one, else ``city``, else the only one.

    Arcs are rows of their own and meet the references by an equi-join; a reference below 0 is its complement's arc
    backwards.  Where arcs meet, the joint vertex is kept once; rings are closed.
    """
    doc = spark.read.schema(_SCHEMA).option("multiLine", True).json(path).withColumn("doc", F.input_file_name())
    arcs = doc.select("doc", "transform", F.posexplode("arcs").alias("arc", "d")).select("doc", F.col("arc").cast("long").alias("arc"), _decoded(F.col("d"), F.col("transform.scale"), F.col("transform.translate")).alias("line"))
    keys = F.map_keys("objects")
    pick = F.lit(name) if name else F.when(F.array_contains(keys, "city"), F.lit("city")).otherwise(F.when(F.size(keys) == 1, F.element_at(keys, 1)))
    chosen = doc.select("doc", F.element_at("objects", pick).alias("object"))
    shapes = chosen.select("doc", F.posexplode(F.from_json(F.get_json_object("object", "$.geometries"), "array<string>")).alias("ord", "g"))
    kind = F.get_json_object("g", "$.type")
    raw = F.get_json_object("g", "$.arcs")
    polys = F.when(kind == "Polygon", F.array(F.from_json(raw, "array<array<bigint>>"))).when(kind == "MultiPolygon", F.from_json(raw, "array<array<array<bigint>>>"))
    flat = (
        shapes.select("doc", "ord", kind.alias("gtype"), F.get_json_object("g", "$.id").alias("id"), F.from_json(F.get_json_object("g", "$.properties"), "map<string, string>").alias("properties"), polys.alias("polys"))
        .where("polys is not null")
        .select("*", F.posexplode("polys").alias("poly", "rings"))
        .select("*", F.posexplode("rings").alias("ring", "refs"))
        .select("doc", "ord", "gtype", "id", "properties", "poly", "ring", F.posexplode("refs").alias("pos", "ref"))
        .withColumn("arc", F.when(F.col("ref") < 0, F.expr("~ref")).otherwise(F.col("ref")))
    )
    line = F.when(F.col("ref") < 0, F.reverse("line")).otherwise(F.col("line"))
    parts = flat.join(arcs, ["doc", "arc"]).withColumn("line", line)
    by = ["doc", "ord", "gtype", "id"]
    joined = F.aggregate(
        F.sort_array(F.collect_list(F.struct("pos", "line"))),
        F.expr("cast(array() as array<struct<x: double, y: double>>)"),
        lambda out, p: F.concat(out, F.when((F.size(out) > 0) & F.try_element_at(out, F.lit(-1)).eqNullSafe(F.try_element_at(p["line"], F.lit(1))), F.slice(p["line"], 2, F.greatest(F.size(p["line"]) - 1, F.lit(0)))).otherwise(p["line"])),
    )
    rings = parts.groupBy(*by, "poly", "ring").agg(joined.alias("line"), F.first("properties").alias("properties"))
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    rings = rings.withColumn("line", F.when(~first.eqNullSafe(last), F.concat("line", F.array(first))).otherwise(F.col("line")))
    polys_ = rings.groupBy(*by, "poly").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "line"))), lambda r: r["line"]).alias("rings"), F.first("properties").alias("properties"))
    whole = polys_.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("poly", "rings"))), lambda p: p["rings"]).alias("polys"), F.first("properties").alias("properties"))
    return whole.select("id", "properties", F.struct("gtype", "polys").cast(GEOMETRY).alias("geom"), F.col("ord").cast("long").alias("ord"))
