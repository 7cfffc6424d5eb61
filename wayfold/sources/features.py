"""Feature scans: GeoJSON and Overpass documents to rows, and rows back to GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.functions import text as t
from wayfold.model import GEOMETRY, LINE

DEPTH = {"Point": 1, "LineString": 2, "MultiPoint": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}
NO_LINE = f"cast(array() as {LINE})"


def _parsed(text: Column, depth: int) -> Column:
    return F.from_json(text, "array<" * depth + "double" + ">" * depth)


def _point(p: Column) -> Column:
    return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))


def _line(points: Column) -> Column:
    return F.transform(points, _point)


def geometry(json: Column) -> Column:
    """A geometry struct from GeoJSON text; each depth of coordinates is parsed by its own schema, none is inferred."""
    kind, raw = F.get_json_object(json, "$.type"), F.get_json_object(json, "$.coordinates")
    lines = lambda d: F.transform(d, _line)
    polys = (
        F.when(kind == "Point", F.array(F.array(F.array(_point(_parsed(raw, 1))))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(F.array(_line(_parsed(raw, 2)))))
        .when(kind == "Polygon", F.array(lines(_parsed(raw, 3))))
        .when(kind == "MultiLineString", F.array(lines(_parsed(raw, 3))))
        .when(kind == "MultiPolygon", F.transform(_parsed(raw, 4), lines))
    )
    return F.when(polys.isNotNull(), F.struct(kind.alias("gtype"), polys.alias("polys")).cast(GEOMETRY))


def geometry_json(geom: Column) -> Column:
    """GeoJSON text of a geometry struct."""
    pair = lambda p: F.array(p["x"], p["y"])
    line = lambda ps: F.transform(ps, pair)
    lines = lambda ls: F.transform(ls, line)
    first = F.element_at(geom["polys"], 1)
    write = lambda c: F.to_json(F.struct(geom["gtype"].alias("type"), c.alias("coordinates")))
    return (
        F.when(geom["gtype"] == "Point", write(pair(F.element_at(F.element_at(first, 1), 1))))
        .when(geom["gtype"].isin("LineString", "MultiPoint"), write(line(F.element_at(first, 1))))
        .when(geom["gtype"].isin("Polygon", "MultiLineString"), write(lines(first)))
        .when(geom["gtype"] == "MultiPolygon", write(F.transform(geom["polys"], lines)))
    )


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom["polys"]))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, properties, geom, ord, crs of each feature of FeatureCollections; the legacy CRS name, else EPSG:4326.

    A document is one record of the scan; large collections should be kept as one feature a line (``read_geojson_lines``).
    """
    schema = "features array<struct<id: string, properties: map<string, string>, geometry: string>>, crs struct<properties: struct<name: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    flat = rows.select(F.coalesce("crs.properties.name", F.lit("EPSG:4326")).alias("crs"), F.posexplode("features").alias("ord", "f"))
    return flat.select("f.id", F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("properties"), geometry(F.col("f.geometry")).alias("geom"), F.col("ord").cast("long").alias("ord"), "crs")


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_geojson for one feature a line, which splits over any number of tasks; order is not kept."""
    rows = spark.read.schema("id string, properties map<string, string>, geometry string").json(path)
    return rows.select("id", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"), geometry(F.col("geometry")).alias("geom"))


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Elements as features: nodes are points, closed ways of more than three points polygons, other ways lines, relations lines of their members (null without any)."""
    at = "struct<lat: double, lon: double>"
    schema = f"elements array<struct<type: string, id: long, lat: double, lon: double, tags: map<string, string>, geometry: array<{at}>, members: array<struct<type: string, ref: long, role: string, geometry: array<{at}>>>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("elements").alias("ord", "e")).select("ord", "e.*")
    line = lambda ps: F.transform(ps, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    own = line(F.col("geometry"))
    ring = (F.size("geometry") > 3) & F.element_at("geometry", 1).eqNullSafe(F.element_at("geometry", -1))
    parts = F.transform(F.filter("members", lambda m: F.size(m["geometry"]) > 1), lambda m: line(m["geometry"]))
    build = lambda kind, polys: F.struct(kind.alias("gtype"), polys.alias("polys")).cast(GEOMETRY)
    geom = (
        F.when((F.col("type") == "node") & F.col("lon").isNotNull(), build(F.lit("Point"), F.array(F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))))))
        .when((F.col("type") == "way") & (F.size("geometry") > 1), build(F.when(ring, "Polygon").otherwise("LineString"), F.array(F.array(own))))
        .when((F.col("type") == "relation") & (F.size(parts) > 0), build(F.lit("MultiLineString"), F.array(parts)))
    )
    members = F.transform(F.col("members"), lambda m: F.struct(m["type"].alias("type"), m["ref"].cast("string").alias("ref"), m["role"].alias("role")))
    return e.select(F.concat("type", F.lit("/"), "id").alias("id"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("properties"), geom.alias("geom"), F.col("ord").cast("long").alias("ord"), F.col("type").alias("element_type"), F.col("id").cast("string").alias("element_id"), members.alias("members")).where(F.col("geom").isNotNull() | (F.col("element_type") == "relation"))


def expand_other_tags(rows: DataFrame, properties: str = "properties", other: str = "other_tags") -> DataFrame:
    """Key-value text among the properties as properties of its own; existing ones win."""
    parsed = F.coalesce(t.hstore(F.col(properties)[other]), F.create_map().cast("map<string,string>"))
    have = F.map_filter(F.col(properties), lambda k, v: k != other)
    return rows.withColumn(properties, F.map_concat(F.map_filter(parsed, lambda k, v: ~F.array_contains(F.map_keys(have), k)), have))


def geojson_lines(rows: DataFrame) -> DataFrame:
    """One GeoJSON feature a row, as text, for ``write.text``."""
    return rows.select(F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(',"properties":'), F.to_json("properties"), F.lit(',"geometry":'), F.coalesce(geometry_json(F.col("geom")), F.lit("null")), F.lit("}")).alias("value"))


def merge_by_identity(older: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """Both, where a row of the newer replaces the older one of its key."""
    return older.join(newer.select(*keys).distinct(), keys, "left_anti").unionByName(newer, allowMissingColumns=True)


def meeting_box(rows: DataFrame, box: tuple[float, float, float, float], geom: str = "geom") -> tuple[DataFrame, DataFrame]:
    """The features whose bounds meet a box, whole; and a row with n_total, n_without_geometry, n_without_bounds (geometries without a vertex), n_kept."""
    b = g.bounds(vertices(F.col(f"`{geom}`")))
    w, s, e, n = box
    inside = F.coalesce((b["w"] <= e) & (b["e"] >= w) & (b["s"] <= n) & (b["n"] >= s), F.lit(False))
    none = F.col(f"`{geom}`").isNull()
    counts = rows.agg(F.count("*").alias("n_total"), F.count_if(none).alias("n_without_geometry"), F.count_if(~none & b.isNull()).alias("n_without_bounds"), F.count_if(inside).alias("n_kept"))
    return rows.where(inside), counts
