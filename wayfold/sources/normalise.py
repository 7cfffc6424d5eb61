"""Features of historical roads, posts and jurisdictions in the fields of the data model; what is unsound is an error when the result is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import routes
from wayfold.operators import relations
from wayfold.sources.features import geometry_json

# Fixed values of the data model: fields of the sources for each field, the first with a value wins.
ALIASES = {
    "municipalityName": ("municipalityName", "city_name", "cityName", "name", "N03_004"),
    "parentJurisdictionName": ("parentJurisdictionName", "parent_name", "districtName", "N03_003"),
    "prefectureName": ("prefectureName", "pref_name", "prefecture", "N03_001"),
    "administrativeCode": ("administrativeCode", "city_code", "code", "N03_007"),
    "sourceResourceId": ("sourceResourceId", "resource_id", "geoshapeId", "id"),
}
LEVELS = ("N03_005", "N03_004", "N03_003")


def _first(properties: Column, names: tuple[str, ...]) -> Column:
    """The first value that is not empty, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.coalesce(*[F.nullif(properties[n], F.lit("")) for n in names])), F.lit(""))


def _fail(message: Column) -> Column:
    return F.raise_error(message).cast("string")


def roads(rows: DataFrame) -> DataFrame:
    """id, route_id, name, alt_name, start, end, original (JSON) and geom of the lines among the features; no route id is an error."""
    p = F.col("properties")
    lines = rows.where(F.col("geom.gtype").isin("LineString", "MultiLineString"))
    return lines.select("id", routes.route_id(p).alias("route_id"), _first(p, ("name", "Name", "name_ja", "road_name", "ROAD_NAME", "路線名", "街道名", "名称", "宿場名")).alias("name"), p["alt_name"].alias("alt_name"), p["start"].alias("start"), p["end"].alias("end"), F.to_json(p).alias("original"), "geom")


def posts(rows: DataFrame) -> DataFrame:
    """post_id, route_id, name, label, place_id, original (JSON) and geom of the points, one a post; posts that disagree about an id are an error."""
    p = F.col("properties")
    found = rows.where(F.col("geom.gtype") == "Point").select(
        F.coalesce(F.nullif(p["id"], F.lit("")), _fail(F.lit("a post has no id"))).alias("post_id"),
        routes.route_id(p).alias("route_id"),
        p["name"].alias("name"),
        p["jk"].alias("label"),
        p["jk_id"].alias("place_id"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(p)))).alias("original"),
        "geom",
    )
    bad = relations.conflicts(found.withColumn("shape", geometry_json(F.col("geom"))), ["post_id"], ["original", "shape"]).select("post_id", F.lit(True).alias("_bad"))
    one = found.dropDuplicates(["post_id"]).join(bad, "post_id", "left")
    return one.where(F.when(F.col("_bad"), _fail(F.concat(F.lit("posts disagree about "), "post_id")).cast("boolean")).otherwise(F.lit(True))).drop("_bad")


def jurisdictions(rows: DataFrame, provider: str, prefecture: str, snapshot: str, resolution: str = "low") -> DataFrame:
    """Areas with their name, parent, codes, source years and an id from their content, in the order of ids.

    Where any level of a hierarchy is there (ward, municipality, district), the most detailed names the area and the next one up its parent; other
    fields are alternatives.  Anything but areas, and an area without a name, is an error.
    """
    if resolution not in ("low", "high"):
        raise ValueError(f"unsupported resolution {resolution!r}")
    p = F.col("properties")
    fields = {k: _first(p, v) for k, v in ALIASES.items()}
    ward, town, district = (_first(p, (k,)) for k in LEVELS)
    levels = F.exists(F.map_keys(p), lambda k: k.isin(*LEVELS))
    name = F.when(levels, F.coalesce(ward, town, district, fields["municipalityName"])).otherwise(fields["municipalityName"])
    above = F.when(ward.isNotNull(), F.coalesce(town, district)).when(town.isNotNull(), district)
    parent = F.when(levels, above).otherwise(fields["parentJurisdictionName"])
    area = F.col("geom.gtype").isin("Polygon", "MultiPolygon") & (F.size("geom.polys") > 0)
    sound = F.when(F.coalesce(area, F.lit(False)), F.lit(True)).otherwise(_fail(F.lit("a jurisdiction needs an area")).cast("boolean"))
    named = rows.where(sound).select(
        F.coalesce(name, _fail(F.lit("a jurisdiction has no name"))).alias("municipalityName"),
        parent.alias("parentJurisdictionName"),
        *[fields[k].alias(k) for k in ("prefectureName", "administrativeCode", "sourceResourceId")],
        p["STARTYEAR"].cast("int").alias("sourceStartYear"),
        p["ENDYEAR"].cast("int").alias("sourceEndYear"),
        "geom",
    )
    shape = F.from_json(geometry_json(F.col("geom")), "coordinates string, type string")
    stable = F.struct("administrativeCode", shape.alias("geometry"), "municipalityName", "parentJurisdictionName", F.lit(prefecture).alias("prefecture"), F.lit(provider).alias("provider"), F.lit(snapshot).alias("snapshotDate"), "sourceResourceId")  # keys in order
    digest = F.substring(F.sha2(F.to_json(stable, {"ignoreNullFields": "false"}), 256), 1, 20)
    out = named.select("*", F.lit(snapshot).alias("snapshotDate"), F.lit(resolution).alias("sourceResolution"), F.concat_ws(":", F.lit(provider), F.lit(prefecture), F.lit(snapshot), digest).alias("jurisdictionId"))
    return out.orderBy("jurisdictionId")
