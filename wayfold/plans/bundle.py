"""A project bundle: select features by the project's rules, group them, make search entries, and write a folder a layer."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import text as t
from wayfold.functions.projection import padded_bounds, to_metres, utm
from wayfold.operators import grid
from wayfold.sources.cache import BOUNDS, with_bounds
from wayfold.sources.features import geojson_lines, vertices

#: Layers of a bundle, each written even if it is empty.
FAMILIES = ("modern-roads", "railways", "rail-tracks", "stations", "historical-roads", "historical-posts", "locations")
LAYERS = {"modernRoads", "railways", "stations", "historicalRoads", "historicalPosts", "locations"}


def problems(project: dict[str, Any]) -> list[str]:
    """What is wrong with a project's configuration; nothing if it can be built."""
    out = [f"unknown layer {k}" for k in sorted(set(project.get("layers", {})) - LAYERS)]
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf")
    rails = project.get("layers", {}).get("railways")
    if rails and not (rails == {"mode": "bbox"} or (rails.get("mode") == "near-modern-roads" and number(rails.get("distanceKm")) and rails["distanceKm"] > 0)):
        out.append("railways need mode bbox, or near-modern-roads with a positive distanceKm")
    if project.get("layers", {}).get("stations") not in (None, {"mode": "bbox"}):
        out.append("stations need mode bbox")
    bounds = project.get("bounds", {"mode": "auto"})
    if isinstance(bounds, list):
        if not (len(bounds) == 4 and all(map(number, bounds)) and -180 <= bounds[0] < bounds[2] <= 180 and -90 <= bounds[1] < bounds[3] <= 90):
            out.append("bounds must be west, south, east, north")
    elif not (bounds.get("mode") == "auto" and number(bounds.get("paddingKm", 3)) and bounds.get("paddingKm", 3) > 0):
        out.append("automatic bounds need a positive paddingKm")
    return out


def resolve_bounds(project: dict[str, Any], roads: DataFrame) -> tuple[float, float, float, float]:
    """The project's box, or that of its roads with padding."""
    bounds = project.get("bounds", {"mode": "auto"})
    if isinstance(bounds, list):
        return tuple(map(float, bounds))
    box = with_bounds(roads).agg(*[(F.min if c in BOUNDS[:2] else F.max)(c) for c in BOUNDS]).first()
    if box[0] is None:
        raise ValueError("automatic bounds need a road")
    return padded_bounds(tuple(box), bounds.get("paddingKm", 3))


def in_box(rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    w, s, e, n = box
    found = rows if set(BOUNDS) <= set(rows.columns) else with_bounds(rows)
    return found.where((F.col("bbox_west") <= e) & (F.col("bbox_east") >= w) & (F.col("bbox_south") <= n) & (F.col("bbox_north") >= s)).drop(*BOUNDS)


def near_roads(routes: DataFrame, roads: DataFrame, kilometres: float) -> DataFrame:
    """Whole routes that come within a distance of a road anywhere along their course, in metres of the UTM zone of the roads' middle."""
    box = with_bounds(roads).agg(F.min("bbox_west"), F.max("bbox_east")).first()
    if box[0] is None:
        return routes.limit(0)
    zone = utm((box[0] + box[1]) / 2)

    def pieces(rows: DataFrame, key: str) -> DataFrame:
        lines = rows.select(F.col("id").alias(key), F.explode("geom.polys").alias("poly")).select(key, F.posexplode("poly").alias("part", "line"), F.col("poly"))
        flat = lines.select(key, F.xxhash64("poly").alias("poly"), "part", F.posexplode("line").alias("i", "p")).withColumn("m", to_metres(F.col("p.x"), F.col("p.y"), zone))
        at = flat.groupBy(key, "poly", "part").agg(F.sort_array(F.collect_set(F.struct("i", "m.x", "m.y"))).alias("line"))
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("line") - 2, F.lit(0))), lambda k: F.struct(F.get("line", k).alias("a"), F.coalesce(F.get("line", k + 1), F.get("line", k)).alias("b")))
        return at.select(key, F.explode(pairs).alias("s")).select(key, F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))

    near = grid.segments_within(pieces(routes, "id"), pieces(roads, "road").drop("road"), kilometres * 1000, ["id"], [])
    return routes.join(near.select("id"), "id", "left_semi")


def selected(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows with the listed ids, and the listed ids that have no row."""
    wanted = ids.select(id_col).distinct()
    return rows.join(wanted, id_col, "left_semi"), wanted.join(rows, id_col, "left_anti")


def with_memberships(tracks: DataFrame, routes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks with the ids of their routes and routes with those of their tracks in order; none is an empty list.  members: route, way, pos."""
    of_track = members.groupBy("way").agg(F.array_sort(F.collect_set("route")).alias("rail_route_ids"))
    of_route = members.groupBy("route").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "way"))), lambda x: x["way"]).alias("member_way_ids"))
    none = F.expr("cast(array() as array<string>)")
    a = tracks.join(of_track, tracks["id"] == of_track["way"], "left").drop("way").withColumn("rail_route_ids", F.coalesce("rail_route_ids", none))
    b = routes.join(of_route, routes["id"] == of_route["route"], "left").drop("route").withColumn("member_way_ids", F.coalesce("member_way_ids", none))
    return a, b


def search_entries(rows: DataFrame, kind: str, name: str = "name", alias_keys: tuple[str, ...] = ("alt_name", "name:en", "ref")) -> DataFrame:
    """id, type, name, aliases (not the name, distinct, in order) and the terms searched."""
    p = F.col("properties")
    title = t.first_present(p[name], F.col("id"))
    aliases = F.array_distinct(F.filter(F.array_compact(F.array(*[t.present(p[k]) for k in alias_keys])), lambda a: a != title))
    return rows.select("id", F.lit(kind).alias("type"), title.alias("name"), aliases.alias("aliases"), F.transform(F.concat(F.array(title), aliases), t.ascii_lower).alias("terms"))


def materialise(layers: dict[str, DataFrame], root: str) -> DataFrame:
    """Write every family as GeoJSON lines, the search entries and a manifest of counts; returns the manifest."""
    spark = next(iter(layers.values())).sparkSession
    empty = next(iter(layers.values())).select("id", "properties", "geom").limit(0)
    counts, entries = None, None
    for family in FAMILIES:
        rows = layers.get(family, empty).select("id", "properties", "geom")
        geojson_lines(rows).write.mode("overwrite").text(f"{root}/{family}")
        n = rows.agg(F.count("*").alias("n"), F.count_if(F.size(vertices(F.col("geom"))) > 0).alias("n_with_geometry")).withColumn("family", F.lit(family))
        found = search_entries(rows, family)
        counts = n if counts is None else counts.unionByName(n)
        entries = found if entries is None else entries.unionByName(found)
    entries.write.mode("overwrite").json(f"{root}/search")
    counts.select("family", "n", "n_with_geometry").coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return spark.read.schema("family string, n long, n_with_geometry long").json(f"{root}/manifest")
