"""The reference of a road: features chosen by exact identity, members left out by name, and how connected the rest is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import text as t
from wayfold.operators import grid, polyline
from wayfold.operators.components import connected_components, cut

#: Name fields that are looked at where none are configured: fixed values.
NAME_TAGS = ("name", "name:ja", "alt_name")
EXCLUDE_NAME_TAGS = ("name", "name:ja", "name:en", "alt_name")
TOUCH = 0.01


def _any_token(properties: str, tags: tuple[str, ...], names: list[str]) -> Column:
    wanted = F.array(*map(F.lit, names))
    return reduce(Column.__or__, [t.has_token(F.col(properties)[tag], wanted) for tag in tags])


def identified(features: DataFrame, config: dict, properties: str = "properties", id_col: str = "id") -> DataFrame:
    """The features of a configured identity.

    ``osm-ref``: a whole token of ``ref`` is the number, and ``network`` is exactly the configured one if there is one.  ``osm-name``: a whole token of any
    name field is one of the names.  Then only ``includeIds``, if any, and none of ``excludeIds``.  Parts of a token never count.
    """
    p = F.col(properties)
    if config["type"] == "osm-ref":
        wanted = t.has_token(p["ref"], F.array(F.lit(str(config["ref"]))))
        if config.get("network"):
            wanted = wanted & F.coalesce(p["network"] == str(config["network"]), F.lit(False))
    elif config["type"] == "osm-name":
        if not config.get("names"):
            raise ValueError("a reference by name without names")
        wanted = _any_token(properties, tuple(config.get("tags", NAME_TAGS)), list(config["names"]))
    else:
        raise ValueError(f"unknown reference type {config['type']!r}")
    for key, keep in (("includeIds", True), ("excludeIds", False)):
        ids = list(map(str, config.get(key, [])))
        if ids:
            inside = F.coalesce(F.col(id_col).cast("string").isin(ids), F.lit(False))
            wanted = wanted & (inside if keep else ~inside)
    return features.where(wanted)


def split_members(features: DataFrame, config: dict, properties: str = "properties") -> tuple[DataFrame, DataFrame]:
    """Kept and excluded members: excluded are those of which a whole token of a name field is one of ``excludeNames``."""
    names = list(config.get("excludeNames", []))
    if not names:
        return features, features.limit(0)
    out = _any_token(properties, tuple(config.get("excludeNameTags", EXCLUDE_NAME_TAGS)), names)
    return features.where(~out), features.where(out)


def components(lines: DataFrame, id_col: str = "id", line: str = "line", touch: float = TOUCH) -> DataFrame:
    """component, n_lines, length: groups of lines that touch each other, crossing in their insides included; a line without length has none."""
    segs = cut(polyline.line_segments(lines, id_col, line))
    size = segs.agg(F.avg(F.col("to") - F.col("from"))).first()[0] or touch
    ids = segs.select(F.col(id_col).alias("a"), "x1", "y1", "x2", "y2")
    edges = grid.linked_segments(ids, touch, max(size / 4, touch))
    alone = segs.select(F.col(id_col).alias("a"), F.col(id_col).alias("b")).distinct()
    found = connected_components(edges.unionByName(alone))
    sizes = segs.groupBy(id_col).agg(F.max("to").alias("length"))
    return found.join(sizes, found["node"] == sizes[id_col]).groupBy("component").agg(F.count("*").alias("n_lines"), F.sum("length").alias("length"))


def build(features: DataFrame, config: dict, line: str = "line", properties: str = "properties", id_col: str = "id") -> dict[str, DataFrame]:
    """reference (the members that stay), excluded, components and a summary of one row; no synthetic bridges are added.

    An identity without members, or whose members are all left out by name, is an error.
    """
    members = cut(identified(features, config, properties, id_col))
    kept, out = split_members(members, config, properties)
    if members.isEmpty():
        raise ValueError("no feature has the reference's identity")
    if kept.isEmpty():
        raise ValueError("name exclusions leave no reference")
    groups = cut(components(kept, id_col, line))
    lengths = groups.agg(F.count("*").alias("n_components"), F.transform(F.reverse(F.array_sort(F.collect_list("length"))), lambda x: F.round(x, 1)).alias("lengths"))
    counts = members.agg(F.count("*").alias("n_members")).crossJoin(kept.agg(F.count("*").alias("n_ways")))  # a row each
    summary = counts.crossJoin(lengths).select("n_members", "n_ways", (F.col("n_members") - F.col("n_ways")).alias("n_excluded"), "n_components", "lengths", (F.col("n_components") > 1).alias("ambiguous"), F.lit(0).alias("bridges_added"))
    return {"reference": kept, "excluded": out, "components": groups, "summary": summary}
