"""Identities of routes and roads, and the aliases that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.text import first_present

# Fixed values of the data model.
ROUTE_KEYS = ("numbering", "road_id", "route_id", "routeId", "RouteID", "ROUTE_ID", "roadId", "RoadID", "ROAD_ID", "route", "路線ID", "路線コード", "街道ID")
ROUTE_PATTERN = r"^R\d{3}(?:-\d+)?$"
ROAD_KINDS = {"jp-national": ("国道", "国道"), "tokyo-prefectural": ("東京都道", "都道")}
RING_NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def route_id(properties: Column, strict: bool = True) -> Column:
    """The route id among a feature's properties: the first field with a value, else ``ID`` if it has the form of one.

    None, or one of another form, is an error, and null if not strict.
    """
    own = F.trim(properties["ID"])
    value = F.coalesce(F.trim(first_present(*[properties[k] for k in ROUTE_KEYS])), F.when(own.rlike(ROUTE_PATTERN), own))
    good = F.when(value.rlike(ROUTE_PATTERN), value)
    return good if not strict else F.coalesce(good, F.raise_error(F.concat(F.lit("no valid route id: "), F.coalesce(value, F.lit("no field has any")))))


def road_kind(road_id: Column) -> Column:
    """The kind in a road id of the form kind-number; null for others."""
    kind = F.regexp_extract(road_id, r"^([a-z]+-(?:national|prefectural))-\d+$", 1)
    return F.when(kind.isin(*ROAD_KINDS), kind)


def road_number(road_id: Column) -> Column:
    return F.when(road_kind(road_id).isNotNull(), F.regexp_extract(road_id, r"-(\d+)$", 1))


def _prefix(kind: Column, k: int) -> Column:
    out = F.lit(None).cast("string")
    for name, prefixes in ROAD_KINDS.items():
        out = F.when(kind == name, F.lit(prefixes[k])).otherwise(out)
    return out


def _lead(kind: Column, number: Column) -> Column:
    """The pattern of a title's start; a prefectural road may run through several prefectures."""
    between = F.when(kind == "tokyo-prefectural", F.lit("(?:・[^号]+?道)?")).otherwise(F.lit(""))
    return F.concat(F.lit("^"), _prefix(kind, 0), between, number, F.lit("号"))


def title_matches(title: Column, kind: Column, number: Column) -> Column:
    return F.regexp_like(title, _lead(kind, number))


def road_aliases(title: Column, kind: Column, number: Column) -> Column:
    """Other names of a road: short forms with its number, what its title adds, and forms of a ring road's; distinct, in order, without the title."""
    rest = F.nullif(F.regexp_replace(title, _lead(kind, number), F.lit("")), F.lit(""))
    short = F.concat(_prefix(kind, 1), number, F.when(kind == "jp-national", F.lit("")).otherwise(F.lit("号")))
    second = F.when(kind == "jp-national", F.concat(number, F.lit("号"))).otherwise(F.concat(_prefix(kind, 0), number, F.lit("号")))
    ring = F.nullif(F.regexp_extract(F.coalesce(rest, F.lit("")), f"^環状([{''.join(RING_NUMERALS)}]+)号線$", 1), F.lit(""))
    digits = ring
    for numeral, n in RING_NUMERALS.items():
        digits = F.when(ring == numeral, F.lit(str(n))).otherwise(digits)
    every = F.array(short, second, rest, F.concat(F.lit("環"), ring, F.lit("通り")), F.concat(F.lit("環"), ring), F.concat(F.lit("環"), digits))
    return F.array_distinct(F.filter(F.array_compact(every), lambda a: a != title))
