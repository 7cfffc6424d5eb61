"""Text of the map-server queries; sending them is left to the caller."""

from __future__ import annotations


def quoted(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def relation_query(tags: dict[str, str], box: tuple[float, float, float, float], seconds: int = 180) -> str:
    """Relations with all these tags in a box (west, south, east, north), their members and the members' geometry."""
    w, s, e, n = box
    where = "".join(f"[{quoted(k)}={quoted(v)}]" for k, v in sorted(tags.items()))
    return f"[out:json][timeout:{seconds}];(relation{where}({s},{w},{n},{e}););out body geom;>;out skel geom;"


def way_query(tags: dict[str, str], box: tuple[float, float, float, float], seconds: int = 180) -> str:
    """Ways with all these tags in a box, with their geometry."""
    w, s, e, n = box
    where = "".join(f"[{quoted(k)}={quoted(v)}]" for k, v in sorted(tags.items()))
    return f"[out:json][timeout:{seconds}];(way{where}({s},{w},{n},{e}););out body geom;"
