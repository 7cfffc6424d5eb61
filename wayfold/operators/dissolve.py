"""Union of polygons whose shared boundaries have equal vertices: shared edges cancel, the rest is linked to rings."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import ship


def boundary(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """key, ax, ay, bx, by: the directed edges of each key's polygons that no other polygon of the key has backwards.

    A reduction by undirected edge: only the outline of the union reaches the linking step.  A polygon given twice counts once.
    """
    flat = polygons.select(key, F.explode(rings).alias("ring")).distinct()
    n = F.size("ring")
    pairs = F.zip_with(F.slice("ring", 1, F.greatest(n - 1, F.lit(0))), F.slice("ring", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    edge = flat.select(key, F.explode(pairs).alias("e")).where("e.a != e.b")
    forward = F.struct("e.a.x", "e.a.y") < F.struct("e.b.x", "e.b.y")
    lo, hi = F.when(forward, F.col("e.a")).otherwise(F.col("e.b")), F.when(forward, F.col("e.b")).otherwise(F.col("e.a"))
    net = edge.groupBy(key, lo.alias("lo"), hi.alias("hi")).agg(F.sum(F.when(forward, 1).otherwise(-1)).alias("net")).where("net != 0")
    start, end = F.when(F.col("net") > 0, F.col("lo")).otherwise(F.col("hi")), F.when(F.col("net") > 0, F.col("hi")).otherwise(F.col("lo"))
    return net.select(key, start.alias("s"), end.alias("t")).select(key, F.col("s.x").alias("ax"), F.col("s.y").alias("ay"), F.col("t.x").alias("bx"), F.col("t.y").alias("by"))


def link_rings(edges: list[tuple[tuple[float, float], tuple[float, float]]], left: bool = False) -> list[list[tuple[float, float]]]:
    """Closed rings from directed edges; where several leave a vertex, the one that turns most to the right of the way in is taken, so touching rings stay apart; with ``left``, for rings whose inside is on the left, most to the left."""
    out: dict = {}
    for a, b in sorted(edges):
        out.setdefault(a, []).append(b)
    rings = []
    while out:
        start = min(out)
        ring = [start]
        before = None
        while True:
            here = ring[-1]
            nexts = out[here]
            if len(nexts) > 1 and before is not None:
                back = math.atan2(before[1] - here[1], before[0] - here[0])
                nexts.sort(key=lambda p: (-1 if left else 1) * (math.atan2(p[1] - here[1], p[0] - here[0]) - back) % (2 * math.pi) or 2 * math.pi)
            following = nexts.pop(0)
            if not nexts:
                del out[here]
            before = here
            ring.append(following)
            if following == start:
                break
            if following not in out:
                ring = []
                break
        if ring:
            rings.append(ring)
    return rings


def linked(edges: DataFrame, key: str, left: bool = False) -> DataFrame:
    """key, rings, n_rings, area: each key's directed edges (ax, ay, bx, by) linked to rings."""
    kind = dict(edges.dtypes)[key]

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        found = link_rings([((a, b), (c, d)) for a, b, c, d in zip(rows["ax"], rows["ay"], rows["bx"], rows["by"], strict=True)], left)
        ox, oy = (found[0][0] if found else (0.0, 0.0))  # products of offsets: those of places far out would swallow the last digits
        area = math.fsum((p[0] - ox) * (q[1] - oy) - (q[0] - ox) * (p[1] - oy) for r in found for p, q in zip(r, r[1:], strict=False)) / 2
        return pd.DataFrame({key: [rows[key].iloc[0]], "rings": [[[{"x": x, "y": y} for x, y in r] for r in found]], "n_rings": [len(found)], "area": [abs(area)]})

    ship(edges.sparkSession)
    return edges.groupBy(key).applyInPandas(link, f"{key} {kind}, rings array<array<struct<x: double, y: double>>>, n_rings long, area double")


def dissolve(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """key, rings, n_rings, area: the union of each key's polygons; outer rings keep their direction, holes run against it."""
    return linked(boundary(polygons, key, rings), key)
