"""Pairs of groups are settled where their blocks meet, without a row a pair in a shuffle."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators import crossing, grid, topology


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(crossing, "SMALL", 8)  # several blocks, and several portions of each
    monkeypatch.setattr(crossing, "PORTION", 64)
    monkeypatch.setattr(topology, "AT_ONCE", 4)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(spark, copies: int = 3):
    rng = np.random.default_rng(4)
    shapes = [np.cumsum(rng.integers(-2, 3, (4, 2)), 0) + rng.integers(0, 6, 2) for _ in range(12)]
    rows = [(k * 100 + n, [(float(x), float(y)) for x, y in s]) for n, s in enumerate(shapes) for k in range(copies)]
    return rows, spark.createDataFrame(rows, "id long, line array<struct<x: double, y: double>>")


def _nearest(p, line):
    best, since = None, 0.0
    for (x1, y1), (x2, y2) in zip(line, line[1:], strict=False):
        whole = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0.0, min(1.0, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / whole)) if whole else 0.0
        d = math.hypot(p[0] - x1 - t * (x2 - x1), p[1] - y1 - t * (y2 - y1))
        if best is None or d < best[0] - 1e-12:
            best = d, since + t * math.sqrt(whole)
        since += math.sqrt(whole)
    return best, since


def test_junctions_by_blocks_equal_every_pair(spark, small):
    rows, lines = _lines(spark)
    want = set()
    for a, one in rows:
        own = _nearest(one[0], one)[1]
        for b, two in rows:
            for end, here in ((one[0], 0.0), (one[-1], own)):
                (d, at), _ = _nearest(end, two)
                if a != b and d <= 0.5:
                    want.add((a, b, round(here, 6), round(at, 6)) if a < b else (b, a, round(at, 6), round(here, 6)))
    df = topology.junctions(lines, "id", 0.5, places=6)
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    assert "Exchange" not in _plan(df)


def test_adjacency_gives_a_pair_once_without_a_shuffle_of_pairs(spark, small, monkeypatch):
    _, lines = _lines(spark)
    df = topology.adjacency(lines, "id", 0.5)
    many = sorted(tuple(r) for r in df.collect())
    assert "Exchange" not in _plan(df) and len(many) == len(set(many)) and all(a < b for a, b in many)
    for name, value in (("SMALL", 1 << 13), ("PORTION", 1 << 20)):
        monkeypatch.setattr(crossing, name, value)
    monkeypatch.setattr(topology, "AT_ONCE", 1 << 12)
    assert sorted(tuple(r) for r in topology.adjacency(lines, "id", 0.5).collect()) == many


@pytest.mark.parametrize("block", [1 << 17, 16])  # with the latter keys have more rows than a block
def test_counted_pairs_by_blocks_equal_every_pair(spark, small, monkeypatch, block):
    monkeypatch.setattr(crossing, "BLOCK", block)
    rng = np.random.default_rng(7)
    rows = [(int(k), i, float(x), float(y)) for i, (k, x, y) in enumerate(zip(rng.integers(0, 9, 300), rng.uniform(0, 12, 300).round(1), rng.uniform(0, 12, 300).round(1), strict=True))]
    rows += [(3, 1000, float("nan"), 1.0), (4, 1001, None, 1.0), (None, 1002, 1.0, 1.0)]
    want: dict = {}
    for a, i, x, y in rows[:300]:
        for b, j, u, v in rows[:300]:
            d = math.sqrt((x - u) * (x - u) + (y - v) * (y - v))
            if a < b and d <= 1.0 and (i + j) % 3:
                n, least = want.get((a, b), (0, math.inf))
                want[a, b] = n + 1, min(least, d)
    s = spark.createDataFrame(rows, "k long, i long, x double, y double")
    df = crossing.counted_pairs(s, "k", 1.0, lambda one, two, i, j: (one.column("i").to_numpy()[i] + two.column("i").to_numpy()[j]) % 3 != 0, ["i"])
    assert {(r.a, r.b): (r.n, r.least) for r in df.collect()} == want
    if block > 300:
        assert "Exchange" not in _plan(df)


def test_distance_join_deals_few_rows_to_all_partitions_and_splits_cells(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 16)  # crowded cells go to several partitions
    rng = np.random.default_rng(3)
    p, o = rng.uniform(0, 9, (150, 2)).round(1).tolist(), rng.uniform(0, 9, (90, 2)).round(1).tolist()
    one = spark.createDataFrame([(i, *v) for i, v in enumerate([*p, [float("nan"), 1.0]])], "i int, x double, y double")
    two = spark.createDataFrame([(j, *v) for j, v in enumerate(o)], "j int, ox double, oy double")
    df = grid.grid_distance_join(one, two, 2.0).select("i", "j", "distance")
    want = {(i, j): math.hypot(a - c, b - d) for i, (a, b) in enumerate(p) for j, (c, d) in enumerate(o) if math.hypot(a - c, b - d) <= 2.0}
    found = df.collect()
    assert len(found) == len(want) and {(r.i, r.j): r.distance for r in found} == pytest.approx(want)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rounded_equals_round(spark):
    rng = np.random.default_rng(1)
    values = [*(rng.uniform(-9, 9, 3000)).tolist(), *(rng.integers(-9000, 9000, 3000) / 2000).tolist(), 0.0005, 1.0005, 2.5e-7, 4e9 + 0.00049, -0.0, None, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (3, 6):
        assert df.where(~F.round("v", places).eqNullSafe(g.rounded(F.col("v"), places))).count() == 0
