import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.functions import text as t
from wayfold.operators import dissolve, grid, islands, polyline, relations
from wayfold.operators.bitmap import KeyFilter
from wayfold.operators.components import connected_components
from wayfold.plans import matching, trajectories


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_join_equals_brute_force(spark):
    rng = random.Random(3)
    a = [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(300)]
    b = [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(200)]
    found = grid.grid_distance_join(spark.createDataFrame(a, "i int, x double, y double"), spark.createDataFrame(b, "j int, ox double, oy double"), 4.0)
    assert sorted((r["i"], r["j"]) for r in found.collect()) == sorted((i, j) for i, x, y in a for j, u, v in b if math.hypot(x - u, y - v) <= 4)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_blocks_equal_brute_force(spark, monkeypatch):
    """Crowded cells in blocks of four: the nearest with its count, and edges with the components of all pairs; no pair goes through a join."""
    monkeypatch.setattr(grid, "BLOCK", 4)
    rng = random.Random(8)
    spots = [(rng.choice([0.0, 0.5, 3.0, 10.0]) + rng.randrange(3), float(rng.randrange(6))) for _ in range(60)]
    a, b = [(k, *p) for k, p in enumerate(spots[:35])], [(k, *p) for k, p in enumerate(spots[35:])]
    one, two = spark.createDataFrame(a, "k long, x double, y double"), spark.createDataFrame(b, "o long, ox double, oy double")
    far = lambda p, q: math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)
    near = {p[0]: sorted((far(p, q), q[0]) for q in b if far(p, q) <= 1.5) for p in a}
    found = {r["k"]: (r["distance"], r["o"], r["n"]) for r in grid.nearest_within(one, two, 1.5, "k", "o").collect()}
    assert found == {k: (*v[0], len(v)) for k, v in near.items() if v}
    edges = grid.linked_within(one.withColumn("a", F.concat(F.lit("a"), "k")), two.withColumn("b", F.concat(F.lit("b"), "o")), 1.5, "a", "b")
    label = {f"a{k}": f"a{k}" for k, v in near.items() if v} | {f"b{o}": f"b{o}" for v in near.values() for _, o in v}
    for k, v in near.items():
        for _, o in v:
            low, high = sorted((label[f"a{k}"], label[f"b{o}"]))
            label = {n: low if c == high else c for n, c in label.items()}
    assert {r["node"]: r["component"] for r in connected_components(edges).collect()} == label
    assert edges.count() <= 35 * 7 * 9 and grid.nearest_within(one.limit(0), two, 1.5, "k", "o").count() == 0


def test_segment_join_equals_brute_force(spark):
    rng = random.Random(4)
    p = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(200)]
    s = [(j, *(rng.uniform(-50, 50) for _ in range(4))) for j in range(60)] + [(60, 5.0, -40.0, 5.0, 40.0), (61, 1.0, 1.0, 1.0, 1.0)]
    d = g.point_segment(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))
    found = grid.grid_segment_join(spark.createDataFrame(p, "i int, x double, y double"), spark.createDataFrame(s, "j int, x1 double, y1 double, x2 double, y2 double"), 3.0, d)

    def far(x, y, x1, y1, x2, y2):
        return matching.project((x, y), [(x1, y1), (x2, y2)])[1]

    pairs = [(r["i"], r["j"]) for r in found.collect()]
    assert sorted(pairs) == sorted((i, j) for i, x, y in p for j, *e in s if far(x, y, *e) <= 3)
    assert "NestedLoop" not in plan(found)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300), (5, None)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {x: root(x) for a, b in edges if b is not None for x in (a, b)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_key_filter_loses_no_key(spark):
    keys = spark.range(0, 5000).select((F.col("id") * 3).alias("k"))
    rows = spark.range(0, 15000).select(F.when(F.col("id") % 500 == 1, F.lit(None)).otherwise(F.col("id")).alias("q"))
    kept = [r["q"] for r in rows.where(KeyFilter(keys, "k").may_have(F.col("q"))).collect()]
    assert None not in kept
    assert {q for q in range(0, 15000, 3) if q % 500 != 1} <= set(kept) and len(kept) < 5100


def test_runs_gate_and_heal(spark):
    values = ["a", "a", "b", "a", None, "c", "c", "c", None, None, None, "c"]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v string")
    table = islands.run_table(rows, ["k"], ["i"], "i", "v").orderBy("start").collect()
    assert [(r["v"], r["start"], r["end"]) for r in table] == [("a", 0, 2), ("b", 2, 3), ("a", 3, 4), (None, 4, 5), ("c", 5, 8), (None, 8, 11), ("c", 11, 12)]
    assert [r["kept"] for r in islands.gate(rows, ["k"], ["i"], "v", 3).orderBy("i").collect()] == [None] * 5 + ["c"] * 3 + [None] * 4
    assert [r["healed"] for r in islands.heal(rows, ["k"], ["i"], "i", "v", 2).orderBy("i").collect()] == ["a", "a", "a", "a", None, "c", "c", "c", None, None, None, "c"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), max_size=8))
def test_interval_subtraction_equals_sets(spark, cuts):
    whole = spark.createDataFrame([(1, 5, 25)], "k int, s int, e int")
    rows = spark.createDataFrame([(1, a, a + n) for a, n in cuts], "k int, s int, e int")
    left = islands.subtract_intervals(whole, rows, ["k"], "s", "e").collect()
    expected = set(range(5, 25)) - {x for a, n in cuts for x in range(a, a + n)}
    assert sorted(x for r in left for x in range(r["s"], r["e"])) == sorted(expected)


def test_ambiguity_stops_the_search(spark):
    rows = spark.createDataFrame([(1, "x", "y"), (2, "two", "y"), (3, None, "y"), (4, "none", "none")], "k int, a string, b string")
    names = spark.createDataFrame([("x", "X"), ("two", "P"), ("two", "Q"), ("y", "Y"), ("y", "Y")], "alias string, entry string")
    found = {r["k"]: (r["entry"], r["ambiguous"]) for r in relations.ambiguous_lookup(rows, "k", ["a", "b"], names, "alias", "entry").collect()}
    assert found == {1: ("X", False), 2: (None, True), 3: ("Y", False), 4: (None, False)}


def test_paths_are_simple_and_bounded(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4)]
    found = relations.bounded_paths(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(1,)], "node int"), 3)
    both = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    expected = [list(p) for n in (2, 3, 4) for p in itertools.permutations(range(1, 5), n) if p[0] == 1 and all((a, b) in both for a, b in itertools.pairwise(p))]
    assert sorted(r["path"] for r in found.collect()) == sorted(expected)


def test_samples_lie_on_the_line_and_end_it(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 3.0, 4.0), (1, 3, 3.0, 10.0)], "k int, i int, x double, y double")
    rows = polyline.samples(polyline.segments(points, "k", ["i"]), "k", 2.0).orderBy("at").collect()
    assert [r["at"] for r in rows] == [0, 2, 4, 6, 8, 10, 11] and (rows[-1]["x"], rows[-1]["y"]) == (3.0, 10.0)
    assert rows[1]["x"] == pytest.approx(1.2) and rows[1]["y"] == pytest.approx(1.6)


def test_clip_equals_dense_sampling(spark):
    rng = random.Random(9)
    lines = [tuple(rng.uniform(-10, 10) for _ in range(4)) for _ in range(60)] + [(-5.0, 5.0, 5.0, 5.0), (0.0, -9.0, 0.0, 9.0), (6.0, 0.0, 6.0, 1.0)]
    df = spark.createDataFrame(lines, "x1 double, y1 double, x2 double, y2 double")
    rows = df.select(g.clip(*map(F.col, ("x1", "y1", "x2", "y2")), -5.0, -5.0, 5.0, 5.0).alias("c")).collect()
    for (x1, y1, x2, y2), row in zip(lines, rows, strict=True):
        ts = np.linspace(0, 1, 4001)
        x, y = x1 + ts * (x2 - x1), y1 + ts * (y2 - y1)
        inside = ts[(abs(x) <= 5 + 1e-9) & (abs(y) <= 5 + 1e-9)]
        if len(inside):
            assert row["c"]["t0"] == pytest.approx(inside[0], abs=3e-4) and row["c"]["t1"] == pytest.approx(inside[-1], abs=3e-4)
        else:
            assert row["c"] is None or row["c"]["t1"] - row["c"]["t0"] < 3e-4


@pytest.mark.parametrize(("text", "form"), [("Ｒ２０", "20"), ("国道20号", "20"), ("一丁目 ・三番", "1丁目三番"), ("ＡＢ c", "abc"), ("r", "r")])
def test_search_form(text, form):
    assert t.search_form(text) == form


def test_tokens_are_whole(spark):
    row = spark.createDataFrame([("20; 200 ;x",), (None,)], "v string").select(t.has_token(F.col("v"), F.array(F.lit("20"))).alias("a"), t.has_token(F.col("v"), F.array(F.lit("2"))).alias("b")).collect()
    assert [tuple(r) for r in row] == [(True, False), (False, False)]


def test_hysteresis_keeps_the_owner_and_forgets_at_holes():
    cand = {0: [(1.0, "a"), (2.0, "b")], 1: [(3.0, "a"), (2.0, "b")], 2: [(9.0, "a"), (2.0, "b")], 4: [(3.0, "a"), (2.5, "b")]}
    assert matching.assign(cand, {}, range(5), 2.0, 1) == {0: "a", 1: "a", 2: "b", 4: "b"}
    assert matching.assign(cand, {}, range(5), 2.0, 2) == {0: "a", 1: "a"}
    assert matching.assign(cand, {1: "z"}, range(5), 2.0, 1) == {0: "a", 2: "b", 4: "b"}


def test_higher_class_owns_first(spark):
    rows = [("p", s, e, c, cost) for s in range(6) for e, c, cost in (("main", 1, 5.0), ("side", 2, 1.0)) if not (e == "main" and s > 3)]
    found = matching.own(spark.createDataFrame(rows, "part string, sample long, edge string, class int, cost double"), 2.0, 2).orderBy("sample").collect()
    assert [(r["sample"], r["owner"], r["class"]) for r in found] == [(s, "main", 1) for s in range(4)] + [(s, "side", 2) for s in (4, 5)]


def test_rescue_takes_the_only_atom_and_no_best_guess():
    reference = [(0.0, 0.0), (100.0, 0.0)]
    lines = {"a": [(0.0, 1.0), (30.0, 1.0)], "b": [(45.0, 1.0), (100.0, 1.0)], "mid": [(30.0, 1.0), (45.0, 1.0)]}
    owners = {s: "a" for s in range(7)} | {s: "b" for s in range(9, 21)}
    assert matching.rescue(owners, lines, reference)[7] == "mid"
    assert matching.rescue(owners, lines | {"twin": [(30.0, 1.5), (45.0, 1.5)]}, reference) == owners
    assert matching.rescue(owners, lines, reference, barred=frozenset({"mid"})) == owners
    back = lines | {"mid": lines["mid"][::-1]}
    assert matching.rescue(owners, back, reference)[8] == "mid"


def test_chains_use_each_line_once_and_prefer_straight():
    lines = [("a", [(0, 0), (10, 0)]), ("b", [(10, 0.5), (20, 0)]), ("c", [(10, 0), (12, 8)]), ("d", [(30, 0), (20, 0)])]
    frame = pd.DataFrame([(k, i, float(x), float(y)) for k, c in lines for i, (x, y) in enumerate(c)], columns=["line", "i", "x", "y"])
    found = matching.chains(frame)
    assert sorted(found["line"]) == ["a", "b", "c", "d"]
    assert [list(v.sort_values("pos")["line"]) for _, v in found.groupby("chain")] == [["a", "b", "d"], ["c"]]


def test_connect_accepts_one_path_only(spark):
    gap = spark.createDataFrame([("p", 1, "a", "z", 10.0), ("p", 2, "a", "y", 10.0), ("p", 3, "q", "z", 10.0)], "part string, run int, owner string, next_owner string, gap_m double")
    edges = spark.createDataFrame([("a", "m"), ("m", "z"), ("a", "n"), ("n", "y"), ("m", "y")], "a string, b string")
    size = spark.createDataFrame([("m", 12.0), ("n", 11.0), ("z", 5.0), ("y", 5.0), ("a", 5.0)], "atom string, length double")
    found = {r["run"]: (r["decision"], r["path"]) for r in matching.connect(gap, edges, size, most=1).collect()}
    assert found == {1: ("accepted-auto-connector", ["m"]), 2: ("unresolved-ambiguous", None), 3: ("unresolved-no-path", None)}


def test_partitions_for_windows_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(islands, "PORTION", 10)
    rows = spark.range(200).select((F.col("id") % 50).alias("k"), "id")
    found = islands.dealt(rows, ["k"])
    assert found.rdd.getNumPartitions() == 21 and found.count() == 200 and islands.dealt(rows.limit(5), ["k"]).rdd.getNumPartitions() == 4


def test_masked_samples_need_no_row_a_pair(spark):
    assert "FlatMapGroupsInPandas" in plan(trajectories.parallel_suppression(spark, "/root/testdata/sf0.001"))


def test_areas_far_out_keep_their_digits(spark):
    x, y = 1e7 + 0.1, 3e7 + 0.7
    edges = [(1, x, y, x + 0.5, y), (1, x + 0.5, y, x + 0.5, y + 0.25), (1, x + 0.5, y + 0.25, x, y + 0.25), (1, x, y + 0.25, x, y)]
    found = dissolve.linked(spark.createDataFrame(edges, "k long, ax double, ay double, bx double, by double"), "k", left=True).first()
    assert abs(found["area"] - 0.125) < 1e-6  # 0.1875 by products of the places themselves
