"""What is compared in blocks of cells against the same over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators import grid, lines, relations
from wayfold.operators.components import connected_components, cut
from wayfold.plans import matching


def test_contenders_own_what_all_candidates_own(spark):
    """Two rows of roads side by side, copies and slanting ones among them: the few that are kept decide as all of them do."""
    rng = random.Random(3)
    atoms = [(e, e % 3 + 1, 0.0 + k * 40, rng.uniform(0, 12), 40.0 + k * 40, rng.uniform(0, 12)) for e in range(60) for k in range(6)]
    atoms += [(100 + e, c, *rest) for e, c, *rest in atoms[::2]]  # copies under other names
    samples = [(p, s, 5.0 * s, 3.0 + p, 1.0, rng.uniform(-0.05, 0.05)) for p in range(4) for s in range(48)]
    a = spark.createDataFrame(atoms, "edge long, class int, x1 double, y1 double, x2 double, y2 double")
    s = spark.createDataFrame(samples, "part long, sample long, x double, y double, tx double, ty double")
    assert len(matching._reaches(a, 35.0, 0.2)) > 1
    every = matching.candidates(s, a).where("part != edge")
    few = matching.contenders(s, a)
    owned = lambda c: sorted(map(tuple, matching.own(c, classes=[1, 2, 3]).collect()))
    want = owned(every)
    assert owned(few) == want and len({r[2] for r in want}) > 5
    assert few.count() < every.count() / 4 and few.groupBy("part", "sample", "edge").count().where("count > 1").isEmpty()
    cheap = {tuple(r)[:3]: r.m for r in every.groupBy("part", "sample", "class").agg(F.min("cost").alias("m")).collect()}
    assert all(abs(cheap[(r.part, r.sample, r["class"])] - r.cost) < 1e-9 for r in matching.nearest_atoms(s, a).collect())


def test_a_block_without_a_class_that_is_still_sought(spark):
    """Samples that have found class 1 go on for class 2, which is elsewhere: their cells hold no atom of it."""
    atoms = [(e, 1, 40.0 * k, e / 5.0, 40.0 * k + 40.0, e / 5.0) for e in range(60) for k in range(6)] + [(99, 2, 900.0, 0.0, 940.0, 0.0)]
    a = spark.createDataFrame(atoms, "edge long, class int, x1 double, y1 double, x2 double, y2 double")
    s = spark.createDataFrame([(1000, k, 5.0 * k, 6.0, 1.0, 0.0) for k in range(40)], "part long, sample long, x double, y double, tx double, ty double")
    assert len(matching._reaches(a, 35.0, 0.2)) > 1
    found = matching.nearest_atoms(s, a).collect()
    assert sorted(r.sample for r in found) == list(range(40)) and {(r["class"], r.edge) for r in found} == {(1, 30)}


def test_rows_whose_number_spark_does_not_know_are_not_broadcast(spark, monkeypatch):
    """Spark takes rows behind an explode for as many as before it; the driver gets sizes of a few cells at most, and none of the rows."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    many = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(2999))).alias("sample"))
    s = cut(many.select(F.lit(1).alias("part"), "sample", F.col("sample").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("tx"), F.lit(0.0).alias("ty")))
    owned = cut(s.where("sample % 2 = 0").select("part", "sample", F.lit(5).alias("owner"), F.lit(1).alias("class")))
    assert "Broadcast" not in plan(matching.coverage(s, owned)) + plan(matching.heal(owned, s))
    others = s.select(F.col("sample").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = lambda: grid.near_blocks(s.select("sample", "x", "y"), others, 2.0, lambda p, o: p[["sample"]], "sample int")
    assert "BuildLeft" not in plan(near())
    some = near().distinct().count()
    monkeypatch.setattr(grid, "CELLS", 0, raising=False)
    assert "Broadcast" not in plan(near()) and near().distinct().count() == some == 3000


def test_lines_far_apart_in_a_block_are_not_compared(monkeypatch, spark):
    """The same links, but a line meets only those whose boxes come near its own, and none that has been reached."""
    rng, taken, pairs = random.Random(8), [], []
    lines_ = [(k, x, y, x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for k, (x, y) in enumerate((rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(300))]
    lines_ += [(k + 300, 5.0, 5.0, 6.0 + k / 100, 6.0) for k in range(200)] + [(500, float("nan"), 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(lines_, "a long, x1 double, y1 double, x2 double, y2 double")
    with monkeypatch.context() as m:
        m.setattr(grid, "in_blocks", lambda here, there, mine, theirs, work, schema, block=0: taken.append(work) or spark.createDataFrame([], schema))
        grid.linked_segments(df, 0.05, 0.5)
    one = df.toPandas().rename(columns={"a": "_a"})
    two = df.toPandas().set_axis(["_b", "_x1", "_y1", "_x2", "_y2"], axis=1)
    every = grid.segment_gaps([one[c].to_numpy()[:, None] for c in one.columns[1:]], [one[c].to_numpy() for c in one.columns[1:]]) <= 0.05
    want = np.arange(len(one))
    grid.merge(want, *np.nonzero(every))
    gaps = grid.segment_gaps
    monkeypatch.setattr(grid, "segment_gaps", lambda a, b: pairs.append(len(a[0]) * len(b[0])) or gaps(a, b))
    found = taken[0](one, two)
    assert dict(zip(found["a"], found["b"], strict=True)) == dict(enumerate(want.tolist()))
    assert sum(pairs) < len(one) ** 2 / 50


def test_few_segments_are_held_by_every_task(spark, monkeypatch):
    """The same distances whether tasks hold the segments or search for them, and no search at all where they are few."""
    rng = random.Random(5)
    line = lambda k: (k, rng.uniform(-300, 300), rng.uniform(-300, 300), rng.uniform(-300, 300), rng.uniform(-300, 300))
    ones = spark.createDataFrame([line(k // 4) for k in range(160)], "k long, x1 double, y1 double, x2 double, y2 double")
    ref = spark.createDataFrame([line(k)[1:] for k in range(5)] + [(float("nan"), 0.0, 1.0, 1.0), (3.0, 4.0, 3.0, 4.0)], "x1 double, y1 double, x2 double, y2 double")
    spots = ones.select("k", F.hash("x1").alias("n"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    both = lambda: (sorted(map(tuple, grid.segments_within(ones, ref, 40.0, ["k"], []).collect())), sorted(map(tuple, grid.nearest_distance(spots, ref, ["k", "n"], 8.0).collect())))
    with monkeypatch.context() as m:
        m.setattr(grid, "FEW", 0)
        want = both()
    with monkeypatch.context() as m:
        m.setattr(grid, "along", None)
        m.setattr(grid, "_far", None)
        found = both()
    for a, b in zip(found, want, strict=True):
        assert [r[:-1] for r in a] == [r[:-1] for r in b] and a
        assert all(abs(x[-1] - y[-1]) < 1e-9 for x, y in zip(a, b, strict=True))


def test_merged_lines_of_large_keys_are_those_of_small_ones(spark, monkeypatch):
    """Chains, rings and a fork under three keys: the same lines whether a key is walked at once or by connected groups, and a task has many keys."""
    rows, ring = [], [(0.0, 5.0), (1.0, 5.0), (1.0, 6.0)]
    for k in range(3):
        rows += [(k, i, [(float(i), 0.0), (float(i + 1), 0.0)][:: 1 if i % 3 else -1]) for i in range(9) if i != 5]
        rows += [(k, 20 + i, [ring[i - 1], ring[i]]) for i in range(3)]
        rows += [(k, 30 + i, [(20.0, 0.0), (21.0, float(i))]) for i in range(3)]
    made = spark.createDataFrame(rows, "key long, id long, line array<struct<x: double, y: double>>")
    merged = lambda: sorted((r.key, tuple((p.x, p.y) for p in r.line)) for r in lines.merge_lines(made, "key").collect())
    with monkeypatch.context() as m:
        m.setattr(lines, "connected_components", None)
        found = merged()
    monkeypatch.setattr(lines, "HELD", 2)
    assert found == merged() and [len(v) for k, v in found if k == 0].count(2) == 3 and len(found) == 18


def test_counted_paths_are_the_walked_ones(spark, monkeypatch):
    """Counts and distinct ends of all simple paths of up to three edges, in many blocks, without walking any."""
    rng = random.Random(8)
    place = lambda k: (k, round(rng.uniform(-9, 9), 2), float(rng.randrange(-6, 6)))
    c = spark.createDataFrame([place(k) for k in range(70)] + [(500, None, 1.0), (501, float("nan"), 1.0), (None, 0.0, 0.0)], "c long, x double, y double")
    s = spark.createDataFrame([place(k) for k in range(40)] + [(None, 0.0, 0.0)], "s long, ox double, oy double")
    edges = grid.grid_distance_join(c, s, 2.0).select(F.concat(F.lit("c"), "c").alias("a"), F.concat(F.lit("s"), "s").alias("b"))
    paths = relations.bounded_paths(edges, edges.select(F.col("b").alias("node")).distinct(), 3)
    want = paths.groupBy(F.element_at("path", 1).alias("source"), (F.size("path") - 1).alias("n")).agg(F.count("*"), F.countDistinct(F.element_at("path", -1)))
    want = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(grid, "STARTS", 3)
    monkeypatch.setattr(grid, "grid_distance_join", None)
    found = grid.paths_within(c, s, 2.0, "c", "s").select(F.concat(F.lit("s"), "s"), "n_edges", "n_paths", "n_ends")
    assert sorted(map(tuple, found.collect())) == want and len(want) > 60


def test_linked_segments_have_the_components_of_all_pairs(spark, monkeypatch):
    """Crossing and touching lines, and some that stay alone, in many blocks: a line gives an edge a block at most, not a row for each it meets."""
    rng = random.Random(11)
    rows = []
    for k in range(90):
        x, y = rng.uniform(0, 300), rng.uniform(0, 60)
        for _ in range(3):
            u, v = x + rng.uniform(-12, 12), y + rng.uniform(-12, 12)
            rows.append((k, x, y, u, v))
            x, y = u, v
    rows += [(200, 1000.0, 0.0, 1010.0, 0.0), (201, 1010.005, 0.0, 1020.0, 0.0), (202, 1030.0, 0.0, 1040.0, 0.0)]
    segs = spark.createDataFrame(rows, "a long, x1 double, y1 double, x2 double, y2 double")
    other = segs.select(F.col("a").alias("b"), *(F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")))
    gap = g.segment_segment(tuple(map(F.col, ("x1", "y1", "x2", "y2"))), tuple(map(F.col, ("_x1", "_y1", "_x2", "_y2"))))
    every = segs.crossJoin(other).where("a < b").where(gap <= 0.01).select("a", "b").distinct()
    group = lambda edges: sorted(map(tuple, connected_components(edges).collect()))
    want = group(every)
    for block in (8192, 5):
        monkeypatch.setattr(grid, "BLOCK", block)
        assert group(grid.linked_segments(segs, 0.01, 500.0 if block == 8192 else 9.0)) == want
    assert len({c for _, c in want}) > 5 and (201, 200) in want and 202 not in dict(want)
