"""Queries over polylines: length, samples, residuals to a reference, ownership, runs and gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators import crossing, grid, islands, polyline
from wayfold.operators.components import cut
from wayfold.plans import matching
from wayfold.plans.matching import own
from wayfold.plans.tables import POINTS, SEGMENTS, points, samples_sql, segment_gap, segments, table

STEP = 25.0
RADIUS = 10.0
MEDIAN, P90 = 13.0, 45.0


def traj_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: planar length of each polyline, by higher-order functions over its ordered vertices."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("i", "x", "y"))), lambda p: g.vertex(p["x"], p["y"]))
    return points(spark, sf_dir).groupBy("user_id").agg(line.alias("line")).select("user_id", F.size("line").cast("long").alias("n_vertices"), F.round(g.length(F.col("line")), 4).alias("length"))


def traj_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bounds of each polyline."""
    return points(spark, sf_dir).groupBy("user_id").agg(F.round(F.min("x"), 6).alias("w"), F.min("y").alias("s"), F.round(F.max("x"), 6).alias("e"), F.max("y").alias("n"))


def traj_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at equal steps along each polyline, and at its end."""
    return polyline.samples(segments(spark, sf_dir), "user_id", STEP).select("user_id", "sample", F.round("at", 3).alias("chain"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def traj_tangent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction at each sample against the next one's, and their angles."""
    s = polyline.samples(segments(spark, sf_dir), "user_id", STEP)
    w = Window.partitionBy("user_id").orderBy("sample", "at")
    s = s.select("user_id", "sample", "tx", "ty", F.lead("tx").over(w).alias("ux"), F.lead("ty").over(w).alias("uy")).where("ux is not null")
    return s.groupBy("user_id").agg(
        F.round(F.avg(g.turn(*map(F.col, ("tx", "ty", "ux", "uy")))), 4).alias("mean_turn"), F.round(F.max(g.undirected_angle(*map(F.col, ("tx", "ty", "ux", "uy")))), 4).alias("max_angle"), F.count("*").alias("n")
    )


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each sample to the reference, the polyline with the least user id, where it is within RADIUS."""
    segs = segments(spark, sf_dir)
    first = segs.agg(F.min("user_id").alias("reference"))
    ref = segs.join(first, F.col("user_id") == F.col("reference"), "left_semi").select("x1", "y1", "x2", "y2")
    s = polyline.samples(segs, "user_id", STEP)
    d = g.point_segment(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))
    near = grid.grid_segment_join(s.select("user_id", "sample", "x", "y"), ref, RADIUS, d)
    return near.groupBy("user_id", "sample").agg(F.min("distance").alias("d"))


def traj_residual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every polyline within RADIUS of the reference, the least distance of the two lines, and how far all its samples are, near and far ones."""
    segs = cut(segments(spark, sf_dir))
    first = segs.agg(F.min("user_id").alias("reference"))
    ref = cut(segs.join(first, F.col("user_id") == F.col("reference"), "left_semi").select("x1", "y1", "x2", "y2"))
    shortlist = cut(grid.segments_within(segs, ref, RADIUS, ["user_id"], []))
    s = polyline.samples(segs, "user_id", STEP).select("user_id", "sample", "x", "y")
    every = grid.nearest_distance(s.join(shortlist, "user_id", "left_semi"), ref, ["user_id", "sample"], 4 * RADIUS, "d").groupBy("user_id", "sample").agg(F.min("d").alias("d"))
    found = every.groupBy("user_id").agg(F.count("*").alias("n_samples"), F.round(F.percentile("d", F.lit(0.5)), 3).alias("median_d"), F.round(F.percentile("d", F.lit(0.9)), 3).alias("p90_d"))
    return found.join(shortlist, "user_id").select("user_id", "n_samples", F.round("distance", 3).alias("min_d"), "median_d", "p90_d")


def traj_residual_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines whose median and 90th percentile, rounded first, are within the limits."""
    return traj_residual_stats(spark, sf_dir).where((F.col("median_d") <= MEDIAN) & (F.col("p90_d") <= P90)).select("user_id", "median_d", "p90_d")


def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: share of each polyline's samples within RADIUS of the reference."""
    s = polyline.samples(segments(spark, sf_dir), "user_id", STEP).select("user_id", "sample").distinct()
    near = _near(spark, sf_dir).select("user_id", "sample", F.lit(1).alias("hit"))
    return s.join(near, ["user_id", "sample"], "left").groupBy("user_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")) * 100, 3).alias("covered_pct"), F.count("*").alias("n_samples"))


def uncovered_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two samples or more that the reference does not cover."""
    s = polyline.samples(segments(spark, sf_dir), "user_id", STEP).select("user_id", "sample").distinct()
    near = _near(spark, sf_dir).select("user_id", "sample", F.lit(1).alias("hit"))
    return islands.intervals(s.join(near, ["user_id", "sample"], "left"), ["user_id"], "sample", F.col("hit").isNull(), 2)


def parallel_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of different polylines close to each other, counted by pair of polylines."""
    s = polyline.samples(segments(spark, sf_dir), "user_id", STEP).select("user_id", "sample", "x", "y", "tx", "ty")

    def fits(one: pa.Table, two: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (ax, ay), (bx, by) = crossing.matrix(one, "tx", "ty"), crossing.matrix(two, "tx", "ty")
        return grid.undirected_angles(ax[i], ay[i], bx[j], by[j]) <= 55

    found = crossing.counted_pairs(s, "user_id", 1.0, fits, ["sample"])
    return found.select(F.col("a").alias("user_id"), F.col("b").alias("other"), F.col("n").alias("n_close"), F.round("least", 4).alias("min_d"))


def parallel_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a sample of a higher class (a smaller user id modulo 3) of another polyline nearby are masked; masked runs of three or more lose their owner.

    Any two samples of a cell whose diagonal is below 4 are near, so where a cell has a higher class its samples are masked without being compared: only
    the others, where there are few, meet what lies around them.
    """
    s = cut(polyline.samples(segments(spark, sf_dir), "user_id", STEP).select("user_id", "sample", "x", "y", F.pmod("user_id", F.lit(3)).alias("class")))
    side = 4.0 / 2**0.5 * (1 - 1e-9)
    finite = F.coalesce((F.abs("x") < 1e300) & (F.abs("y") < 1e300), F.lit(False))
    placed = s.where(finite).withColumn("fx", grid.cell(F.col("x"), side)).withColumn("fy", grid.cell(F.col("y"), side))
    highest = cut(placed.where("class < 2").groupBy("fx", "fy").agg(F.min("class").alias("least")))
    settled = F.coalesce(F.col("least") < F.col("class"), F.lit(False))
    told = cut(placed.where("class > 0").join(grid.sent(highest), ["fx", "fy"], "left").select("user_id", "sample", "x", "y", "class", settled.alias("settled")))
    left = told.where("not settled").drop("settled")
    other = cut(s.where("class < 2").select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("class").alias("oclass")).distinct())

    def work(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(p), bool)
        for c in np.unique(p["class"]):  # of a smaller class, so of another user
            at, above = np.flatnonzero(p["class"] == c), o[o["oclass"] < c]
            for rows, _, d in grid.distances(p.iloc[at], above, 4.0):
                hit[at[rows[(d <= 4.0).any(1)]]] = True
        return p.loc[hit, ["user_id", "sample"]]

    masked = grid.near_blocks(left, other, 4.0, work, "user_id long, sample long", size=16.0).unionByName(told.where("settled").select("user_id", "sample")).distinct()
    return islands.intervals(masked, ["user_id"], "sample", F.lit(True), 3)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events make a sample; each is a candidate edge of a class, with its value as the cost."""
    return points(spark, sf_dir).select("user_id", F.floor(F.col("i") / 3).cast("long").alias("sample"), F.col("event_type").alias("edge"), (F.col("k") % 3 + 1).alias("class"), F.col("y").alias("cost"), "i")


def ownership_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4 without hysteresis: class by class, free samples take their cheapest edge, and runs of two or more of one edge stay."""
    cand = _candidates(spark, sf_dir)
    owned = None
    for c in (1, 2, 3):
        free = cand.where(F.col("class") == c)
        if owned is not None:
            free = free.join(owned, ["user_id", "sample"], "left_anti")
        best = free.groupBy("user_id", "sample").agg(F.min_by("edge", F.struct("cost", "edge")).alias("edge"))
        w = Window.partitionBy("user_id", "edge").orderBy("sample")
        runs = best.withColumn("run", F.col("sample") - F.row_number().over(w))
        kept = runs.withColumn("n", F.count("*").over(Window.partitionBy("user_id", "edge", "run"))).where("n >= 2").select("user_id", "sample", "edge", F.lit(c).alias("class"))
        owned = kept if owned is None else owned.unionByName(kept)
    return owned


def ownership_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4 with hysteresis: the edge of the sample before costs 50 less; a sample without candidates forgets it."""
    cand = _candidates(spark, sf_dir).where("cost < 100").select(F.col("user_id").alias("part"), "sample", "edge", F.lit(1).alias("class"), "cost")
    return own(cand, bonus=50.0, least=1, classes=[1]).select(F.col("part").alias("user_id"), "sample", F.col("owner").alias("edge"))


def ownership_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K: maximal runs of one event type in each user's events."""
    return islands.run_table(points(spark, sf_dir), ["user_id"], ["i"], "i", "event_type").select("user_id", F.col("run").cast("long").alias("run"), "event_type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n")


def run_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: owners of runs of three or more rows."""
    return islands.gate(points(spark, sf_dir), ["user_id"], ["i"], "event_type", 3).select("event_id", "user_id", "kept")


def run_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between two rows of one type, two rows apart at most, becomes that type; the later start wins."""
    p = points(spark, sf_dir).withColumn("i", F.col("i").cast("long"))
    return islands.heal(p, ["user_id"], ["i"], "i", "event_type", 2).select("event_id", "user_id", "healed")


def continuity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive purchase runs of each user with the distance between their ends, by kind of gap."""
    p = points(spark, sf_dir)
    r = islands.run_table(p, ["user_id"], ["i"], "i", "event_type").where("event_type = 'purchase'")
    at = p.select("user_id", F.col("i").alias("j"), "x", "y")
    ends = r.join(at.withColumnRenamed("j", "start"), ["user_id", "start"]).withColumnsRenamed({"x": "sx", "y": "sy"}).withColumn("last", F.col("end") - 1).join(at.withColumnRenamed("j", "last"), ["user_id", "last"])
    w = Window.partitionBy("user_id").orderBy("start")
    pairs = ends.select("user_id", "start", "end", F.lead("start").over(w).alias("next_start"), F.hypot(F.lead("sx").over(w) - F.col("x"), F.lead("sy").over(w) - F.col("y")).alias("far")).where("next_start is not null")
    return pairs.select(
        "user_id", F.col("start").cast("long").alias("start"), F.col("next_start").cast("long").alias("next_start"), F.round("far", 3).alias("far"), (F.col("next_start") - F.col("end")).cast("long").alias("gap"),
        F.when(F.col("far") > 300, "unresolved-gap-too-long").when(F.col("far") > 20, "reference-and-topology-gap").otherwise("reference-gap").alias("kind"),
    )


def continuity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counters of the gaps by kind."""
    return continuity_gaps(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("gap") <= 2).alias("n_short"), F.sum("gap").alias("total_gap"))


def segment_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each polyline clipped to a box; the pieces of consecutive segments are one fragment."""
    s = segments(spark, sf_dir).select("user_id", "seg", (F.col("to") - F.col("from")).alias("size"), F.explode(F.array(g.clip(*map(F.col, ("x1", "y1", "x2", "y2")), 100.0, 20.0, 500.0, 120.0))).alias("c"))
    s = s.select("user_id", "seg", "size", F.col("c.t0").alias("t0"), F.col("c.t1").alias("t1")).where("t0 < t1")  # exploded: the clip is worked out once
    w = Window.partitionBy("user_id").orderBy("seg")
    joined = (F.lag("seg").over(w) == F.col("seg") - 1) & (F.lag("t1").over(w) == 1) & (F.col("t0") == 0)
    s = s.withColumn("fragment", F.sum((~F.coalesce(joined, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = (F.col("t1") - F.col("t0")) * F.col("size")
    return s.groupBy("user_id", "fragment").agg(F.count("*").alias("n_segments"), F.min("seg").cast("long").alias("first_seg"), F.round(F.sum(size), 3).alias("length")).withColumn("fragment", F.col("fragment").cast("long"))


def box_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a segment that meets a dragged box, touching included."""
    s = segments(spark, sf_dir).withColumn("c", g.clip(*map(F.col, ("x1", "y1", "x2", "y2")), 100.0, 30.0, 130.0, 60.0))
    return s.where("c is not null").groupBy("user_id").agg(F.count("*").alias("n_segments"))


def circle_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each polyline outside a circle, by quadratic cuts of its segments."""
    s = segments(spark, sf_dir)
    cx, cy, r = F.lit(360.0), F.lit(50.0), F.lit(60.0)
    dx, dy, fx, fy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x1") - cx, F.col("y1") - cy
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - r * r
    disc = b * b - 4 * a * c
    safe = F.when(a > 0, 2 * a).otherwise(1.0)
    lo, hi = F.greatest(F.lit(0.0), (-b - F.sqrt(F.greatest(disc, F.lit(0.0)))) / safe), F.least(F.lit(1.0), (-b + F.sqrt(F.greatest(disc, F.lit(0.0)))) / safe)
    inside = F.when((a > 0) & (disc > 0) & (hi > lo), hi - lo).otherwise(0.0)
    return s.withColumn("outside", (1 - inside) * F.sqrt(a)).groupBy("user_id").agg(F.round(F.sum("outside"), 3).alias("outside"), F.round(F.sum(F.sqrt(a)), 3).alias("whole"))


def line_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End point of the first 40 per cent of each polyline."""
    s = segments(spark, sf_dir)
    whole = s.groupBy("user_id").agg(F.max("to").alias("whole"))
    inside = s.join(whole, "user_id").withColumn("goal", F.col("whole") * 0.4).where("`from` <= goal and goal < `to`")
    t = (F.col("goal") - F.col("from")) / (F.col("to") - F.col("from"))
    return inside.select("user_id", F.col("seg").cast("long").alias("seg"), F.round(F.col("x1") + t * (F.col("x2") - F.col("x1")), 3).alias("x"), F.round(F.col("y1") + t * (F.col("y2") - F.col("y1")), 3).alias("y"))


def dominant_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of the main axis of each polyline's vertices, upright, and how straight it is."""
    p = points(spark, sf_dir).groupBy("user_id").agg(F.covar_pop("x", "x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("y", "y").alias("yy"), F.count("*").alias("n"))
    root = F.sqrt(F.pow(F.col("xx") - F.col("yy"), 2) + 4 * F.pow("xy", 2))
    total = F.col("xx") + F.col("yy")
    return p.where("n > 1").select("user_id", F.round(F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))) / 2, 3).alias("bearing"), F.round(F.when(total > 0, root / total).otherwise(1.0), 5).alias("straightness"))


def class_partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two classes inside a box, filters reaching the scan."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(10.0, 20.0) & F.col("l_extendedprice").between(1000.0, 30000.0))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("l_quantity").alias("w"), F.max("l_quantity").alias("e"), F.min("l_extendedprice").alias("s"), F.max("l_extendedprice").alias("north"))


def _matched(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every user's polyline as a reference part, matched to the others as atoms; the class is the day of its first event, at most 3."""
    segs = segments(spark, sf_dir)
    kind = points(spark, sf_dir).groupBy("user_id").agg(F.least(F.lit(3), F.floor(F.min("x") / 4).cast("int") + 1).alias("class"))
    atoms = cut(segs.join(kind, "user_id").select(F.col("user_id").alias("edge"), "class", "x1", "y1", "x2", "y2"))
    s = cut(polyline.samples(segs, "user_id", STEP).withColumnRenamed("user_id", "part").select("part", "sample", "x", "y", "tx", "ty").dropDuplicates(["part", "sample"]))
    first = cut(own(matching.contenders(s, atoms, RADIUS), matching.BONUS, matching.LEAST_RUN, [1, 2, 3]))
    owned = cut(matching.heal(matching.suppress(first, s, 5.0), s))  # each is read by several of the steps behind it
    runs = matching.owned_runs(owned, STEP)
    return {"owned": owned, "runs": runs, "gaps": matching.gaps(runs, STEP), "coverage": matching.coverage(s, owned)}


def match_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, ownership, suppression, healing and runs of every polyline."""
    return _matched(spark, sf_dir)["runs"]


def match_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owned share of each part."""
    return _matched(spark, sf_dir)["coverage"]


def match_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between runs with the decisions that need no path."""
    return _matched(spark, sf_dir)["gaps"]


QUERIES = {
    f.__name__: f
    for f in (
        traj_length, traj_bounds, traj_resample, traj_tangent, traj_residual_stats, traj_residual_filter, coverage_pct, uncovered_intervals, parallel_self_join, parallel_suppression,
        ownership_hierarchical, ownership_hysteresis, ownership_runs, run_gate, run_heal, continuity_gaps, continuity_summary, segment_clip, box_select, circle_clip, line_prefix, dominant_axis, class_partition_scan,
        match_runs, match_coverage, match_gaps,
    )
}

_NEAR = samples_sql(STEP) + f""",
ref AS (SELECT * FROM segs WHERE user_id = (SELECT min(user_id) FROM segs)),
near AS (
  SELECT s.user_id, s.sample, min(sqrt((s.x - (x1 + t * (x2 - x1))) ** 2 + (s.y - (y1 + t * (y2 - y1))) ** 2)) AS d FROM (
    SELECT s.*, r.x1, r.y1, r.x2, r.y2, CASE WHEN r.size = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((s.x - r.x1) * (r.x2 - r.x1) + (s.y - r.y1) * (r.y2 - r.y1)) / (r.size * r.size))) END AS t
    FROM samples s, ref r) s
  GROUP BY s.user_id, s.sample HAVING min(sqrt((s.x - (x1 + t * (x2 - x1))) ** 2 + (s.y - (y1 + t * (y2 - y1))) ** 2)) <= {RADIUS})"""

_STATS = _NEAR[: _NEAR.rindex(" HAVING")] + f"""),
lined AS (SELECT s.user_id, min({segment_gap(("s.x1", "s.y1", "s.x2", "s.y2"), ("r.x1", "r.y1", "r.x2", "r.y2"))}) AS gap FROM segs s, ref r GROUP BY s.user_id),
stats AS (
  SELECT user_id, count(*) AS n_samples, round(any_value(gap), 3) AS min_d, round(quantile_cont(d, 0.5), 3) AS median_d, round(quantile_cont(d, 0.9), 3) AS p90_d
  FROM near JOIN lined USING (user_id) WHERE gap <= {RADIUS} GROUP BY user_id)"""

_COVERED = _NEAR + """,
flags AS (SELECT s.user_id, s.sample, n.d IS NOT NULL AS hit FROM (SELECT DISTINCT user_id, sample FROM samples) s LEFT JOIN near n USING (user_id, sample))"""

_RUNS = POINTS + """,
marked AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY i) OR i = 0 THEN 1 ELSE 0 END AS new FROM pts),
numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS run FROM marked),
runs AS (SELECT user_id, run, any_value(event_type) AS event_type, min(i) AS "start", max(i) + 1 AS "end", count(*) AS n FROM numbered GROUP BY user_id, run)"""

_GAPS = _RUNS + """,
ends AS (
  SELECT r.user_id, r."start", r."end", a.x AS sx, a.y AS sy, b.x, b.y FROM runs r
  JOIN pts a ON a.user_id = r.user_id AND a.i = r."start" JOIN pts b ON b.user_id = r.user_id AND b.i = r."end" - 1 WHERE r.event_type = 'purchase'),
pairs AS (
  SELECT user_id, "start", "end", lead("start") OVER w AS next_start, sqrt((lead(sx) OVER w - x) ** 2 + (lead(sy) OVER w - y) ** 2) AS far FROM ends WINDOW w AS (PARTITION BY user_id ORDER BY "start")),
gaps AS (
  SELECT user_id, "start", next_start, round(far, 3) AS far, next_start - "end" AS gap,
    CASE WHEN far > 300 THEN 'unresolved-gap-too-long' WHEN far > 20 THEN 'reference-and-topology-gap' ELSE 'reference-gap' END AS kind FROM pairs WHERE next_start IS NOT NULL)"""


def _ownership_sql() -> str:
    parts = [POINTS, "cand AS (SELECT user_id, i // 3 AS sample, event_type AS edge, k % 3 + 1 AS class, y AS cost FROM pts)", "own0 AS (SELECT user_id, sample, edge, 0 AS class FROM cand WHERE false)"]
    for c in (1, 2, 3):
        parts += [
            f"best{c} AS (SELECT user_id, sample, arg_min(edge, (cost, edge)) AS edge FROM cand WHERE class = {c} AND NOT EXISTS (SELECT 1 FROM own{c - 1} o WHERE o.user_id = cand.user_id AND o.sample = cand.sample) GROUP BY user_id, sample)",
            f"run{c} AS (SELECT *, sample - row_number() OVER (PARTITION BY user_id, edge ORDER BY sample) AS run FROM best{c})",
            f"own{c} AS (SELECT * FROM own{c - 1} UNION ALL SELECT user_id, sample, edge, {c} FROM (SELECT *, count(*) OVER (PARTITION BY user_id, edge, run) AS n FROM run{c}) WHERE n >= 2)",
        ]
    return "WITH " + ",\n".join(parts) + "\nSELECT user_id, sample, edge, class FROM own3"


ORACLE = {
    "traj_length": f"WITH {SEGMENTS} SELECT p.user_id, p.n AS n_vertices, round(coalesce(s.length, 0), 4) AS length FROM (SELECT user_id, count(*) AS n FROM pts GROUP BY user_id) p LEFT JOIN (SELECT user_id, sum(size) AS length FROM segs GROUP BY user_id) s USING (user_id)",
    "traj_bounds": f"WITH {POINTS} SELECT user_id, round(min(x), 6) AS w, min(y) AS s, round(max(x), 6) AS e, max(y) AS n FROM pts GROUP BY user_id",
    "traj_resample": f"WITH {samples_sql(STEP)} SELECT user_id, sample, round(chain, 3) AS chain, round(x, 3) AS x, round(y, 3) AS y FROM samples",
    "traj_tangent": f"""WITH {samples_sql(STEP)},
pairs AS (SELECT user_id, tx, ty, lead(tx) OVER w AS ux, lead(ty) OVER w AS uy FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY sample, chain)),
sized AS (SELECT *, sqrt(tx ** 2 + ty ** 2) * sqrt(ux ** 2 + uy ** 2) AS whole, tx * ux + ty * uy AS dot FROM pairs WHERE ux IS NOT NULL)
SELECT user_id, round(avg(CASE WHEN whole = 0 THEN 180.0 ELSE degrees(acos(greatest(-1.0, least(1.0, dot / whole)))) END), 4) AS mean_turn,
  round(max(CASE WHEN whole = 0 THEN 90.0 ELSE degrees(acos(least(1.0, abs(dot) / whole))) END), 4) AS max_angle, count(*) AS n FROM sized GROUP BY user_id""",
    "traj_residual_stats": f"WITH {_STATS} SELECT * FROM stats",
    "traj_residual_filter": f"WITH {_STATS} SELECT user_id, median_d, p90_d FROM stats WHERE median_d <= {MEDIAN} AND p90_d <= {P90}",
    "coverage_pct": f"WITH {_COVERED} SELECT user_id, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) * 100, 3) AS covered_pct, count(*) AS n_samples FROM flags GROUP BY user_id",
    "uncovered_intervals": f"""WITH {_COVERED},
g AS (SELECT *, sample - row_number() OVER (PARTITION BY user_id ORDER BY sample) AS g FROM flags WHERE NOT hit)
SELECT user_id, min(sample) AS "start", max(sample) + 1 AS "end" FROM g GROUP BY user_id, g HAVING count(*) >= 2""",
    "parallel_self_join": f"""WITH {samples_sql(STEP)}
SELECT a.user_id, b.user_id AS other, count(*) AS n_close, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 4) AS min_d FROM samples a JOIN samples b
ON a.user_id < b.user_id AND a.x BETWEEN b.x - 1 AND b.x + 1 AND a.y BETWEEN b.y - 1 AND b.y + 1 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.0
  AND CASE WHEN sqrt(a.tx ** 2 + a.ty ** 2) * sqrt(b.tx ** 2 + b.ty ** 2) = 0 THEN 90.0 ELSE degrees(acos(least(1.0, abs(a.tx * b.tx + a.ty * b.ty) / (sqrt(a.tx ** 2 + a.ty ** 2) * sqrt(b.tx ** 2 + b.ty ** 2))))) END <= 55
GROUP BY 1, 2""",
    "parallel_suppression": f"""WITH {samples_sql(STEP)},
masked AS (SELECT DISTINCT a.user_id, a.sample FROM samples a JOIN samples b ON a.user_id <> b.user_id AND b.user_id % 3 < a.user_id % 3
  AND a.x BETWEEN b.x - 4 AND b.x + 4 AND a.y BETWEEN b.y - 4 AND b.y + 4 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 4.0),
g AS (SELECT *, sample - row_number() OVER (PARTITION BY user_id ORDER BY sample) AS g FROM masked)
SELECT user_id, min(sample) AS "start", max(sample) + 1 AS "end" FROM g GROUP BY user_id, g HAVING count(*) >= 3""",
    "ownership_hierarchical": _ownership_sql(),
    "ownership_hysteresis": f"""WITH RECURSIVE {POINTS},
cand AS (SELECT user_id, i // 3 AS sample, event_type AS edge, min(y) AS cost FROM pts WHERE y < 100 GROUP BY ALL),
every AS (SELECT DISTINCT user_id, i // 3 AS sample FROM pts),
filled AS (SELECT e.user_id, e.sample, c.edge, c.cost FROM every e LEFT JOIN cand c USING (user_id, sample)),
walk AS (
  SELECT user_id, CAST(-1 AS BIGINT) AS sample, CAST(NULL AS VARCHAR) AS edge FROM every WHERE sample = 0
  UNION ALL
  SELECT f.user_id, f.sample, arg_min(f.edge, (f.cost - CASE WHEN f.edge IS NOT DISTINCT FROM w.edge THEN 50.0 ELSE 0.0 END, f.edge)) AS edge
  FROM walk w JOIN filled f ON f.user_id = w.user_id AND f.sample = w.sample + 1 GROUP BY f.user_id, f.sample)
SELECT user_id, sample, edge FROM walk WHERE edge IS NOT NULL""",
    "ownership_runs": f'WITH {_RUNS} SELECT user_id, run, event_type, "start", "end", n FROM runs',
    "run_gate": f"WITH {_RUNS} SELECT event_id, user_id, CASE WHEN count(*) OVER (PARTITION BY user_id, run) >= 3 THEN event_type END AS kept FROM numbered",
    "run_heal": f"""WITH {POINTS},
nxt AS (SELECT user_id, i, event_type, lead(i) OVER (PARTITION BY user_id, event_type ORDER BY i) AS n FROM pts WHERE event_type IS NOT NULL),
fill AS (SELECT user_id, unnest(generate_series(i + 1, n - 1)) AS i, i AS origin, event_type FROM nxt WHERE n - i > 1 AND n - i - 1 <= 2),
best AS (SELECT user_id, i, arg_max(event_type, (origin, event_type)) AS f FROM fill GROUP BY user_id, i)
SELECT event_id, p.user_id, coalesce(f, event_type) AS healed FROM pts p LEFT JOIN best USING (user_id, i)""",
    "continuity_gaps": f"WITH {_GAPS} SELECT * FROM gaps",
    "continuity_summary": f"WITH {_GAPS} SELECT kind, count(*) AS n, count(*) FILTER (WHERE gap <= 2) AS n_short, CAST(sum(gap) AS BIGINT) AS total_gap FROM gaps GROUP BY kind",
    "dominant_axis": f"""WITH {POINTS}, c AS (SELECT user_id, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, count(*) AS n FROM pts GROUP BY user_id)
SELECT user_id, round(degrees(atan2(2 * xy, xx - yy)) / 2, 3) AS bearing, round(CASE WHEN xx + yy > 0 THEN sqrt((xx - yy) ** 2 + 4 * xy ** 2) / (xx + yy) ELSE 1.0 END, 5) AS straightness FROM c WHERE n > 1""",
    "line_prefix": f"""WITH {SEGMENTS}, w AS (SELECT user_id, max("to") * 0.4 AS goal FROM segs GROUP BY user_id)
SELECT user_id, seg, round(x1 + (goal - "from") / ("to" - "from") * (x2 - x1), 3) AS x, round(y1 + (goal - "from") / ("to" - "from") * (y2 - y1), 3) AS y FROM segs JOIN w USING (user_id) WHERE "from" <= goal AND goal < "to" """,
    "circle_clip": f"""WITH {SEGMENTS},
q AS (SELECT user_id, (x2 - x1) ** 2 + (y2 - y1) ** 2 AS a, 2 * ((x1 - 360) * (x2 - x1) + (y1 - 50) * (y2 - y1)) AS b, (x1 - 360) ** 2 + (y1 - 50) ** 2 - 3600 AS c FROM segs),
r AS (SELECT *, b * b - 4 * a * c AS disc FROM q),
t AS (SELECT user_id, a, disc, greatest(0.0, (-b - sqrt(greatest(disc, 0))) / CASE WHEN a > 0 THEN 2 * a ELSE 1 END) AS lo, least(1.0, (-b + sqrt(greatest(disc, 0))) / CASE WHEN a > 0 THEN 2 * a ELSE 1 END) AS hi FROM r)
SELECT user_id, round(sum((1 - CASE WHEN a > 0 AND disc > 0 AND hi > lo THEN hi - lo ELSE 0 END) * sqrt(a)), 3) AS outside, round(sum(sqrt(a)), 3) AS whole FROM t GROUP BY user_id""",
    "class_partition_scan": "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS w, max(l_quantity) AS e, min(l_extendedprice) AS s, max(l_extendedprice) AS north FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 1000 AND 30000 GROUP BY l_returnflag",
}


def _clip_sql(w: float, s: float, e: float, n: float) -> str:
    return SEGMENTS + f""",
deltas AS (SELECT *, [x2 - x1, x1 - x2, y2 - y1, y1 - y2] AS d, [x1 - {w}, {e} - x1, y1 - {s}, {n} - y1] AS q FROM segs),
bounded AS (SELECT *,
  greatest(0.0, CASE WHEN d[1] > 0 THEN -q[1] / d[1] ELSE 0 END, CASE WHEN d[2] > 0 THEN -q[2] / d[2] ELSE 0 END, CASE WHEN d[3] > 0 THEN -q[3] / d[3] ELSE 0 END, CASE WHEN d[4] > 0 THEN -q[4] / d[4] ELSE 0 END) AS t0,
  least(1.0, CASE WHEN d[1] < 0 THEN -q[1] / d[1] ELSE 1 END, CASE WHEN d[2] < 0 THEN -q[2] / d[2] ELSE 1 END, CASE WHEN d[3] < 0 THEN -q[3] / d[3] ELSE 1 END, CASE WHEN d[4] < 0 THEN -q[4] / d[4] ELSE 1 END) AS t1,
  (d[1] = 0 AND q[1] < 0) OR (d[2] = 0 AND q[2] < 0) OR (d[3] = 0 AND q[3] < 0) OR (d[4] = 0 AND q[4] < 0) AS misses FROM deltas),
clipped AS (SELECT * FROM bounded WHERE NOT misses AND t0 <= t1)"""


ORACLE |= {
    "segment_clip": f"""WITH {_clip_sql(100.0, 20.0, 500.0, 120.0)},
inbox AS (SELECT * FROM clipped WHERE t0 < t1),
marked AS (SELECT *, CASE WHEN lag(seg) OVER w = seg - 1 AND lag(t1) OVER w = 1 AND t0 = 0 THEN 0 ELSE 1 END AS new FROM inbox WINDOW w AS (PARTITION BY user_id ORDER BY seg)),
numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY seg) AS BIGINT) AS fragment FROM marked)
SELECT user_id, fragment, count(*) AS n_segments, min(seg) AS first_seg, round(sum((t1 - t0) * ("to" - "from")), 3) AS length FROM numbered GROUP BY user_id, fragment""",
    "box_select": f"WITH {_clip_sql(100.0, 30.0, 130.0, 60.0)} SELECT user_id, count(*) AS n_segments FROM clipped GROUP BY user_id",
}
