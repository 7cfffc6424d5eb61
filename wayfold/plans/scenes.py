"""Queries over timelines and shapes: compilation and evaluation in time, rings, arcs and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators import relations
from wayfold.plans.tables import hours, points, table

FPS = 2


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as stories: a turn is a step that lasts a tenth of a second a character; users show an item, others hide one."""
    c = table(spark, sf_dir, "conversations")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return c.select("conv_id", "turn", (n * 100).alias("duration"), F.when(F.col("role") == "user", "show").otherwise("hide").alias("action"), (n % 5).alias("item"))


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _steps(spark, sf_dir).withColumn("start_ms", F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def timeline_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each step starts and ends."""
    return _timeline(spark, sf_dir).select("conv_id", "turn", "action", "start_ms", (F.col("start_ms") + F.col("duration")).alias("end_ms"))


def timeline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A.4: what is visible at the end of each story: items whose last action shows them, in the order of that step."""
    last = _steps(spark, sf_dir).groupBy("conv_id", "item").agg(F.max_by(F.struct("action", "turn"), F.col("turn")).alias("s"))
    shown = last.where("s.action = 'show'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("s.turn", "item"))).alias("v"))
    every = _steps(spark, sf_dir).select("conv_id").distinct()
    return every.join(shown, "conv_id", "left").select("conv_id", F.coalesce(F.array_join(F.transform("v", lambda x: x["item"].cast("string")), ","), F.lit("")).alias("visible"))


def cue_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each step the next and the previous distinct start."""
    at = _timeline(spark, sf_dir).select("conv_id", "start_ms").distinct()
    w = Window.partitionBy("conv_id").orderBy("start_ms")
    return at.select("conv_id", "start_ms", F.lead("start_ms").over(w).alias("next_ms"), F.lag("start_ms").over(w).alias("previous_ms"))


def frame_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of each story, one at least, with the step on screen."""
    t = _timeline(spark, sf_dir)
    whole = t.groupBy("conv_id").agg(F.sum("duration").alias("ms"))
    frames = whole.select("conv_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("ms") * FPS / 1000)) - 1)).alias("frame")).withColumn("at_ms", F.floor(F.col("frame") * 1000 / FPS))
    both = frames.select("conv_id", "at_ms", F.lit(None).cast(t.schema["turn"].dataType).alias("turn"), "frame").unionByName(t.select("conv_id", F.col("start_ms").alias("at_ms"), "turn", F.lit(None).cast("long").alias("frame")))
    w = Window.partitionBy("conv_id").orderBy("at_ms", F.col("frame").isNotNull(), "turn").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("step", F.last("turn", ignorenulls=True).over(w)).where("frame is not null").groupBy("conv_id", "step").agg(F.count("*").alias("n_frames"), F.min("frame").alias("first_frame"))


def timeline_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event at the start of every day, by one window over events and ticks."""
    e = table(spark, sf_dir, "events").select("user_id", hours().alias("x"), "event_id", "event_type", F.lit(None).cast("int").alias("day"))
    ticks = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("day"))
    both = e.unionByName(ticks.select("user_id", (F.col("day") * 24.0).alias("x"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"), "day"))
    w = Window.partitionBy("user_id").orderBy("x", F.col("day").isNotNull(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    state = both.withColumn("event_id", F.last("event_id", ignorenulls=True).over(w)).withColumn("event_type", F.last("event_type", ignorenulls=True).over(w))
    return state.where("day is not null").select("user_id", "day", "event_id", "event_type")


def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each whole hour the latest-started interval that is active; an event lasts as many minutes as its value."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", hours().alias("from"), (hours() + F.col("value") / 60).alias("to"))
    hit = e.where(F.ceil("from") <= F.ceil("to") - 1).withColumn("hour", F.explode(F.sequence(F.ceil("from"), F.ceil("to") - 1)))
    return hit.groupBy("user_id", "hour").agg(F.max_by("event_id", F.struct("from", "event_id")).alias("event_id"), F.count("*").alias("n_active"))


def _turned(a: Column, b: Column, p: Column) -> Column:
    """A bearing on the shorter way from a to b; the remainder keeps its sign."""
    return a + ((b - a + 540) % 360 - 180) * p


def camera_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera a quarter of the way between events, eased out by a cube, bearings on the shorter way."""
    w = Window.partitionBy("user_id").orderBy("i")
    p = points(spark, sf_dir).select("event_id", "user_id", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    eased = F.lit(1 - 0.75**3)
    return p.select("event_id", F.round(F.col("x") + (F.col("x2") - F.col("x")) * eased, 8).alias("center"), F.round(_turned(F.col("y"), F.col("y2"), eased), 8).alias("bearing"))


def easing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothstep cover over 550, 500 and 550 ms, and emphasis that starts at .25 and ends at .7."""
    t = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 37) % 1600).cast("double").alias("ms"))
    smooth = lambda u: u * u * (3 - 2 * u)
    clamp = lambda u: F.greatest(F.lit(0.0), F.least(F.lit(1.0), u))
    cover = F.when(F.col("ms") < 550, smooth(F.col("ms") / 550)).when(F.col("ms") < 1050, F.lit(1.0)).otherwise(1 - smooth(clamp((F.col("ms") - 1050) / 550)))
    q = F.col("ms") / 1600
    u = clamp((q - 0.25) / 0.45)
    basemap = clamp((q - 0.38) / 0.24)
    return t.select("event_id", F.round(cover, 6).alias("cover"), F.round(F.when(q < 0.25, 0.0).when(q < 0.7, 1 - F.pow(1 - u, 3)).otherwise(1.0), 6).alias("emphasis"), F.round(basemap, 6).alias("basemap"))


def focus_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at which a user's selection changes to one that has something to show."""
    w = Window.partitionBy("user_id").orderBy("i")
    p = points(spark, sf_dir).withColumn("before", F.lag("event_type").over(w))
    return p.where((F.col("event_type") != "error") & (~F.col("event_type").eqNullSafe(F.col("before")))).groupBy("user_id").agg(F.count("*").alias("n_changes"), F.min("i").cast("long").alias("first"))


def scene_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding that the kinds of visible items ask for, capped at 42 per cent of the height."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", 100).when(F.col("event_type") == "purchase", 160).when(F.col("event_type") == "click", 60).otherwise(40)).alias("asked"), F.max("value").alias("height"))
    return e.select("user_id", F.round(F.least(F.col("asked").cast("double"), F.col("height") * 0.42), 4).alias("padding"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an embedding's numbers as the vertices of a ring."""
    e = table(spark, sf_dir, "embeddings")
    n = F.size("embedding") / 2
    ring = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: g.vertex(F.get("embedding", i * 2), F.get("embedding", i * 2 + 1)))
    return e.select("vec_id", "label", ring.alias("ring"))


def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each ring."""
    return _rings(spark, sf_dir).select("vec_id", F.round(F.abs(g.signed_area(F.col("ring"))), 6).alias("area"))


def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the vertices, and bounds."""
    r = _rings(spark, sf_dir).select("vec_id", g.mean_vertex(F.col("ring")).alias("c"), g.bounds(F.col("ring")).alias("b"))
    return r.select("vec_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.round("b.w", 6).alias("w"), F.round("b.n", 6).alias("n"))


def point_in_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mean of its vertices lies inside each ring."""
    r = _rings(spark, sf_dir).withColumn("c", g.mean_vertex(F.col("ring")))
    return r.select("vec_id", g.point_in_ring(F.col("c.x"), F.col("c.y"), F.col("ring")).alias("inside"))


def line_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each ring as an open line and the distance of its ends."""
    r = _rings(spark, sf_dir)
    a, b = F.element_at("ring", 1), F.element_at("ring", -1)
    return r.select("vec_id", F.round(g.length(F.col("ring")), 5).alias("length"), F.round(F.hypot(b["x"] - a["x"], b["y"] - a["y"]), 5).alias("chord"))


def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors of each label have bounds that meet, and cover, a box."""
    box = F.struct(F.lit(-0.2).alias("w"), F.lit(0.1).alias("s"), F.lit(0.2).alias("e"), F.lit(0.25).alias("n"))
    r = _rings(spark, sf_dir).withColumn("b", g.bounds(F.col("ring")))
    return r.groupBy("label").agg(F.count_if(g.bbox_overlaps(F.col("b"), box)).alias("n_meet"), F.count_if(g.bbox_covers(F.col("b"), box)).alias("n_cover"), F.count("*").alias("n"))


def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs of quantised deltas, summed up, scaled and shifted; the end of each arc and its farthest west."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v * F.lit(1000).cast("float")).cast("long")).alias("d"))  # an int factor would make doubles of the floats
    steps = F.transform(F.sequence(F.lit(0), (F.size("d") / 2).cast("int") - 1), lambda i: F.struct(F.get("d", i * 2).alias("x"), F.get("d", i * 2 + 1).alias("y")))
    empty = F.expr("cast(array() as array<struct<x: bigint, y: bigint>>)")
    sums = F.aggregate(steps, empty, lambda line, s: F.concat(line, F.array(F.struct((F.coalesce(F.try_element_at(line, F.lit(-1))["x"], F.lit(0)) + s["x"]).alias("x"), (F.coalesce(F.try_element_at(line, F.lit(-1))["y"], F.lit(0)) + s["y"]).alias("y")))))
    last = F.element_at("arc", -1)
    return e.select("vec_id", sums.alias("arc")).select("vec_id", F.round(last["x"] * 0.01 + 139, 6).alias("x"), F.round(last["y"] * 0.01 + 35, 6).alias("y"), F.array_min(F.transform("arc", lambda p: p["x"])).alias("west"))


def label_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest ring of each label, the smaller id among equals."""
    r = _rings(spark, sf_dir).select("label", "vec_id", F.round(F.abs(g.signed_area(F.col("ring"))), 6).alias("area"))
    return relations.best(r, ["label"], [F.desc("area"), "vec_id"])


def mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web mercator metres to degrees."""
    c = table(spark, sf_dir, "customer").select("c_custkey", g.mercator_to_wgs84(F.col("c_custkey") * 1000.0, F.col("c_acctbal") * 500.0).alias("p"))
    return c.select("c_custkey", F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"))


def circle_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of 64 steps around suppliers, with the area of the mask that they leave of a square."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 1000 + 1).alias("r"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: g.vertex(F.col("r") * F.cos(i * 2 * 3.141592653589793 / 64), F.col("r") * F.sin(i * 2 * 3.141592653589793 / 64)))
    return s.withColumn("ring", ring).select("s_suppkey", F.round(g.signed_area(F.col("ring")), 4).alias("area"), F.round(F.lit(400.0) - F.abs(g.signed_area(F.col("ring"))), 4).alias("mask_area"))


def depth_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in order of the depth of their kind; a rank stands for the order."""
    depth = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "PROMO", 1).otherwise(2)
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", depth.alias("depth"))
    w = Window.partitionBy("p_brand").orderBy("depth", "p_partkey")
    return p.select("p_partkey", "depth", F.row_number().over(w).cast("long").alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (
        timeline_compile, timeline_state, cue_navigation, frame_enumerate, timeline_evaluate, interval_lookup, camera_interpolate, easing, focus_change, scene_fit, ring_area, centroid, point_in_ring, line_length, bbox_overlap,
        delta_decode, label_top1, mercator, circle_ring, depth_order,
    )
}

_STEPS = """steps AS (SELECT conv_id, turn, CAST(coalesce(length(text), 0) AS BIGINT) * 100 AS duration, CASE WHEN role = 'user' THEN 'show' ELSE 'hide' END AS action, CAST(coalesce(length(text), 0) AS BIGINT) % 5 AS item FROM conversations),
timeline AS (SELECT *, CAST(coalesce(sum(duration) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM steps)"""
_POINTS = "p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600000000.0 AS x, value AS y, event_type, event_id FROM events)"
_RINGS = """v AS (SELECT vec_id, label, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y, len(embedding) // 2 AS n
  FROM (SELECT vec_id, label, embedding, unnest(range(0, len(embedding) // 2)) AS i FROM embeddings)),
e AS (SELECT a.*, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % a.n),
areas AS (SELECT vec_id, any_value(label) AS label, round(abs(sum(x * y2 - x2 * y) / 2), 6) AS area FROM e GROUP BY vec_id)"""
_SMOOTH = "({0}) * ({0}) * (3 - 2 * ({0}))"

ORACLE = {
    "timeline_compile": f"WITH {_STEPS} SELECT conv_id, turn, action, start_ms, start_ms + duration AS end_ms FROM timeline",
    "timeline_state": f"""WITH {_STEPS}, l AS (SELECT conv_id, item, arg_max(action, turn) AS action, max(turn) AS turn FROM steps GROUP BY conv_id, item),
g AS (SELECT conv_id, string_agg(item, ',' ORDER BY turn, item) AS visible FROM l WHERE action = 'show' GROUP BY conv_id)
SELECT conv_id, coalesce(visible, '') AS visible FROM (SELECT DISTINCT conv_id FROM steps) LEFT JOIN g USING (conv_id)""",
    "cue_navigation": f"WITH {_STEPS} SELECT conv_id, start_ms, lead(start_ms) OVER w AS next_ms, lag(start_ms) OVER w AS previous_ms FROM (SELECT DISTINCT conv_id, start_ms FROM timeline) WINDOW w AS (PARTITION BY conv_id ORDER BY start_ms)",
    "frame_enumerate": f"""WITH {_STEPS}, w AS (SELECT conv_id, greatest(1, CAST(ceil(sum(duration) * {FPS} / 1000.0) AS BIGINT)) AS n FROM timeline GROUP BY conv_id),
f AS (SELECT conv_id, unnest(range(0, n)) AS frame FROM w),
s AS (SELECT f.conv_id, frame, arg_max(turn, (start_ms, turn)) AS step FROM f JOIN timeline t ON t.conv_id = f.conv_id AND t.start_ms <= frame * 1000 // {FPS} GROUP BY 1, 2)
SELECT conv_id, step, count(*) AS n_frames, min(frame) AS first_frame FROM s GROUP BY 1, 2""",
    "timeline_evaluate": f"""WITH {_POINTS}, ticks AS (SELECT user_id, CAST(unnest(range(1, 31)) AS INTEGER) AS day FROM (SELECT DISTINCT user_id FROM events))
SELECT t.user_id, t.day, e.event_id, e.event_type FROM ticks t LEFT JOIN LATERAL (SELECT event_id, event_type FROM p WHERE p.user_id = t.user_id AND p.x <= t.day * 24.0 ORDER BY p.x DESC, p.event_id DESC LIMIT 1) e ON true""",
    "interval_lookup": f"""WITH {_POINTS}, h AS (SELECT user_id, event_id, x AS lo, unnest(generate_series(CAST(ceil(x) AS BIGINT), CAST(ceil(x + y / 60) AS BIGINT) - 1)) AS hour FROM p)
SELECT user_id, hour, arg_max(event_id, (lo, event_id)) AS event_id, count(*) AS n_active FROM h GROUP BY 1, 2""",
    "camera_interpolate": f"""WITH {_POINTS}, q AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT event_id, round(x + (x2 - x) * {1 - 0.75**3}, 8) AS center, round(y + ((y2 - y + 540) % 360 - 180) * {1 - 0.75**3}, 8) AS bearing FROM q WHERE x2 IS NOT NULL""",
    "easing": f"""WITH t AS (SELECT event_id, CAST((event_id * 37) % 1600 AS DOUBLE) AS ms FROM events), u AS (SELECT *, ms / 1600 AS q, greatest(0.0, least(1.0, (ms / 1600 - 0.25) / 0.45)) AS u FROM t)
SELECT event_id, round(CASE WHEN ms < 550 THEN {_SMOOTH.format('ms / 550')} WHEN ms < 1050 THEN 1.0 ELSE 1 - {_SMOOTH.format('greatest(0.0, least(1.0, (ms - 1050) / 550))')} END, 6) AS cover,
  round(CASE WHEN q < 0.25 THEN 0.0 WHEN q < 0.7 THEN 1 - (1 - u) ** 3 ELSE 1.0 END, 6) AS emphasis, round(greatest(0.0, least(1.0, (q - 0.38) / 0.24)), 6) AS basemap FROM u""",
    "focus_change": f"""WITH {_POINTS}, q AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY i) AS before FROM p)
SELECT user_id, count(*) AS n_changes, min(i) AS first FROM q WHERE event_type <> 'error' AND event_type IS DISTINCT FROM before GROUP BY user_id""",
    "scene_fit": "SELECT user_id, round(least(CAST(max(CASE event_type WHEN 'view' THEN 100 WHEN 'purchase' THEN 160 WHEN 'click' THEN 60 ELSE 40 END) AS DOUBLE), max(value) * 0.42), 4) AS padding FROM events GROUP BY user_id",
    "ring_area": f"WITH {_RINGS} SELECT vec_id, area FROM areas",
    "centroid": f"WITH {_RINGS} SELECT vec_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(min(x), 6) AS w, round(max(y), 6) AS n FROM v GROUP BY vec_id",
    "point_in_ring": f"""WITH {_RINGS}, c AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy FROM v GROUP BY vec_id)
SELECT vec_id, count(*) FILTER (WHERE (y > cy) <> (y2 > cy) AND cx < (x2 - x) * (cy - y) / (y2 - y) + x) % 2 = 1 AS inside FROM e JOIN c USING (vec_id) GROUP BY vec_id""",
    "line_length": f"""WITH {_RINGS} SELECT vec_id, round(sum(CASE WHEN i < n - 1 THEN sqrt((x2 - x) ** 2 + (y2 - y) ** 2) ELSE 0 END), 5) AS length, round(sum(CASE WHEN i = n - 1 THEN sqrt((x2 - x) ** 2 + (y2 - y) ** 2) ELSE 0 END), 5) AS chord FROM e GROUP BY vec_id""",
    "bbox_overlap": f"""WITH {_RINGS}, b AS (SELECT vec_id, any_value(label) AS label, min(x) AS w, min(y) AS s, max(x) AS ea, max(y) AS n FROM v GROUP BY vec_id)
SELECT label, count(*) FILTER (WHERE NOT (ea < -0.2 OR 0.2 < w OR n < 0.1 OR 0.25 < s)) AS n_meet, count(*) FILTER (WHERE w <= -0.2 + 1e-7 AND s <= 0.1 + 1e-7 AND ea >= 0.2 - 1e-7 AND n >= 0.25 - 1e-7) AS n_cover, count(*) AS n FROM b GROUP BY label""",
    "delta_decode": """WITH v AS (SELECT vec_id, i, CAST(round(embedding[2 * i + 1] * CAST(1000 AS FLOAT)) AS BIGINT) AS dx, CAST(round(embedding[2 * i + 2] * CAST(1000 AS FLOAT)) AS BIGINT) AS dy FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 2)) AS i FROM embeddings)),
s AS (SELECT vec_id, CAST(sum(dx) OVER (PARTITION BY vec_id ORDER BY i) AS BIGINT) AS x, CAST(sum(dy) OVER (PARTITION BY vec_id) AS BIGINT) AS ty, CAST(sum(dx) OVER (PARTITION BY vec_id) AS BIGINT) AS tx FROM v)
SELECT vec_id, round(any_value(tx) * 0.01::DOUBLE + 139, 6) AS x, round(any_value(ty) * 0.01::DOUBLE + 35, 6) AS y, min(x) AS west FROM s GROUP BY vec_id""",
    "label_top1": f"WITH {_RINGS} SELECT label, vec_id, area FROM areas QUALIFY row_number() OVER (PARTITION BY label ORDER BY area DESC, vec_id) = 1",
    "mercator": "SELECT c_custkey, round(degrees(c_custkey * 1000.0 / 6378137.0), 7) AS lon, round(degrees(2 * atan(exp(c_acctbal * 500.0 / 6378137.0)) - 3.141592653589793 / 2), 7) AS lat FROM customer",
    "circle_ring": """WITH r AS (SELECT s_suppkey, abs(s_acctbal) / 1000 + 1 AS r FROM supplier), a AS (SELECT s_suppkey, r * r * 32 * sin(2 * 3.141592653589793 / 64) AS area FROM r)
SELECT s_suppkey, round(area, 4) AS area, round(400.0 - area, 4) AS mask_area FROM a""",
    "depth_order": "SELECT p_partkey, depth, row_number() OVER (PARTITION BY p_brand ORDER BY depth, p_partkey) AS rank FROM (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'PROMO' THEN 1 ELSE 2 END AS depth FROM part)",
}
