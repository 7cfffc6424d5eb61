"""Tables that the queries share, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import polyline
from wayfold.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours(ts: str = "ts"):
    """Hours since the year's start, exact to the microsecond."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {ts}) / 3600000000.0D")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the vertices of one polyline a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("i"), hours().alias("x"), F.col("value").alias("y"), "event_type", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.segments(points(spark, sf_dir), "user_id", ["i"])


POINTS = """pts AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600000000.0 AS x, value AS y, event_type, event_id,
    CAST(props->>'$.k' AS INTEGER) AS k FROM events)"""

SEGMENTS = POINTS + """,
ends AS (
  SELECT user_id, i AS seg, x AS x1, y AS y1, lead(x) OVER (PARTITION BY user_id ORDER BY i) AS x2, lead(y) OVER (PARTITION BY user_id ORDER BY i) AS y2 FROM pts),
segs AS (
  SELECT *, "to" - size AS "from" FROM (
    SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS size, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) OVER (PARTITION BY user_id ORDER BY seg) AS "to"
    FROM ends WHERE x2 IS NOT NULL))"""


def samples_sql(step: float) -> str:
    return SEGMENTS + f""",
spread AS (
  SELECT *, unnest(generate_series(CAST(ceil("from" / {step}) AS BIGINT), CAST(ceil("to" / {step}) AS BIGINT))) AS sample FROM segs WHERE "from" < "to"),
placed AS (
  SELECT *, sample * {step} AS chain FROM spread WHERE sample * {step} >= "from" AND sample * {step} < "to"
  UNION ALL
  SELECT s.*, CAST(ceil(s."to" / {step}) AS BIGINT) AS sample, s."to" AS chain FROM segs s JOIN (SELECT user_id, max(seg) AS seg FROM segs GROUP BY user_id) USING (user_id, seg)),
samples AS (
  SELECT user_id, sample, chain, x1 + t * (x2 - x1) AS x, y1 + t * (y2 - y1) AS y, (x2 - x1) / whole AS tx, (y2 - y1) / whole AS ty FROM (
    SELECT *, CASE WHEN "to" - "from" > 0 THEN (chain - "from") / ("to" - "from") ELSE 1.0 END AS t, CASE WHEN "to" - "from" > 0 THEN "to" - "from" ELSE 1.0 END AS whole FROM placed))"""


def segment_gap(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> str:
    """SQL for the distance of two segments, each by the names of x1, y1, x2, y2: 0 where they cross, else the least of an end to the other."""

    def side(s: tuple[str, str, str, str], x: str, y: str) -> str:
        return f"(({s[2]} - {s[0]}) * ({y} - {s[1]}) - ({s[3]} - {s[1]}) * ({x} - {s[0]}))"

    def far(x: str, y: str, s: tuple[str, str, str, str]) -> str:
        dx, dy = f"({s[2]} - {s[0]})", f"({s[3]} - {s[1]})"
        t = f"coalesce(greatest(0.0, least(1.0, (({x} - {s[0]}) * {dx} + ({y} - {s[1]}) * {dy}) / nullif({dx} ** 2 + {dy} ** 2, 0))), 0.0)"
        return f"sqrt(({x} - {s[0]} - {t} * {dx}) ** 2 + ({y} - {s[1]} - {t} * {dy}) ** 2)"

    cross = f"{side(a, b[0], b[1])} * {side(a, b[2], b[3])} < 0 AND {side(b, a[0], a[1])} * {side(b, a[2], a[3])} < 0"
    return f"CASE WHEN {cross} THEN 0.0 ELSE least({far(a[0], a[1], b)}, {far(a[2], a[3], b)}, {far(b[0], b[1], a)}, {far(b[2], b[3], a)}) END"
