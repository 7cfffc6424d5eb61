"""Queries that put a road or a map together: references, fingerprints, availability, marking, snapshots, reports and strokes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import fingerprints
from wayfold.functions import geometry as g
from wayfold.operators import relations, topology
from wayfold.plans import trajectories
from wayfold.plans.linework import _PIECES, _pieces
from wayfold.plans.tables import points, segment_gap, table
from wayfold.sources import reference, snapshots

REFERENCE = {"type": "osm-ref", "ref": "3", "network": "n1", "excludeNames": ["error"], "excludeIds": [100000, 700001]}


def _tagged_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of five segments with a list of numbers, a network and a list of names among their properties."""
    p = points(spark, sf_dir).select((F.col("user_id") * 100000 + F.floor(F.col("i") / 5)).alias("line_id"), "i", "k", "event_type")
    tags = p.groupBy("line_id").agg(F.array_join(F.array_sort(F.collect_set((F.col("k") % 12).cast("string"))), "; ").alias("ref"), F.min_by("event_type", "i").alias("name"))
    network = F.concat(F.lit("n"), (F.floor(F.col("line_id") / 100000) % 2).cast("string"))
    return _pieces(spark, sf_dir).join(tags, "line_id").select(F.col("line_id").alias("id"), F.create_map(F.lit("ref"), F.col("ref"), F.lit("network"), network, F.lit("name"), F.concat(F.lit("x;"), F.col("name"))).alias("properties"), "line")


def reference_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference by number and network, some ids and names left out; how many members, ways and connected parts it has."""
    found = reference.build(_tagged_pieces(spark, sf_dir), REFERENCE)["summary"]
    return found.select("n_members", "n_ways", "n_excluded", "n_components", F.array_join(F.transform("lengths", lambda x: F.round(x).cast("long")), ",").alias("lengths"), "ambiguous")


def selection_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders, those of the two outermost priorities as included and excluded ids."""
    o = table(spark, sf_dir, "orders")
    pick = lambda p: F.collect_list(F.when(F.col("o_orderpriority").startswith(p), F.col("o_orderkey").cast("string")))
    lists = o.groupBy("o_custkey").agg(pick("1").alias("a"), pick("5").alias("b"))
    return lists.select("o_custkey", fingerprints.selection_fingerprint(F.col("a"), F.col("b")).alias("fingerprint"), fingerprints.selection_fingerprint(F.concat("a", F.reverse("a")), F.col("b")).alias("repeated"))


def draft_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of JSON drafts whose keys come in any order and with presentation fields; a text that is no JSON has none."""
    p = table(spark, sf_dir, "part")
    inner = F.struct(F.col("p_size").alias("z"), F.col("p_brand").alias("a"))
    one = F.to_json(F.struct(F.lit("line").alias("presentationType"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("aliases"), inner.alias("inner"), F.col("p_partkey").alias("id")))
    two = F.to_json(F.struct(F.col("p_partkey").alias("id"), inner.alias("inner"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("aliases"), F.lit("other").alias("presentationType")))
    texts = p.select("p_partkey", one.alias("one"), two.alias("two")).withColumn("one", F.expr("if(p_partkey % 9 = 0, substring(one, 1, length(one) - 1), one)"))
    return texts.select("p_partkey", fingerprints.draft_fingerprint(F.col("one")).alias("fingerprint"), fingerprints.draft_fingerprint(F.col("two")).alias("other_order"), fingerprints.content_json_id(F.col("two"), prefix="p:").alias("content_id"))


def built_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that have lines of both kinds, as entries of a search index."""
    files = table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("kind"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.concat(F.lit("data/"), F.col("p_partkey"), F.lit("-a.geojson")).alias("source"))
    return relations.available(p, files, "p_partkey", "kind", ["A", "R"])


def dimmed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts left in the background by a choice of brands, and by an empty choice."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    some = table(spark, sf_dir, "part").where("p_size > 45 and p_partkey % 40 = 1").select("p_brand")
    none = p.where("p_partkey < 0").select("p_brand")
    return relations.dimmed(p, some, "p_brand").groupBy("p_brand").agg(F.count("*").alias("n")).withColumn("choice", F.lit("some")).unionByName(relations.dimmed(p, none, "p_brand").groupBy("p_brand").agg(F.count("*").alias("n")).withColumn("choice", F.lit("none")))


def line_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which feature is the active line, and each line's state where one or several may be chosen."""
    kind = F.when(F.col("p_size") % 4 == 0, "road").when(F.col("p_size") % 4 == 1, "railway").when(F.col("p_size") % 4 == 2, "historical-road").otherwise("station")
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("id"), kind.alias("type"))
    active = F.lit(True) & (F.col("id") == 8) & (F.col("type") == "road")
    line = F.col("type").isin("road", "railway", "historical-road")
    return p.select("p_partkey", (line & active).alias("active_line"), F.when(line, F.lit("selected")).alias("multi"), F.when(line, F.when(active, "active").otherwise("retained")).alias("single"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.lit("p").alias("provider"),
        F.col("c_mktsegment").alias("prefecture"),
        F.when(F.col("o_orderpriority") < "3", "high").otherwise("low").alias("resolution"),
        F.date_format("o_orderdate", "yyyy-MM").alias("date"),
        F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("name"),
        F.when(F.col("c_nationkey") % 4 == 0, F.concat(F.lit("g"), F.floor(F.col("c_nationkey") / 8).cast("string"))).alias("parent"),
    )


def snapshot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that each request gets: the date asked for, else the latest; exact requests never fall back."""
    held = snapshots.manifest(_snapshots(spark, sf_dir).where("not (resolution = 'low' and prefecture = 'MACHINERY')"))
    c = table(spark, sf_dir, "customer")
    month = F.concat((1992 + F.col("c_custkey") % 9).cast("string"), F.lit("-"), F.lpad((F.col("c_custkey") % 12 + 1).cast("string"), 2, "0"))
    wanted = c.select("c_custkey", F.lit("p").alias("provider"), F.col("c_mktsegment").alias("prefecture"), F.when(F.col("c_custkey") % 2 == 0, "low").otherwise("high").alias("resolution"), F.when(F.col("c_custkey") % 5 > 0, month).alias("date"), (F.col("c_custkey") % 3 == 0).alias("parents"))
    return snapshots.resolve(wanted, held).select("c_custkey", "exact", "resolved", "problem")


def snapshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of two levels with the dates of each resolution."""
    index = snapshots.name_index(_snapshots(spark, sf_dir))
    count = lambda r: F.size(F.coalesce(F.col("dates")[r], F.array().cast("array<string>"))).cast("long")
    return index.select("prefecture", "level", "name", count("high").alias("n_high"), count("low").alias("n_low"), F.array_max(F.flatten(F.map_values("dates"))).alias("last"))


def preview_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders as previews, those that go: all but the newest five; one without a readable status goes after seven days instead."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderkey") % 6 == 0).alias("unreadable"))
    now = o.agg(F.max("o_orderdate").alias("now"))
    rank = F.row_number().over(Window.partitionBy("o_custkey", "unreadable").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    old = F.col("o_orderdate") < F.col("now") - F.expr("interval 7 days")
    return o.withColumn("rank", rank).join(F.broadcast(now)).where(F.when(F.col("unreadable"), old).otherwise(F.col("rank") > 5)).select("o_custkey", "o_orderkey")


def road_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each class as compact JSON: counts, residuals of what is selected, and the share that passes."""
    stats = trajectories.traj_residual_stats(spark, sf_dir).withColumn("class", F.col("user_id") % 4 + 1).withColumn("ok", (F.col("median_d") <= trajectories.MEDIAN) & (F.col("p90_d") <= trajectories.P90))
    picked = lambda c: F.when(F.col("ok"), F.col(c))
    side = lambda c: F.struct(F.round(F.min(picked(c)), 2).alias("min"), F.round(F.percentile(picked(c), F.lit(0.5)), 2).alias("median"), F.round(F.max(picked(c)), 2).alias("max"))
    rows = stats.groupBy("class").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), side("median_d").alias("m"))
    body = F.struct(F.concat(F.lit("class-"), F.col("class")).alias("roadId"), F.col("n").alias("candidateCount"), F.col("n_ok").alias("selectedCount"), F.round(100 * F.col("n_ok") / F.col("n"), 1).alias("selectedPercent"))
    return rows.select("class", F.to_json(body).alias("report"), F.col("m.min").alias("residual_min"), F.col("m.median").alias("residual_median"), F.col("m.max").alias("residual_max"))


def line_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go on into each other: at a common end each the other's best, at 120 degrees or more between them; angles within a tenth of a degree go by id."""
    tips = topology.ends(_pieces(spark, sf_dir), "line_id").select("line_id", "end", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), (F.col("ix") - F.col("x")).alias("dx"), (F.col("iy") - F.col("y")).alias("dy"))
    other = tips.select(F.col("line_id").alias("other"), F.col("end").alias("oend"), "x", "y", F.col("dx").alias("ox"), F.col("dy").alias("oy"))
    angle = g.turn(F.col("dx"), F.col("dy"), F.col("ox"), F.col("oy"))
    pairs = tips.join(other, ["x", "y"]).where("line_id != other").withColumn("angle", F.round(angle, 1)).where("angle >= 120 and dx * dx + dy * dy > 0 and ox * ox + oy * oy > 0")
    best = relations.best(pairs, ["line_id", "end"], [F.desc("angle"), "other", "oend"]).select("line_id", "end", "other", "oend", "angle")
    back = best.select(F.col("other").alias("line_id"), F.col("oend").alias("end"), F.col("line_id").alias("other"), F.col("end").alias("oend"))
    return best.join(back, ["line_id", "end", "other", "oend"]).where("line_id < other").select("line_id", "end", "other", "oend", "angle")


QUERIES = {f.__name__: f for f in (reference_build, selection_fingerprints, draft_fingerprints, built_roads, dimmed_parts, line_marks, snapshot_requests, snapshot_names, preview_cleanup, road_report, line_strokes)}

_SNAPSHOTS = """snap AS (
  SELECT c_mktsegment AS prefecture, CASE WHEN o_orderpriority < '3' THEN 'high' ELSE 'low' END AS resolution, strftime(o_orderdate, '%Y-%m') AS date, 'm' || c_nationkey AS name,
    CASE WHEN c_nationkey % 4 = 0 THEN 'g' || (c_nationkey // 8) END AS parent FROM orders JOIN customer ON o_custkey = c_custkey)"""

ORACLE = {
    "reference_build": f"""WITH RECURSIVE {_PIECES},
tags AS (SELECT user_id * 100000 + i // 5 AS id, list(DISTINCT k % 12) AS refs, arg_min(event_type, i) AS name FROM pts GROUP BY ALL),
member AS (SELECT t.id, name FROM tags t JOIN total USING (id) WHERE list_contains(refs, 3) AND (t.id // 100000) % 2 = 1 AND t.id NOT IN (100000, 700001)),
kept AS (SELECT id FROM member WHERE name IS NULL OR name != 'error'),
s AS (SELECT sg.* FROM sg JOIN kept USING (id)),
pair AS (
  SELECT a.id AS a, b.id AS b, a.x1, a.y1, a.x2, a.y2, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2 FROM s a JOIN s b ON a.id != b.id
    AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) + 0.01 AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) + 0.01 AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) + 0.01 AND least(b.y1, b.y2) <= greatest(a.y1, a.y2) + 0.01),
reach0 AS (
  SELECT DISTINCT a, b FROM pair WHERE {segment_gap(("x1", "y1", "x2", "y2"), ("u1", "v1", "u2", "v2"))} <= 0.01),
reach(a, b) AS (SELECT id, id FROM kept UNION SELECT r.a, e.b FROM reach r JOIN reach0 e ON r.b = e.a),
grouped AS (SELECT b AS id, min(a) AS c FROM reach GROUP BY b),
sizes AS (SELECT c, sum(whole) AS length FROM grouped JOIN total USING (id) GROUP BY c)
SELECT (SELECT count(*) FROM member) AS n_members, (SELECT count(*) FROM kept) AS n_ways, (SELECT count(*) FROM member) - (SELECT count(*) FROM kept) AS n_excluded, count(*) AS n_components,
  string_agg(CAST(round(round(length, 1)) AS BIGINT), ',' ORDER BY length DESC) AS lengths, count(*) > 1 AS ambiguous FROM sizes""",
    "selection_fingerprints": """WITH l AS (
  SELECT o_custkey, coalesce(string_agg(DISTINCT '"' || o_orderkey || '"', ',' ORDER BY '"' || o_orderkey || '"') FILTER (o_orderpriority LIKE '1%'), '') AS a,
    coalesce(string_agg(DISTINCT '"' || o_orderkey || '"', ',' ORDER BY '"' || o_orderkey || '"') FILTER (o_orderpriority LIKE '5%'), '') AS b FROM orders GROUP BY o_custkey),
h AS (SELECT o_custkey, sha256('{"exclude":[' || b || '],"include":[' || a || ']}') AS f FROM l)
SELECT o_custkey, f AS fingerprint, f AS repeated FROM h""",
    "draft_fingerprints": """WITH j AS (
  SELECT p_partkey, '{"aliases":["' || p_type || '","' || p_brand || '"],"id":' || p_partkey || ',"inner":{"a":"' || p_brand || '","z":' || p_size || '},"name":"' || p_name || '"' AS t FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 9 != 0 THEN sha256(t || '}') END AS fingerprint, sha256(t || '}') AS other_order, 'p:' || substr(sha256(t || ',"presentationType":"other"}'), 1, 20) AS content_id FROM j""",
    "built_roads": """SELECT p_partkey, p_name AS name, 'data/' || p_partkey || '-a.geojson' AS source FROM part
WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""",
    "dimmed_parts": """SELECT p_brand, count(*) AS n, 'some' AS choice FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 45 AND p_partkey % 40 = 1)
  AND EXISTS (SELECT 1 FROM part WHERE p_size > 45 AND p_partkey % 40 = 1) GROUP BY p_brand""",
    "line_marks": """WITH p AS (SELECT p_partkey, p_partkey % 50 AS id, CASE p_size % 4 WHEN 0 THEN 'road' WHEN 1 THEN 'railway' WHEN 2 THEN 'historical-road' ELSE 'station' END AS type FROM part)
SELECT p_partkey, id = 8 AND type = 'road' AS active_line, CASE WHEN type != 'station' THEN 'selected' END AS multi,
  CASE WHEN type != 'station' THEN CASE WHEN id = 8 AND type = 'road' THEN 'active' ELSE 'retained' END END AS single FROM p""",
    "snapshot_requests": f"""WITH {_SNAPSHOTS},
held AS (SELECT prefecture, resolution, date, count(DISTINCT parent) AS n FROM snap WHERE NOT (resolution = 'low' AND prefecture = 'MACHINERY') GROUP BY ALL),
w AS (
  SELECT c_custkey, c_mktsegment AS prefecture, CASE WHEN c_custkey % 2 = 0 THEN 'low' ELSE 'high' END AS resolution,
    CASE WHEN c_custkey % 5 > 0 THEN (1992 + c_custkey % 9) || '-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') END AS date, c_custkey % 3 = 0 AS parents FROM customer),
r AS (
  SELECT c_custkey, parents, prefecture, resolution, (SELECT max(date) FROM held h WHERE h.prefecture = w.prefecture AND h.resolution = w.resolution AND h.date = w.date) AS exact,
    (SELECT max(date) FROM held h WHERE h.prefecture = w.prefecture AND h.resolution = w.resolution) AS latest FROM w)
SELECT c_custkey, exact, coalesce(exact, latest) AS resolved,
  CASE WHEN coalesce(exact, latest) IS NULL THEN 'no snapshot' WHEN parents AND coalesce((SELECT max(n) FROM held h WHERE h.prefecture = r.prefecture AND h.resolution = r.resolution AND h.date = coalesce(exact, latest)), 0) = 0 THEN 'no parents' END AS problem FROM r""",
    "snapshot_names": f"""WITH {_SNAPSHOTS},
n AS (SELECT DISTINCT prefecture, resolution, date, 'municipality' AS level, name FROM snap UNION SELECT DISTINCT prefecture, resolution, date, 'parent', parent FROM snap WHERE parent IS NOT NULL)
SELECT prefecture, level, name, count(*) FILTER (resolution = 'high') AS n_high, count(*) FILTER (resolution = 'low') AS n_low, max(date) AS last FROM n GROUP BY prefecture, level, name""",
    "preview_cleanup": """WITH o AS (
  SELECT *, o_orderkey % 6 = 0 AS unreadable, max(o_orderdate) OVER () AS now, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 6 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders)
SELECT o_custkey, o_orderkey FROM o WHERE CASE WHEN unreadable THEN o_orderdate < now - INTERVAL 7 DAY ELSE rank > 5 END""",
    "road_report": f"""WITH {trajectories._STATS},
t AS (SELECT *, user_id % 4 + 1 AS class, median_d <= {trajectories.MEDIAN} AND p90_d <= {trajectories.P90} AS ok FROM stats),
r AS (
  SELECT class, count(*) AS n, count(*) FILTER (ok) AS n_ok, round(min(median_d) FILTER (ok), 2) AS lo, round(quantile_cont(median_d, 0.5) FILTER (ok), 2) AS mid, round(max(median_d) FILTER (ok), 2) AS hi FROM t GROUP BY class)
SELECT class, '{{"roadId":"class-' || class || '","candidateCount":' || n || ',"selectedCount":' || n_ok || ',"selectedPercent":' || CAST(round(100.0 * n_ok / n, 1) AS DOUBLE) || '}}' AS report,
  lo AS residual_min, mid AS residual_median, hi AS residual_max FROM r""",
    "line_strokes": f"""WITH {_PIECES},
t AS (SELECT id AS line_id, tip AS e, round(x, 6) AS x, round(y, 6) AS y, ix - tips.x AS dx, iy - tips.y AS dy FROM tips),
p AS (
  SELECT a.line_id, a.e, b.line_id AS other, b.e AS oe, round(degrees(acos(greatest(-1, least(1, (a.dx * b.dx + a.dy * b.dy) / (sqrt(a.dx ** 2 + a.dy ** 2) * sqrt(b.dx ** 2 + b.dy ** 2)))))), 1) AS angle
  FROM t a JOIN t b ON a.x = b.x AND a.y = b.y AND a.line_id != b.line_id WHERE a.dx ** 2 + a.dy ** 2 > 0 AND b.dx ** 2 + b.dy ** 2 > 0),
best AS (SELECT * FROM p WHERE angle >= 120 QUALIFY row_number() OVER (PARTITION BY line_id, e ORDER BY angle DESC, other, oe) = 1)
SELECT a.line_id, a.e AS "end", a.other, a.oe AS oend, a.angle FROM best a JOIN best b ON a.other = b.line_id AND a.oe = b.e AND b.other = a.line_id AND b.oe = a.e WHERE a.line_id < a.other""",
}
