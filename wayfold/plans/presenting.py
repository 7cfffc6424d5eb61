"""Queries over the display's arithmetic: scales, camera targets, address parameters, toggles and panel lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import display
from wayfold.plans.tables import POINTS, points, table


def scene_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene size, scale, label size, pixel ratio and darkness for windows of many shapes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1300).alias("w"), (F.col("o_custkey") % 900).alias("h"), (F.col("o_orderkey") % 4).alias("device"), F.col("o_orderstatus").alias("s"))
    size = o.withColumn("size", display.scene_size(F.col("w"), F.col("h")))
    ratio = display.pixel_ratio(F.col("size.width"), F.col("size.height"), F.col("w") * 3, F.col("h") * 4, F.col("device"))
    r = lambda c, name: F.round(c, 6).alias(name)
    return size.withColumn("ratio", ratio).select(
        "o_orderkey",
        r(F.col("size.width"), "width"),
        r(F.col("size.height"), "height"),
        r(display.label_size(F.when(F.col("s") == "O", "large").otherwise("normal"), display.presentation_scale(F.col("size.width"))), "label"),
        r(F.col("ratio.desired"), "desired"),
        r(F.col("ratio.effective"), "effective"),
        display.dark(F.when(F.col("s") == "F", "auto").otherwise("manual"), F.col("device") > 1, F.col("h") > 450).alias("dark"),
    )


def camera_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds that show each user's line: a point, the whole scene for some kinds, else its own box."""
    p = points(spark, sf_dir)
    own = p.groupBy("user_id").agg(F.count("*").alias("n"), F.struct(F.min("x").alias("w"), F.min("y").alias("s"), F.max("x").alias("e"), F.max("y").alias("n")).alias("own"))
    scene = p.agg(F.struct(F.min("x").alias("w"), F.min("y").alias("s"), F.max("x").alias("e"), F.max("y").alias("n")).alias("scene"))
    kind = F.when(F.col("user_id") % 3 == 0, "railway").when(F.col("user_id") % 3 == 1, "historical-road").otherwise("road")
    shape = F.when(F.col("user_id") % 5 == 0, "Point").otherwise("LineString")
    t = own.join(F.broadcast(scene)).select("user_id", display.camera_target(kind, shape, F.col("own"), F.col("scene")).alias("t"))  # a row
    return t.select("user_id", "t.mode", F.round("t.bounds.w", 4).alias("w"), F.round("t.bounds.n", 4).alias("n"), F.coalesce("t.margin", F.lit(-1)).alias("margin"), F.coalesce("t.zoom", F.lit(-1)).alias("zoom"))


def story_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parameters of an address ask for."""
    p = table(spark, sf_dir, "part")
    story = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, "&story=+").otherwise(F.concat(F.lit("&story="), F.replace("p_name", F.lit(" "), F.lit("+"))))
    time = F.when(F.col("p_size") % 7 == 0, "&t=abc").when(F.col("p_size") % 7 == 1, "&t=").when(F.col("p_size") % 7 == 2, "").otherwise(F.concat(F.lit("&t="), (F.col("p_size") - 25).cast("string"), F.lit(".5")))
    play = F.when(F.col("p_size") % 3 == 0, "&autoplay=0").when(F.col("p_size") % 3 == 1, "&autoplay=1&autoplay=0").otherwise("")
    search = F.concat(F.lit("?capture="), (F.col("p_partkey") % 2).cast("string"), story, time, play, F.lit("&project=p%2D"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", display.story_parameters(search).alias("q")).select("p_partkey", "q.*")


def route_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of each order's parts after one of them is toggled as a route."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("roads"), F.min("l_partkey").alias("least"))
    route = F.when(F.col("l_orderkey") % 3 == 0, F.col("least")).otherwise(F.lit(-1).cast("long"))
    posts = F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array(F.lit(7).cast("long")))
    t = lists.select("l_orderkey", display.route_toggled(F.col("roads"), posts, route).alias("t"))
    return t.select("l_orderkey", F.array_join(F.transform("t.roads", lambda x: x.cast("string")), ",").alias("roads"), F.array_join(F.transform("t.posts", lambda x: x.cast("string")), ",").alias("posts"))


def panel_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct values of two panel lists."""
    p = table(spark, sf_dir, "part")
    return p.select(F.lit("municipality").alias("list"), F.col("p_brand").alias("value")).unionByName(p.select(F.lit("parent").alias("list"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("value"))).where("value is not null and value != ''").distinct()


def continuity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each customer's summary."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return o.select("o_custkey", display.continuity_text(F.col("n"), F.col("ok"), F.col("open")).alias("text"))


QUERIES = {f.__name__: f for f in (scene_scales, camera_targets, story_addresses, route_toggles, panel_values, continuity_texts)}

ORACLE = {
    "scene_scales": """WITH o AS (SELECT o_orderkey, o_orderkey % 1300 AS w, o_custkey % 900 AS h, o_orderkey % 4 AS device, o_orderstatus AS s FROM orders),
z AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 THEN 768.0::DOUBLE ELSE least(w::DOUBLE, h * (768.0::DOUBLE / 432.0), 768.0) END AS width FROM o),
r AS (SELECT *, width / (768.0::DOUBLE / 432.0) AS height FROM z),
v AS (SELECT *, least(CASE WHEN w > 0 THEN w * 3 / width ELSE 1.0 END, CASE WHEN h > 0 THEN h * 4 / height ELSE 1.0 END) * CASE WHEN device > 0 THEN device ELSE 1 END AS desired FROM r)
SELECT o_orderkey, round(width, 6) AS width, round(height, 6) AS height, round(CASE WHEN s = 'O' THEN 28 ELSE 14 END * width / 768.0, 6) AS label, round(desired, 6) AS desired,
  round(greatest(1.0, least(desired, 4096 / width, 4096 / height)), 6) AS effective, CASE WHEN s = 'F' THEN h > 450 ELSE device > 1 END AS dark FROM v""",
    "camera_targets": f"""WITH {POINTS},
b AS (SELECT user_id, min(x) AS w, max(y) AS n FROM pts GROUP BY user_id), a AS (SELECT min(x) AS aw, max(y) AS an FROM pts),
m AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN 'point' WHEN user_id % 3 < 2 THEN 'scene' ELSE 'box' END AS mode FROM b, a)
SELECT user_id, mode, round(CASE mode WHEN 'scene' THEN aw ELSE w END, 4) AS w, round(CASE mode WHEN 'scene' THEN an ELSE n END, 4) AS n, CASE mode WHEN 'box' THEN 100 ELSE -1 END AS margin, CASE mode WHEN 'point' THEN 15 ELSE -1 END AS zoom FROM m""",
    "story_addresses": """SELECT p_partkey, CASE WHEN p_size % 5 > 1 THEN p_name END AS story, 'p-' || p_partkey AS project, p_partkey % 2 = 1 AS capture,
  CASE p_size % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE p_partkey % 2 = 1 END AS autoplay,
  CASE p_size % 7 WHEN 0 THEN NULL WHEN 2 THEN NULL WHEN 1 THEN 0.0 ELSE greatest(0.0, CAST((p_size - 25) || '.5' AS DOUBLE)) END AS time FROM part""",
    "route_toggles": """WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS roads, min(l_partkey) AS least FROM lineitem GROUP BY l_orderkey),
t AS (SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN list_filter(roads, lambda x: x != least) ELSE list_append(roads, -1) END AS roads FROM l)
SELECT l_orderkey, array_to_string(roads, ',') AS roads, CASE WHEN l_orderkey % 2 = 0 THEN '-1' WHEN l_orderkey % 3 = 0 THEN '7' ELSE '7,-1' END AS posts FROM t""",
    "panel_values": "SELECT DISTINCT 'municipality' AS list, p_brand AS value FROM part WHERE p_brand != '' UNION SELECT DISTINCT 'parent', p_type FROM part WHERE p_size % 2 = 0 AND p_type != ''",
    "continuity_texts": """SELECT o_custkey, count(*) || ' transitions checked · ' || count(*) FILTER (o_orderstatus = 'F') || ' connected / auto repaired · ' || count(*) FILTER (o_orderstatus = 'O') || ' unresolved' AS text FROM orders GROUP BY o_custkey""",
}
