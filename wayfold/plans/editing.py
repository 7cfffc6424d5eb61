"""Queries over route identities, class summaries, story steps, scene items and line measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import edits, routes
from wayfold.functions import geometry as g
from wayfold.functions import text as t
from wayfold.operators import lines, relations
from wayfold.plans import trajectories
from wayfold.plans.tables import SEGMENTS, points, segments, table


def route_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route id of each part's fields, null where it has none of the form."""
    p = table(spark, sf_dir, "part")
    code = F.concat(F.lit("R"), F.lpad((F.col("p_partkey") % 1200).cast("string"), 3, "0"))
    fields = F.create_map(F.lit("numbering"), F.when(F.col("p_size") > 30, F.concat(F.lit(" "), code)), F.lit("route"), F.when(F.col("p_size") > 20, F.col("p_brand")), F.lit("ID"), code)
    return p.select("p_partkey", routes.route_id(fields, strict=False).alias("route_id"))


def road_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, number, whether the title fits, and aliases, of roads named after parts."""
    p = table(spark, sf_dir, "part")
    number = F.col("p_partkey").cast("string")
    titled = F.when(F.col("p_size") % 7 == 0, (F.col("p_partkey") + 1).cast("string")).otherwise(number)  # another road's title
    road = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("jp-national-"), number)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("tokyo-prefectural-"), number)).otherwise(F.concat(F.lit("kyoto-prefectural-"), number))
    title = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("国道"), titled, F.lit("号"))).when(F.col("p_size") % 2 == 0, F.concat(F.lit("東京都道・埼玉県道"), titled, F.lit("号環状七号線"))).otherwise(F.concat(F.lit("東京都道"), titled, F.lit("号")))
    r = p.select("p_partkey", road.alias("road"), title.alias("title")).withColumn("kind", routes.road_kind(F.col("road"))).withColumn("number", routes.road_number(F.col("road")))
    return r.where("kind is not null").select("p_partkey", "kind", "number", routes.title_matches(F.col("title"), F.col("kind"), F.col("number")).alias("fits"), F.array_join(routes.road_aliases(F.col("title"), F.col("kind"), F.col("number")), "|").alias("aliases"))


def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of each class the lines near the reference, those that pass, their length and median residual, and whether the class is suggested."""
    stats = trajectories.traj_residual_stats(spark, sf_dir).withColumn("passes", (F.col("median_d") <= trajectories.MEDIAN) & (F.col("p90_d") <= trajectories.P90))
    length = segments(spark, sf_dir).groupBy("user_id").agg(F.max("to").alias("length"))
    rows = stats.join(length, "user_id").withColumn("class", (F.col("user_id") % 4 + 1).cast("int"))
    passed = F.col("passes")
    return rows.groupBy("class").agg(F.count("*").alias("nearby"), F.count_if(passed).alias("residual_pass"), F.round(F.coalesce(F.sum(F.when(passed, F.col("length"))), F.lit(0.0)), 1).alias("matched_length"), F.round(F.percentile(F.when(passed, F.col("median_d")), F.lit(0.5)), 2).alias("median_residual"), F.max(passed).alias("suggested"))


def name_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K: brands that small and large parts of one type have in common."""
    p = table(spark, sf_dir, "part")
    return p.where("p_size < 5").select("p_brand", "p_type").intersect(p.where("p_size > 45").select("p_brand", "p_type"))


def feature_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that customers with a high balance ask for by id; one that is missing is an error."""
    p = table(spark, sf_dir, "part")
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select((F.col("c_custkey") % 100 + 1).alias("p_partkey"))
    return relations.by_id(p, wanted, "p_partkey").select("p_partkey", "p_name")


def search_with_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits among entities in search form, and behind them nations whose name contains the query in any case."""
    p, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    one = p.where(t.search_key(F.col("p_name")).contains(t.search_form("An"))).select(F.lit(0).alias("rank"), F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"))
    return one.union(n.where(F.lower("n_name").contains("an")).select(F.lit(1), F.col("n_nationkey").cast("long"), "n_name"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as steps of a story."""
    li = table(spark, sf_dir, "lineitem")
    every = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return li.groupBy("l_orderkey").agg(F.transform(every, lambda s: F.struct(s["l_linenumber"].cast("long").alias("key"), s["l_partkey"].cast("string").alias("step"))).alias("steps"))


def step_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps reordered, one duplicated, one deleted, one inserted and one updated."""
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["key"].cast("string"), s["step"])), ",")
    s, steps = _steps(spark, sf_dir), F.col("steps")
    entry = F.struct(F.lit(99).cast("long").alias("key"), F.lit("new").alias("step"))
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    return s.select(
        "l_orderkey",
        shown(edits.reorder_step(steps, F.lit(0), F.lit(2))).alias("reordered"),
        shown(edits.duplicate_step(steps, two, F.lit(98).cast("long"))).alias("duplicated"),
        shown(edits.delete_step(steps, one)).alias("deleted"),
        edits.selected_after_delete(steps, one, one).alias("selected"),
        shown(edits.insert_step(steps, one, entry)).alias("inserted"),
        shown(edits.update_step(steps, two, F.lit("seen"))).alias("updated"),
    )


def scene_item_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene's items after showing, hiding, removing and clearing; the project's own items stay."""
    li = table(spark, sf_dir, "lineitem")
    every = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    items = F.transform(every, lambda s: F.struct(s["l_linenumber"].cast("long").alias("id"), F.lit(False).alias("visible"), (s["l_returnflag"] == "R").alias("backed")))
    o = li.groupBy("l_orderkey").agg(items.alias("items"))
    shown = lambda c: F.array_join(F.transform(c, lambda i: F.concat(i["id"].cast("string"), F.when(i["visible"], "+").otherwise("-"))), ",")
    three = F.lit(3).cast("long")
    both = edits.show_item(F.col("items"), three)
    return o.select("l_orderkey", shown(both).alias("shown"), shown(edits.hide_item(both, three)).alias("hidden"), shown(edits.remove_item(both, three)).alias("removed"), shown(edits.clear_items(both)).alias("cleared"))


def story_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that search results make, written as a story's text and read back; every fifth text is cut short and gives no story."""
    action = F.when(F.col("p_size") % 3 == 0, "show").when(F.col("p_size") % 3 == 1, "activate").otherwise("hide")
    p = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("displayName"), F.lit("parts").alias("project"), F.array(edits.feature_step(F.col("p_brand"), action)).alias("steps")).alias("story"))
    back = p.select("p_partkey", "story", edits.story_of(F.when(F.col("p_partkey") % 5 == 0, F.regexp_replace(edits.story_json(F.col("story")), ".$", "")).otherwise(edits.story_json(F.col("story"))), dict(p.dtypes)["story"]).alias("back"))
    step = F.get("back.steps", 0)
    return back.select("p_partkey", F.col("back.displayName").alias("name"), step["action"].alias("action"), step["id"].alias("id"), step["cameraDuration"].alias("seconds"), F.to_json("back").eqNullSafe(F.to_json("story")).alias("same"))


def line_hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hausdorff distance, by vertices, of both halves of each vector's line."""
    e = table(spark, sf_dir, "embeddings")
    line = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: g.vertex(F.get("embedding", i * 2), F.get("embedding", i * 2 + 1)))
    return e.select("vec_id", F.slice(line, 1, 16).alias("a"), F.slice(line, 17, 16).alias("b")).select("vec_id", F.round(g.hausdorff(F.col("a"), F.col("b")), 5).alias("distance"))


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second event's place ends a line; lines of one user that alone share an end are merged again."""
    p = points(spark, sf_dir).select("user_id", F.col("i").cast("long").alias("i"), "x", "y")
    flat = p.select("user_id", F.explode(F.array(F.floor(F.col("i") / 2) - F.when((F.col("i") % 2 == 0), 1).otherwise(0), F.floor(F.col("i") / 2))).alias("id"), "i", "x", "y").where("id >= 0").distinct()
    made = flat.groupBy("user_id", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("line")).where("size(line) > 1 and id % 5 != 4")
    return lines.merge_lines(made, "user_id").select("user_id", F.size("line").cast("long").alias("n_vertices"), F.round(g.length(F.col("line")), 4).alias("length"))


QUERIES = {f.__name__: f for f in (route_ids, road_aliases, class_summary, name_intersect, feature_by_id, search_with_places, step_edits, scene_item_edits, story_round_trip, line_hausdorff, merged_lines)}

_LINES = "lists AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS k, list(l_linenumber || ':' || l_partkey ORDER BY l_linenumber, l_partkey) AS s FROM lineitem GROUP BY l_orderkey)"

ORACLE = {
    "route_ids": r"""WITH c AS (SELECT *, 'R' || lpad(CAST(p_partkey % 1200 AS VARCHAR), 3, '0') AS code FROM part),
v AS (SELECT p_partkey, CASE WHEN p_size > 30 THEN code WHEN p_size > 20 THEN p_brand ELSE code END AS v FROM c)
SELECT p_partkey, CASE WHEN regexp_matches(v, '^R[0-9]{3}(-[0-9]+)?$') THEN v END AS route_id FROM v""",
    "road_aliases": """WITH r AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS n, p_size % 3 AS m, p_size % 2 = 0 AS even, p_size % 7 != 0 AS fits FROM part WHERE p_size % 3 < 2)
SELECT p_partkey, CASE WHEN m = 0 THEN 'jp-national' ELSE 'tokyo-prefectural' END AS kind, n AS number, fits,
  CASE WHEN m = 0 THEN '国道' || n || '|' || n || '号' WHEN NOT fits THEN '都道' || n || '号|東京都道' || n || '号' WHEN even THEN '都道' || n || '号|東京都道' || n || '号|環状七号線|環七通り|環七|環7' ELSE '都道' || n || '号' END AS aliases FROM r""",
    "class_summary": f"""WITH {trajectories._STATS},
l AS (SELECT user_id, max("to") AS length FROM segs GROUP BY user_id),
j AS (SELECT *, user_id % 4 + 1 AS class, median_d <= {trajectories.MEDIAN} AND p90_d <= {trajectories.P90} AS passes FROM stats JOIN l USING (user_id))
SELECT CAST(class AS INTEGER) AS class, count(*) AS nearby, count(*) FILTER (WHERE passes) AS residual_pass, round(coalesce(sum(length) FILTER (WHERE passes), 0), 1) AS matched_length, round(quantile_cont(median_d, 0.5) FILTER (WHERE passes), 2) AS median_residual, bool_or(passes) AS suggested FROM j GROUP BY class""",
    "name_intersect": "SELECT p_brand, p_type FROM part WHERE p_size < 5 INTERSECT SELECT p_brand, p_type FROM part WHERE p_size > 45",
    "feature_by_id": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT c_custkey % 100 + 1 FROM customer WHERE c_acctbal > 9000)",
    "search_with_places": "SELECT 0 AS rank, CAST(p_partkey AS BIGINT) AS id, p_name AS name FROM part WHERE contains(regexp_replace(replace(lower(p_name), ' ', ''), '^r([0-9])', '\\1'), 'an') UNION ALL SELECT 1, n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'an')",
    "step_edits": f"""WITH {_LINES}
SELECT l_orderkey, array_to_string(CASE WHEN len(s) > 2 THEN list_concat(s[2:3], s[1:1], s[4:]) ELSE s END, ',') AS reordered,
  array_to_string(CASE WHEN list_contains(k, 2) THEN list_concat(s[1:list_position(k, 2)], ['98' || s[list_position(k, 2)][2:]], s[list_position(k, 2) + 1:]) ELSE s END, ',') AS duplicated,
  array_to_string([x for x in s if not starts_with(x, '1:')], ',') AS deleted,
  CAST(CASE WHEN list_contains(k, 1) THEN [x for x in k if x <> 1][1] ELSE 1 END AS BIGINT) AS selected,
  array_to_string(list_concat(s[1:coalesce(list_position(k, 1), 0)], ['99:new'], s[coalesce(list_position(k, 1), 0) + 1:]), ',') AS inserted,
  array_to_string([CASE WHEN starts_with(x, '2:') THEN '2:seen' ELSE x END for x in s], ',') AS updated FROM lists""",
    "scene_item_edits": """WITH l AS (SELECT l_orderkey, list({'id': l_linenumber, 'b': l_returnflag = 'R'} ORDER BY l_linenumber, l_returnflag) AS i FROM lineitem GROUP BY l_orderkey),
a AS (SELECT l_orderkey, CASE WHEN len([x for x in i if x.id = 3]) > 0 THEN i ELSE list_append(i, {'id': 3, 'b': false}) END AS i FROM l)
SELECT l_orderkey, array_to_string([x.id || CASE WHEN x.id = 3 THEN '+' ELSE '-' END for x in i], ',') AS shown, array_to_string([x.id || '-' for x in i], ',') AS hidden,
  array_to_string([x.id || CASE WHEN x.id = 3 THEN '+' ELSE '-' END for x in i if x.id <> 3 OR x.b], ',') AS removed, array_to_string([x.id || CASE WHEN x.id = 3 THEN '+' ELSE '-' END for x in i if x.b], ',') AS cleared FROM a""",
    "story_round_trip": "SELECT p_partkey, CASE WHEN ok THEN p_name END AS name, CASE WHEN NOT ok THEN NULL WHEN p_size % 3 = 0 THEN 'show' WHEN p_size % 3 = 1 THEN 'activate' ELSE 'hide' END AS action, CASE WHEN ok THEN p_brand END AS id, CASE WHEN ok AND p_size % 3 = 1 THEN 0.8::DOUBLE END AS seconds, ok AS same FROM (SELECT *, p_partkey % 5 != 0 AS ok FROM part)",
    "line_hausdorff": """WITH v AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM (SELECT vec_id, embedding, unnest(range(0, 32)) AS i FROM embeddings)),
s AS (SELECT a.vec_id, a.i // 16 AS half, a.x AS x1, a.y AS y1, b.x - a.x AS dx, b.y - a.y AS dy FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.i = a.i + 1 AND a.i <> 15),
t AS (SELECT v.vec_id, v.i, v.x, v.y, x1, y1, dx, dy, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((v.x - x1) * dx + (v.y - y1) * dy) / (dx * dx + dy * dy))) END AS t FROM v JOIN s ON s.vec_id = v.vec_id AND s.half <> v.i // 16),
d AS (SELECT vec_id, i, min(sqrt((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2)) AS d FROM t GROUP BY vec_id, i)
SELECT vec_id, round(max(d), 5) AS distance FROM d GROUP BY vec_id""",
    "merged_lines": f"""WITH {SEGMENTS}
SELECT user_id, count(*) + 1 AS n_vertices, round(sum(size), 4) AS length FROM segs WHERE seg % 10 < 8 GROUP BY user_id, seg // 10""",
}
