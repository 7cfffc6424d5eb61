"""Queries over binary sources and what comes of them: extract blocks, shape records, download checks, geometry ids, styles and clouds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import clouds, style, wkb
from wayfold.functions import geometry as g
from wayfold.model import GEOMETRY
from wayfold.operators.components import cut
from wayfold.plans.tables import POINTS, points, table
from wayfold.session import ship
from wayfold.sources import downloads, osmpbf, shapefile


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nodes, users as ways over them, and a relation for every ten users."""
    p = points(spark, sf_dir).withColumn("x", F.floor(F.col("x") * 1000) / 1000)  # whole steps of the format
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    members = "array<struct<type: string, ref: long, role: string>>"
    tags = lambda k, v: F.create_map(F.lit(k), v).alias("properties")
    nodes = p.select(F.lit("node").alias("element_type"), F.col("event_id").alias("element_id"), tags("kind", F.col("event_type")), F.col("x").alias("lon"), F.col("y").alias("lat"), no("array<long>", "refs"), no(members, "members"))
    refs = F.transform(F.sort_array(F.collect_list(F.struct("i", "event_id"))), lambda r: r["event_id"])
    kind = F.when(F.col("user_id") % 3 == 0, "subway").otherwise("rail")
    ways = p.groupBy("user_id").agg(refs.alias("refs")).select(F.lit("way").alias("element_type"), F.col("user_id").alias("element_id"), F.when(F.col("user_id") % 4 != 0, tags("railway", kind)).otherwise(tags("highway", F.lit("path"))).alias("properties"), no("double", "lon"), no("double", "lat"), "refs", no(members, "members"))
    one = F.struct(F.lit("way").alias("type"), F.col("user_id").alias("ref"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("").alias("role"))
    many = p.select("user_id").distinct().groupBy(F.floor(F.col("user_id") / 10).alias("g")).agg(F.sort_array(F.collect_list(F.struct(F.col("user_id").alias("o"), one.alias("m")))).alias("r"))
    relations = many.select(F.lit("relation").alias("element_type"), (F.col("g") + 1).alias("element_id"), tags("route", F.concat(F.lit("r"), F.col("g"))), no("double", "lon"), no("double", "lat"), no("array<long>", "refs"), F.transform("r", lambda r: r["m"]).alias("members"))
    return nodes.unionByName(ways).unionByName(relations)


def pbf_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: elements that have gone through compressed blocks and back; every row."""
    e = osmpbf.decode(osmpbf.encode(_elements(spark, sf_dir)))
    tags = F.array_join(F.transform(F.map_entries("properties"), lambda t: F.concat(t["key"], F.lit("="), t["value"])), ";")
    refs = lambda c: F.aggregate(F.transform(c, lambda r, i: r * (i + 1)), F.lit(0).cast("long"), lambda t, r: t + r)
    return e.select("element_type", "element_id", tags.alias("tags"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.size(F.coalesce("refs", F.array().cast("array<long>"))).alias("n_refs"), F.coalesce(refs(F.col("refs")), F.lit(0)).alias("ref_sum"), F.array_join(F.transform("members", lambda m: F.concat(m["ref"].cast("string"), m["role"])), ",").alias("members"))


def pbf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: features with a tag out of compressed blocks, the positions of nodes and the lines of ways joined in."""
    blocks = cut(osmpbf.encode(_elements(spark, sf_dir)))  # read four times below
    positions = osmpbf.decode(blocks, kinds=("node",)).select("element_id", "lon", "lat")
    ways = osmpbf.decode(blocks, kinds=("way",)).select("element_id", "refs")
    chosen = osmpbf.decode(blocks, tag="railway").unionByName(osmpbf.decode(blocks, tag="route"))
    line = F.flatten(F.flatten("geom.polys"))
    box = g.bounds(line)
    return osmpbf.features(chosen, positions, ways).select("id", F.col("geom.gtype").alias("gtype"), F.size(F.element_at("geom.polys", 1)).alias("n_lines"), F.size(line).alias("n_vertices"), F.round(box["w"], 6).alias("w"), F.round(box["n"], 6).alias("n"), F.round(F.aggregate(F.element_at("geom.polys", 1), F.lit(0.0), lambda t, r: t + g.length(r)), 3).alias("length"))


def shape_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: lines, rings and points through the records of a shapefile and back."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("i", "x", "y"))), lambda p: g.vertex(p["x"], p["y"]))
    rows = points(spark, sf_dir).groupBy("user_id").agg(line.alias("line"))
    ring = F.concat("line", F.slice("line", 1, 1))
    kind = F.when(F.size("line") < 3, "Point").when(F.col("user_id") % 3 == 0, "Polygon").when(F.col("user_id") % 3 == 1, "MultiLineString").otherwise("LineString")
    half = F.floor(F.size("line") / 2).cast("int")
    polys = F.when(kind == "Point", F.array(F.array(F.slice("line", 1, 1)))).when(kind == "Polygon", F.array(F.array(ring))).when(kind == "MultiLineString", F.array(F.array(F.slice("line", 1, half), F.slice("line", half + 1, F.size("line"))))).otherwise(F.array(F.array("line")))
    made = rows.select("user_id", F.struct(kind.alias("gtype"), polys.alias("polys")).cast(GEOMETRY).alias("geom"))
    tuples = lambda polys: [[[(p["x"], p["y"]) for p in r] for r in poly] for poly in polys]

    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [shapefile.shape_of(shapefile.content_of(s["gtype"], tuples(s["polys"]))) for s in batch.column(1).to_pylist()]
            polys = [[[[{"x": x, "y": y} for x, y in r] for r in p] for p in b[1]] for b in back]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in back], pa.string()), pa.array(polys, kind)], ["user_id", "gtype", "polys"])

    ship(spark)
    out = made.mapInArrow(run, "user_id long, gtype string, polys array<array<array<struct<x: double, y: double>>>>")
    flat = F.flatten(F.flatten("polys"))
    area = F.when(F.col("gtype") == "Polygon", F.round(g.signed_area(F.element_at(F.element_at("polys", 1), 1)), 3))
    return out.select("user_id", "gtype", F.size(flat).alias("n_vertices"), F.size(F.element_at("polys", 1)).alias("n_parts"), F.round(F.aggregate(flat, F.lit(0.0), lambda t, p: t + p["x"]), 3).alias("x_sum"), area.alias("area"))


def download_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of several origins judged as the format that they are said to be; how many of each verdict."""
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("path"), F.col("html").cast("binary").alias("content"), F.lit("geojson").alias("expected"), F.lit(None).cast("string").alias("kind"), F.lit(200).alias("status"))
    props = table(spark, sf_dir, "events").select(F.lit("props"), F.col("props").cast("binary"), F.lit("geojson"), F.when(F.col("event_id") % 7 == 0, "Text/HTML; charset=utf-8"), F.when(F.col("event_id") % 11 == 0, 404).otherwise(200))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.coalesce("props", F.lit("{}")), F.lit("}"))
    whole = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("j"))
    sound = whole.select(F.lit("collections"), F.when(F.col("user_id") % 5 == 0, F.expr("substring(j, 1, length(j) - 1)")).otherwise(F.col("j")).cast("binary"), F.lit("geojson"), F.lit(None).cast("string"), F.lit(200))
    texts = table(spark, sf_dir, "documents").select(F.lit("texts"), F.col("text").cast("binary"), F.when(F.col("doc_id") % 2 == 0, "zip").otherwise("geopackage"), F.lit(None).cast("string"), F.lit(200))
    found = downloads.judged(pages.union(props).union(sound).union(texts), "content", F.col("expected"), F.col("kind"), F.col("status"))
    return found.groupBy(F.col("path").alias("origin"), F.coalesce("problem", F.lit("sound")).alias("verdict")).agg(F.count("*").alias("n"))


def geometry_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each polyline, of it reversed, and of its two halves in either order; ids of the two ways are equal."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("i", "x", "y"))), lambda p: g.vertex(p["x"], p["y"]))
    rows = points(spark, sf_dir).groupBy("user_id").agg(line.alias("line")).where(F.size("line") > 3)
    half = F.floor(F.size("line") / 2).cast("int")
    one, two = F.slice("line", 1, half), F.slice("line", half + 1, F.size("line"))
    geom = lambda kind, *lines: F.struct(F.lit(kind).alias("gtype"), F.array(F.array(*lines)).alias("polys"))
    of = lambda s: wkb.feature_id(F.col("user_id"), F.col("user_id") % 6 + 1, s)
    return rows.select("user_id", of(geom("LineString", F.col("line"))).alias("id"), of(geom("LineString", F.reverse("line"))).alias("reversed"), of(geom("MultiLineString", one, two)).alias("parts"), of(geom("MultiLineString", F.reverse(two), one)).alias("parts_reordered"))


#: Expressions of a map style over customers: colour, width, whether a row is shown, and an opacity that follows the zoom.
COLOUR = ["case", ["==", ["get", "segment"], "BUILDING"], "#111111", ["in", ["get", "segment"], ["literal", ["AUTOMOBILE", "MACHINERY"]]], "#222222", ["coalesce", ["get", "missing"], "#333333"]]
WIDTH = ["*", 7, ["coalesce", ["get", "scale"], 1]]
SHOWN = ["all", ["!=", ["get", "nation"], 3], ["any", [">", ["get", "balance"], 0], ["==", ["get", "segment"], "FURNITURE"], ["!", ["has", "scale"]]]]
OPACITY = ["interpolate", ["linear"], ["zoom"], 5, 0.2, 9, ["match", ["get", "segment"], "BUILDING", 1, 0.5], 14, 0.8]
STEPPED = ["step", ["zoom"], 0, 6, 0.4, 12, ["get", "share"]]


def style_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style expressions as columns, and opacities scaled without touching the zoom."""
    known = {
        "segment": F.col("c_mktsegment"),
        "nation": F.col("c_nationkey"),
        "balance": F.col("c_acctbal"),
        "scale": F.when(F.col("c_custkey") % 3 == 0, F.lit(0.5)),
        "share": (F.col("c_custkey") % 10) / 10,
    }
    get = lambda name: known.get(name, F.lit(None).cast("string"))
    zoom = F.col("c_custkey") % 16 + 0.5
    of = lambda e: style.compile(e, get, zoom)
    return table(spark, sf_dir, "customer").select("c_custkey", of(COLOUR).alias("colour"), of(WIDTH).cast("double").alias("width"), of(SHOWN).alias("shown"), F.round(of(style.scaled(OPACITY, 0.5)), 6).alias("opacity"), F.round(of(style.scaled(STEPPED, 0.25)), 6).alias("stepped"))


def cloud_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stepped edges of a cloud bank for each customer's seed."""
    seeds = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2654435 + 7).alias("seed"))
    return clouds.edges(seeds).select("seed", "step", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def cloud_wisps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wisps of a cloud bank for each customer's seed."""
    seeds = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2654435 + 7).alias("seed"))
    return clouds.wisps(seeds).select("seed", "wisp", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height", "opacity")])


#: Draws of the cloud generator: k-th number of each seed, in wide integers held to 32 bits.
_DRAWS = """seeds AS (SELECT c_custkey * 2654435 + 7 AS seed FROM customer),
s0 AS (SELECT seed, k, CAST((seed + (k + 1) * 1831565813::HUGEINT) & 4294967295 AS HUGEINT) AS v FROM seeds, generate_series(0, 126) AS t(k)),
s1 AS (SELECT seed, k, (xor(v, v >> 15) * (v | 1)) & 4294967295 AS v FROM s0),
s2 AS (SELECT seed, k, xor(v, (v + ((xor(v, v >> 7) * (v | 61)) & 4294967295)) & 4294967295) AS v FROM s1),
draw AS (SELECT seed, k, CAST(xor(v, v >> 14) AS DOUBLE) / 4294967296.0 AS r FROM s2),
down AS (
  SELECT a.seed, n AS step, 85 + a.r * 95 AS high, 1010 + b.r * 220 AS x FROM generate_series(1, 13) AS t(n) JOIN draw a ON a.k = 2 * n - 1 JOIN draw b ON b.seed = a.seed AND b.k = 2 * n),
summed AS (SELECT *, sum(high) OVER (PARTITION BY seed ORDER BY step) AS y FROM down),
edge AS (
  SELECT seed, 0 AS step, 1030 + r * 180 AS x, 0.0 AS y FROM draw WHERE k = 0 UNION ALL
  SELECT seed, step, x, least(y, 1080.0) FROM summed WHERE y - high < 1080)"""

_STEPPED = POINTS.replace("pts AS", "exact AS", 1) + """,
pts AS (SELECT * REPLACE (floor(x * 1000) / 1000 AS x) FROM exact)"""

QUERIES = {f.__name__: f for f in (pbf_elements, pbf_features, shape_records, download_checks, geometry_ids, style_rules, cloud_edges, cloud_wisps)}

def _le(value: str, size: int) -> str:
    """Digits of a number's bytes, the last one first."""
    return " || ".join(f"substr({value}, {2 * k + 1}, 2)" for k in reversed(range(size)))


_BITS = "hex(CAST(CAST({} AS BIT) AS BLOB))"


def _way(condition: str) -> str:
    """Digits of the line over some vertices, by the lesser of its directions; one expression of the group."""
    n = _le(f"printf('%08X', CAST(count(*) FILTER ({condition}) AS BIGINT))", 4)
    return f"'0102000000' || {n} || least(string_agg(d, '' ORDER BY i) FILTER ({condition}), string_agg(d, '' ORDER BY i DESC) FILTER ({condition}))"


def _id(digits: str) -> str:
    return f"'n13-' || substr(sha256(encode(CAST(user_id AS VARCHAR)) || '\\x00'::BLOB || encode(CAST(user_id % 6 + 1 AS VARCHAR)) || '\\x00'::BLOB || unhex({digits})), 1, 24)"


ORACLE = {
    "geometry_ids": f"""WITH {POINTS},
num AS (SELECT user_id, i, {_BITS.format("x")} AS a, {_BITS.format("y")} AS b, count(*) OVER (PARTITION BY user_id) AS n FROM pts),
v AS (SELECT user_id, i, n, {_le("a", 8)} || {_le("b", 8)} AS d FROM num WHERE n > 3),
h AS (SELECT user_id, {_way("true")} AS whole, {_way("i < n // 2")} AS one, {_way("i >= n // 2")} AS two FROM v GROUP BY user_id)
SELECT user_id, {_id("whole")} AS id, {_id("whole")} AS reversed, {_id("least(one, two) || greatest(one, two)")} AS parts, {_id("least(one, two) || greatest(one, two)")} AS parts_reordered FROM h""",
    "pbf_elements": f"""WITH {_STEPPED}
SELECT 'node' AS element_type, event_id AS element_id, 'kind=' || event_type AS tags, round(x, 6) AS lon, round(y, 6) AS lat, 0 AS n_refs, CAST(0 AS BIGINT) AS ref_sum, CAST(NULL AS VARCHAR) AS members FROM pts
UNION ALL SELECT 'way', user_id, CASE WHEN user_id % 4 = 0 THEN 'highway=path' WHEN user_id % 3 = 0 THEN 'railway=subway' ELSE 'railway=rail' END, NULL, NULL, CAST(count(*) AS INTEGER), CAST(sum(event_id * (i + 1)) AS BIGINT), NULL FROM pts GROUP BY user_id
UNION ALL SELECT 'relation', user_id // 10 + 1, 'route=r' || (user_id // 10), NULL, NULL, 0, 0, string_agg(user_id || CASE WHEN user_id % 2 = 0 THEN 'even' ELSE '' END, ',' ORDER BY user_id) FROM (SELECT DISTINCT user_id FROM pts) GROUP BY user_id // 10""",
    "pbf_features": f"""WITH {_STEPPED},
seg AS (SELECT user_id, i, x, y, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS size FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY i)),
way AS (SELECT user_id, count(*) AS n, min(x) AS w, max(y) AS top, coalesce(sum(size), 0) AS length FROM seg GROUP BY user_id)
SELECT 'way/' || user_id AS id, 'LineString' AS gtype, 1 AS n_lines, CAST(n AS INTEGER) AS n_vertices, round(w, 6) AS w, round(top, 6) AS n, round(length, 3) AS length FROM way WHERE user_id % 4 != 0 AND n > 1
UNION ALL SELECT 'relation/' || (user_id // 10 + 1), 'MultiLineString', CAST(count(*) AS INTEGER), CAST(sum(n) AS INTEGER), round(min(w), 6), round(max(top), 6), round(sum(length), 3) FROM way WHERE n > 1 GROUP BY user_id // 10""",
    "shape_records": f"""WITH {POINTS},
e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY i)),
s AS (SELECT user_id, count(*) AS n, sum(x) AS xs, arg_min(x, i) AS fx, abs(sum(x * ny - nx * y) / 2) AS area FROM e GROUP BY user_id),
t AS (SELECT *, CASE WHEN n < 3 THEN 'Point' WHEN user_id % 3 = 0 THEN 'Polygon' WHEN user_id % 3 = 1 THEN 'MultiLineString' ELSE 'LineString' END AS gtype FROM s)
SELECT user_id, gtype, CAST(CASE gtype WHEN 'Point' THEN 1 WHEN 'Polygon' THEN n + 1 ELSE n END AS INTEGER) AS n_vertices, CASE gtype WHEN 'MultiLineString' THEN 2 ELSE 1 END AS n_parts,
  round(CASE gtype WHEN 'Point' THEN fx WHEN 'Polygon' THEN xs + fx ELSE xs END, 3) AS x_sum, CASE gtype WHEN 'Polygon' THEN round(-area, 3) END AS area FROM t""",
    "download_checks": """WITH lead AS (SELECT lower(ltrim(substr(html, 1, 512), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS h FROM pages),
f AS (
  SELECT 'pages' AS origin, CASE WHEN starts_with(h, '<!doctype html') OR starts_with(h, '<html') THEN 'an HTML document' ELSE 'not valid JSON' END AS verdict FROM lead
  UNION ALL SELECT 'props', CASE WHEN event_id % 11 = 0 THEN 'not a success status' WHEN props IS NULL THEN 'no content' WHEN event_id % 7 = 0 THEN 'an HTML document' WHEN json_valid(props) THEN 'not a FeatureCollection' ELSE 'not valid JSON' END FROM events
  UNION ALL SELECT 'collections', CASE WHEN user_id % 5 = 0 THEN 'not valid JSON' ELSE 'sound' END FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT 'texts', CASE WHEN text IS NULL THEN 'no content' WHEN doc_id % 2 = 0 THEN 'not a ZIP archive' ELSE 'no SQLite header' END FROM documents)
SELECT origin, verdict, count(*) AS n FROM f GROUP BY origin, verdict""",
    "style_rules": """SELECT c_custkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '#111111' WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN '#222222' ELSE '#333333' END AS colour,
  CASE WHEN c_custkey % 3 = 0 THEN 3.5 ELSE 7.0 END AS width,
  (c_nationkey IS NULL OR c_nationkey != 3) AND (coalesce(c_acctbal > 0, false) OR coalesce(c_mktsegment = 'FURNITURE', false) OR c_custkey % 3 != 0) AS shown,
  round(CASE WHEN z >= 14 THEN 0.4 WHEN z >= 9 THEN m + (0.4 - m) * (z - 9) / 5 WHEN z >= 5 THEN 0.1 + (m - 0.1) * (z - 5) / 4 ELSE 0.1 END, 6) AS opacity,
  round(CASE WHEN z >= 12 THEN (c_custkey % 10) / 10 * 0.25 WHEN z >= 6 THEN 0.1 ELSE 0 END, 6) AS stepped
FROM (SELECT *, c_custkey % 16 + 0.5::DOUBLE AS z, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5::DOUBLE ELSE 0.25 END AS m FROM customer)""",
    "cloud_edges": f"WITH {_DRAWS} SELECT seed, CAST(step AS INTEGER) AS step, round(x, 6) AS x, round(y, 6) AS y FROM edge",
    "cloud_wisps": f"""WITH {_DRAWS},
used AS (SELECT seed, 1 + 2 * max(step) AS used FROM edge GROUP BY seed),
w AS (SELECT u.seed, n, j, d.r FROM used u, generate_series(0, 19) AS t(n), generate_series(0, 4) AS v(j) JOIN draw d ON d.seed = u.seed AND d.k = u.used + 5 * n + j)
SELECT seed, CAST(n AS INTEGER) AS wisp, round(55 + max(r) FILTER (j = 0) * 620, 6) AS x, round(n / 20 * 1080.0 + (max(r) FILTER (j = 1) - 0.5) * 54, 6) AS y,
  round(170 + max(r) FILTER (j = 2) * 410, 6) AS width, round(22 + max(r) FILTER (j = 3) * 34, 6) AS height, round(0.18 + max(r) FILTER (j = 4) * 0.22, 6) AS opacity FROM w GROUP BY seed, n""",
}
