"""The queries that apply this subpackage's operators to whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import decontaminate, divergence, fill_in_middle, language_id, line_dedup, media, quality_model, quality_rules, sentence_pieces, simhash, span_dedup, token_counts, url_filter
from wayfold.llm.common import cut, table

#: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def grades(labels: DataFrame) -> DataFrame:
    """Grade 0 for toxic texts, 1 for others of low quality, 2 for the rest."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.grade(docs, quality_model.fit(docs, grades(table(spark, sf_dir, "labels"))))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id are neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, where=~held_out())
    return language_id.identify(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = cut(span_dedup.covered(docs))
    left = span_dedup.rewritten(docs.withColumn("row", F.xxhash64("text")), found, all_rows=False)
    return found.join(left, ["doc_id", "row"]).select("doc_id", "n_sentences", F.size("removed").alias("n_removed"), "removed", "first_ids", "text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), RULES)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.columns(media.store(table(spark, sf_dir, "documents")), keep=("n_bytes",))
    one = found.withColumn("track", F.element_at("tracks", 1)).withColumn("payload", media.payload(F.col("media"), F.col("track.ranges")))
    last = F.substring("payload", -media.UNIT, media.UNIT)
    feature = F.to_json(F.struct("track.codec", "track.timescale", "track.duration", "track.n_samples", "track.keyframes"))
    return one.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(last).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        F.col("track.codec").alias("codec"),
        (F.col("track.duration") / F.col("track.timescale")).alias("seconds"),
        F.size("track.keyframes").alias("n_keyframes"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_quality_classifier,
        op3_language_id,
        op4_substring_dedup,
        op5_line_dedup,
        op6_url_filters,
        op7_simhash,
        op8_token_counts,
        op9_quality_rules,
        op10_sentence_pieces,
        op11_fill_in_middle,
        op12_source_divergence,
        op13_media_columns,
    )
}

ORACLE: dict[str, str] = {
    "op6_url_filters": """
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rests AS (
  SELECT page_id, CASE WHEN coalesce(position('://' IN url), 0) = 0 THEN ''
    ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^([^?#]*)', 1) END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^([^/]*)', 1) AS raw FROM rests),
split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(raw) + 1) AS path FROM hosts),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM split)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (host, path)
""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT row, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
  FROM cell JOIN size USING (lang)),
l AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cell GROUP BY lang, term) JOIN size USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((
    SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source),
apart AS (SELECT p.lang, p.source, p.term AS item, p.p - l.q AS value FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM apart)
WHERE rank <= 50
""",
}
