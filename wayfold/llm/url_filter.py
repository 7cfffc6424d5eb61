"""URL filters: a trie over reversed host labels and path segments, broadcast, where the longest rule wins.

A rule is (host, path, verdict).  It fits its host and every subdomain, if the URL's path starts with the rule's path,
character by character.  The trie goes down the host's labels from the last one; at a node where a rule's host ends hangs
a second trie over whole path segments, whose nodes hold the rules whose path ends there, with the rule's unfinished last
segment beside it.  One walk meets every rule that fits; the one with the longest "host + path" wins, then the longer host,
then ``block``.  A URL that no rule fits gets ``DEFAULT``.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path goes
on up to ``?``, ``#`` or the end.  A null URL, or one without ``://``, has an empty host and path.  Repeated rows give
repeated rows; an empty rule list is allowed.  A rule with a null part fits nothing.

The trie is broadcast only up to ``MAX_BROADCAST`` rules.  A longer list is joined instead: each URL's host suffixes meet the
rules' hosts in an equi-join, with distinct (host, path) made first so that a hot page costs one row.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import ship

MAX_BROADCAST = 200_000
DEFAULT = "allow"
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
Rule = tuple[str, str, str]


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for c in "?#":
        rest = rest.partition(c)[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path  # bytes lower-case A-Z alone


class Trie:
    """Nested dicts; ``None`` is the key of a host node's path trie, ``""`` of the rules at a path node."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for host, path, verdict in rules:
            if host is None or path is None or verdict is None:
                continue
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(f"/{segment}", {})
            node.setdefault("", []).append((last, len(host) + len(path), len(host), verdict == "block", host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str]:
        best: tuple = (-1,)
        segments = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get(None)
            for segment in segments:
                if below is None:
                    break
                for last, *found in below.get("", ()):
                    if segment.startswith(last):
                        best = max(best, tuple(found))
                below = below.get(f"/{segment}")
        return (best[3], best[4]) if len(best) > 1 else (None, DEFAULT)


def url_filter(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    if isinstance(rules, DataFrame):
        some = rules.select("host", "path", "verdict").limit(MAX_BROADCAST + 1).collect()
        if len(some) > MAX_BROADCAST:
            return _joined(rows, rules)
        rules = [tuple(r) for r in some]
    elif len(rules) > MAX_BROADCAST:
        return _joined(rows, pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string"))
    ship(pages.sparkSession)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches):
        for batch in batches:
            split = [parts(u) for u in batch.column(1).to_pylist()]
            found = [trie.value.match(*x) for x in split]
            columns = [[x[0] for x in split], [x[1] for x in split], [x[0] for x in found], [x[1] for x in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, SCHEMA)


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The same result for a rule list too long to broadcast."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    split = rows.withColumn("rest", rest).select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", r"(?s)^[^/]*(.*)$", 1).alias("path"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = split.select("host", "path").distinct()
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).dropna().distinct()
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("rule_verdict") == "block", F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")
    best = (
        hosts.select("host", "path", F.explode(suffixes).alias("rule_host"))
        .join(named, "rule_host")
        .where(F.expr("startswith(path, rule_path)"))
        .groupBy("host", "path")
        .agg(F.max(rank).alias("best"))
    )
    return split.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(DEFAULT)).alias("verdict"))
