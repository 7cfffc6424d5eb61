"""Source divergence against term-by-term sums in plain Python, and against the query's SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from wayfold.llm import divergence as dv
from wayfold.llm.queries import ORACLE, op12_source_divergence


def brute(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        have = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in have.items() if n >= least)
        v = len(kept)
        counts = defaultdict(Counter)
        for _, source, words in mine:
            counts[source].update(w for w in words if w in set(kept))
        everything = sum(counts.values(), Counter())

        def share(c, t, v=v, kept=kept):
            return 1 + (1_000_000_000 * (c[t] + 5)) // (sum(c[k] for k in kept) + 5 * v)

        sources = {d[1] for d in mine}
        for one in sources:
            pairs = [(-sum(abs(share(counts[one], t) - share(counts[two], t)) for t in kept), two.encode()) for two in sources - {one}]
            out += [(lang, one, "pair", two.decode(), -d, k) for k, (d, two) in enumerate(sorted(pairs), 1)]
            over = [(share(everything, t) - share(counts[one], t), t.encode()) for t in kept if counts[one][t] > 0]
            out += [(lang, one, "term", t.decode(), -d, k) for k, (d, t) in enumerate(sorted(x for x in over if x[0] < 0), 1) if k <= top]
    return sorted(out)


def made_up(n, seed):
    r = random.Random(seed)
    words = ["Alpha", "beta", "gamma2delta", "Été", "日本", "tie", "TIE", "é", "z_z", "\U0001f600"]
    rows = [(r.choice(["en", "en", "en", "de", None, "fr"]), r.choice(["hot", "hot", "hot", "a", "b", "ü", None]), " ".join(r.choices(words, k=r.randint(0, 12)))) for _ in range(n)]
    return rows + [("lone", "only", "words of one source"), ("void", "x", None), ("void", "y", ""), ("en", "silent", None), ("en", "silent", "12 34")]


@pytest.mark.parametrize("least,top,seed", [(1, 50, 1), (5, 3, 2), (30, 50, 3), (10_000, 50, 4)])
def test_equals_term_by_term_sums(spark, least, top, seed):
    rows = made_up(300, seed)
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    found = dv.divergence(frame, least=least, top=top).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found) == brute(rows, least, top)


def test_small_dictionaries_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(dv, "HELD", 3)
    rows = made_up(200, 9)
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    whole = sorted(map(tuple, dv.counted(frame).collect()))
    assert sum(n for *_, n, _ in whole) == sum(len(dv.terms(t)) for *_, t in rows)
    assert {(a, b, t): d for a, b, t, _, d in whole} == Counter((a or "", b or "", w.decode()) for a, b, t in rows for w in set(dv.terms(t)))


def test_cells_count_every_kept_term(spark):
    rows = made_up(300, 5)
    kept = dv.cut(dv.kept_terms(dv.counted(spark.createDataFrame(rows, "lang string, source string, text string")), 3))
    groups = spark.createDataFrame(sorted({(a or "", b or "") for a, b, _ in rows}), "lang string, source string")
    facts = dv.totals(groups, kept)
    one = facts.selectExpr("lang", "source as one", "have as have1", "kinds")
    two = facts.selectExpr("lang", "source as two", "have as have2")
    found = dv.cells(kept, one.join(two, "lang").where("one < two")).collect()
    kinds = {r.lang: r.kinds for r in facts.collect()}
    total = Counter()
    for r in found:
        assert r.m > 0
        total[(r.lang, r.one, r.two)] += r.m
    assert total and all(n == kinds[k[0]] for k, n in total.items())
    assert len({(r.lang, r.one, r.two, r.x, r.y) for r in found}) == len(found)


@pytest.mark.parametrize("count,total,kinds", [(0, 0, 0), (0, 0, 7), (3, 10, 2), (8_000_000_000_000_000, 9_000_000_000_000_000, 1000), (123_456_789_012, 999_999_999_999_989, 333_333)])
def test_share_is_exact(spark, count, total, kinds):
    from pyspark.sql import functions as F

    got = spark.range(1).select(dv.share(F.lit(count), F.lit(total), F.lit(kinds)).alias("p")).first().p
    assert got == (1 + 1_000_000_000 * (count + 5) // (total + 5 * kinds) if total + 5 * kinds else got)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    names = ["lang", "source", "part", "item", "value", "rank"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE['op12_source_divergence']})").fetchall())
    assert sorted(map(tuple, op12_source_divergence(spark, folder).select(*names).collect())) == want


def test_empty_table_and_clashing_columns(spark):
    frame = spark.createDataFrame([("en", "a", "x y", 1, 2)], "lang string, source string, text string, term long, `c.n` long")
    assert dv.divergence(frame.limit(0)).count() == 0
    assert dv.divergence(frame, least=1).count() == 0  # a single group equals its language
    assert dv.divergence(frame.selectExpr("lang as l", "source as s", "text as t"), "t", "l", "s", least=1).count() == 0
