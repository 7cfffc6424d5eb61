"""Fill-in-middle against plain slicing of Python strings, and exact round trips."""

import hashlib

import pytest
from pyspark.sql import functions as F

from wayfold.llm import fill_in_middle as fim

TEXTS = ["", None, "a", "two words", "ends with blank ", "  ", "x\r\ny\n\nz\t", "é é \U0001f600‍\U0001f680", "has <P> inside", "<S>", "a<M>b", "<P", "P><", "<<", "nul\x00 byte", " line sep", "y" * 40_000, "word " * 30_000, "日本" * 3000]


def plain(doc_id, text):
    """The contract, word for word."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_equals_slicing_and_restores(spark, documents):
    rows = [(i, t) for i, t in enumerate(TEXTS * 8)] + [(3, "two words"), (None, "no id here"), (-7, "negative id")]
    made = fim.fill_in_middle(documents(rows)).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=key) == sorted(((i, *plain(i, t)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.back) for r in made), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_offsets_are_the_librarys(text):
    """The offsets of runs, one behind the other, are those of the whole text."""
    of = fim.Units()
    whole = [start for _, (start, _) in of.split.pre_tokenize_str(text)]
    assert whole == list(range(len(text)))
    n, _ = of.slices(text, [0])
    assert n == len(whole)
    ranks = [*range(0, n + 1, max(1, n // 97)), n]
    assert of.slices(text, ranks)[1] == sorted([*whole, n][r] for r in ranks)


def test_marks_and_rates(spark, documents):
    rows = documents([(i, f"some text number {i}") for i in range(200)])
    assert {r.form for r in fim.fill_in_middle(rows, rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(rows, rate=100, suffix_first=100).collect()} == {"spm"}
    own = fim.fill_in_middle(rows, rate=100, suffix_first=0, marks=("[pre]", "[suffix]", "[mid]"))
    back = own.select("doc_id", fim.restored(F.col("form"), F.col("output"), ("[pre]", "[suffix]", "[mid]")).alias("back")).collect()
    assert {(r.doc_id, r.back) for r in back} == {(i, f"some text number {i}") for i in range(200)}


def test_dictionary_is_bounded(monkeypatch):
    monkeypatch.setattr(fim, "CACHE", 10)
    of = fim.Units()
    for k in range(50):
        assert of.slices(f"alpha{k} beta{k}", [0])[0] == len(f"alpha{k} beta{k}")
    assert len(of.counts) <= 14


def test_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "some text", 5, "x")], "id long, body string, n long, `row.text` string")
    assert fim.fill_in_middle(rows, "id", "body").columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.fill_in_middle(rows, "id", "body").first().n == 9
    assert fim.fill_in_middle(rows.limit(0), "id", "body").count() == 0
