"""Operators that work on one text at a time, against the libraries and brute force."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfold.llm import language_id, quality_model, quality_rules, sentence_pieces, token_counts, url_filter

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["", "a", " ", "  ", "\n", "a\n\nb", "a  b", "it's we'll 'S ''s", "x<|endoftext|>y <|endoftext|>", " a\tb ", "’s 中文 ﬁ①²½", "a\x85b\xa0c\x1cd", "été\u0301 ß", "1,000.50!!", "#" * 70, "word " * 300, "\U0001f600 \u200d x", "end. \nNext", "A,B. C,"]


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_counts_equal_the_library(counter, library):
    assert counter.count(TRICKY) == [len(library.encode(t, add_special_tokens=False).ids) for t in TRICKY]
    assert counter.count([None]) == [0]


def test_counts_of_every_plain_character(counter, library):
    texts = [f"a{c}b {c} {c}{c}x 1{c}2\n{c}" for c in map(chr, [*range(0x250), *range(0x2010, 0x2028), 0x20AC])]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab Z'sé,.\n\t1 <|>中ﬁ\xa0"), max_size=60))
def test_counts_of_any_text(counter, library, text):
    assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def brute_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(inside)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_windows_equal_brute_force(words):
    assert quality_rules.repeated_words(words) == brute_repeats(words)


def test_base_counts():
    assert quality_rules.base_counts(None) == (0, 0, 0, 0, 0)
    assert quality_rules.base_counts("a\u00a0b #1\n \nx\n x\nx\n") == (5, 8, 1, 1, 0)


def test_bands_reject_repetition_and_noise():
    z = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    rng = random.Random(1)
    prose = " ".join("".join(rng.choices("aeionrst", k=rng.randint(2, 9))) for _ in range(900)).encode()
    assert quality_rules.bands(prose, z)[3]
    assert not quality_rules.bands(b"spam eggs " * 900, z)[3]
    assert not quality_rules.bands(bytes(rng.choices(range(33, 127), k=6000)) + rng.randbytes(3000), z)[3]
    assert quality_rules.bands(b"", z) == (0.0, 0, 0, False)
    parts = quality_rules.bands(prose[:4096] + b"x" * 4096 * 5, z)
    assert parts[2] == 6 and parts[1] == 5


SIZES = [100, 160, 224, 330, 450, 900, 1400, 1900, 2800, 4000, 8000, 12000, 30000, 60000, 120000]


@pytest.mark.parametrize(
    ("alphabet", "least"),
    [
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 100),
        ("".join(map(chr, range(33, 127))), 100),
        ("abcdefghijklmnopqrstuvwxyz", 2800),  # shorter ones compress as prose does
        ("абвгдежзийклмнопрстуфхцчшщъыьэюя", 12000),
    ],
)
def test_bands_reject_random_strings_of_every_length(alphabet, least):
    z = zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_checksum=False)
    rng = random.Random(2)
    for n in SIZES:
        for _ in range(3 if n >= least else 0):
            text = " ".join("".join(rng.choices(alphabet, k=rng.randint(3, 10))) for _ in range(n // 4)).encode()[:n]
            assert not quality_rules.bands(text, z)[3], n


def test_bands_keep_prose_of_every_length():
    from pydoc_data import topics

    z = zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_checksum=False)
    prose = "\n".join(topics.topics[k] for k in sorted(topics.topics)).encode()
    for n in SIZES:
        kept = [quality_rules.bands(prose[a : a + n], z)[3] for a in range(0, len(prose) - n, max(n, len(prose) // 100))]
        assert sum(kept) >= 0.97 * len(kept), n


def judged(rules, url):
    host, path = url_filter.parts(url)
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), v == "block", h + p, v)
            best = max(best or key, key)
    return (best[3], best[4]) if best else (None, url_filter.DEFAULT)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "", "block"), ("a.org", "/x/yz", "allow"), ("b.a.org", "/x/", "block"), ("", "/zz", "block")]


def test_trie_equals_brute_force():
    trie = url_filter.Trie(RULES)
    hosts = ["net", "x.net", "xnet", "example.net", "a.example.net", "example.com", "org", "a.org", "b.a.org", "c.b.a.org", "", "EXAMPLE.net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/", "/fr/a", "/x/yz", "/x/y", "/x/yzz/q", "/zz", "/en/?q=/de/", "#/en/"]
    for h, p in itertools.product(hosts, paths):
        url = f"http://{h}{p}"
        assert trie.match(*url_filter.parts(url)) == judged(RULES, url), url


@pytest.mark.parametrize(("url", "found"), [(None, ("", "")), ("no scheme", ("", "")), ("http://A.É.com?x=/y", ("a.É.com", "")), ("x://h#f/g", ("h", "")), ("http://h/p/q?r#s", ("h", "/p/q")), ("a://b://c/d", ("b:", "//c/d"))])
def test_url_parts(url, found):
    assert url_filter.parts(url) == found


def test_url_queries_agree(spark):
    urls = [(1, "http://x.net/en/1"), (2, None), (2, None), (3, "http://a.org/x/yzz"), (4, "nothing"), (5, "http://q.example.com/de/?a")]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in urls], "page_id long, url string, host string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("x.net", None, "allow")], "host string, path string, verdict string")
    one, two = url_filter.url_filter(pages, rules), url_filter._joined(pages.select("page_id", "url"), rules)
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)
    assert url_filter.url_filter(pages, []).where("verdict != 'allow'").count() == 0
    assert url_filter.url_filter(pages.limit(0), RULES).count() == 0


@pytest.fixture(scope="module")
def solver():
    return sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 4)


def every_way(solver, chunk):
    out = []

    def go(i, score, ids):
        if i == len(chunk):
            out.append((score, tuple(ids)))
        else:
            for j, s, x in solver.edges(chunk, i):
                go(j, score + s, [*ids, *x])

    go(0, 0, [])
    return sorted(out, reverse=True)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="thea n①\né", max_size=10))
def test_nbest_equals_enumeration(solver, text):
    found = solver.nbest_ids(text)
    ways = every_way(solver, "".join(solver.split(text)))
    assert [round(s * sentence_pieces.UNIT) for s, _ in found] == [s for s, _ in ways[:4]]
    assert len({tuple(i) for _, i in found}) == len(found) and {tuple(i) for _, i in found} <= {i for _, i in ways}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoding_round_trips_as_the_library_decodes(solver, text):
    ids = solver.encode(text)[0]
    assert solver.decode(ids) == text.replace("▁", " ") == solver.library.decode(ids.tolist())


def test_block_and_single_solutions_agree():
    a, b = (sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 4) for _ in range(2))
    chunks = ["▁the", "▁theatre", "①", "▁x①y", "▁" * 5, "a" * 33, "b" * 40, "日本語", "▁thinner."]
    a.solve_many(chunks)
    for c in chunks:
        k, j = a.at[c], b.solve(c)
        pick = lambda p, n: (int(p.best[n]), int(p.loss[n]), p.pool[p.first[n] : p.first[n] + p.length[n]].tolist())
        assert pick(a, k) == pick(b, j)


def test_encode_and_decode_rows(spark, documents):
    rows = [(1, "the cat"), (1, "the cat"), (2, None), (None, ""), (3, "x" * 5000 + "\n①  y")]
    found = sentence_pieces.decode(sentence_pieces.encode(documents(rows), keep=["doc_id", "lang"]), into="back")
    assert sorted((r["doc_id"] or 0, r["back"], r["round_trip"]) for r in found.collect()) == sorted((i or 0, t or "", True) for i, t in rows)
    assert sentence_pieces.encode(documents([]), keep=["doc_id"]).count() == 0


def test_segmentations_have_the_ids_of_every_way(spark, documents, solver):
    texts = ["the theatre", "x", "", "a line\nand  ①another, longer one that has many ways", None, "日本 the"]
    found = sentence_pieces.segmentations(sentence_pieces.encode(documents(list(enumerate(texts))), keep=["doc_id"]))
    got = sorted((r["doc_id"], r["rank"], r["score"], list(r["ids"])) for r in found.collect())
    assert got == [(d, k, s, i) for d, t in enumerate(texts) for k, (s, i) in enumerate(solver.nbest_ids(t), 1)]
    back = sentence_pieces.decode(found, into="back").collect()
    assert len(back) > 12 and all(r["back"] == (texts[r["doc_id"]] or "") for r in back)


def test_the_best_path_is_as_short_as_the_library_s(solver):
    from pydoc_data import topics

    texts = [topics.topics[k] for k in sorted(topics.topics)][:40]
    mine, merged = (sum(map(len, x)) for x in ([solver.encode(t)[0] for t in texts], [solver.library.encode(t) for t in texts]))
    assert 0.95 * merged <= mine <= merged


def sample(rng, letters, n=40):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n))


def test_language_is_learned_and_unknown_text_rejected(spark):
    rng = random.Random(2)
    kinds = {"xx": "abcdeé", "yy": "pqrstü"}
    rows = [(i, sample(rng, kinds[k]), k) for i, k in enumerate(["xx", "yy"] * 60)] + [(500, None, "xx"), (501, "123 !?", "yy"), (502, sample(rng, kinds["xx"]), None), (502, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, per_language=40)
    found = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(found[i]["lang_pred"] == k for i, _, k in rows[:120])
    assert (found[500]["lang_pred"], found[500]["score"], found[500]["rejected"]) == ("und", 0.0, True) and found[501]["lang_pred"] == "und"
    kept = language_id.identify(docs, model, keep=True)
    assert kept.columns == docs.columns and kept.where("doc_id >= 500 and doc_id < 502").count() == 0 and kept.where("doc_id < 120").count() == 120
    nothing = language_id.fit(docs.where("lang is null"))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), nothing).count() == 0


def test_language_sample_meets_any_id(spark):
    """Negative, null and repeated ids; a hot id and a hot copy don't fill the sample."""
    rng = random.Random(3)
    kinds = {"xx": "abcde", "yy": "pqrst"}
    rows = [(rng.choice([-5, None, -(1 << 62), 7]), sample(rng, kinds[k]), k) for k in ["xx", "yy"] * 40] + [(-9, "abcde edcba " * 20, "xx")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for model in (language_id.fit(docs, per_language=20), language_id.fit(docs, sample_bytes=9000)):
        found = language_id.identify(docs, model).collect()
        assert len(found) == len(rows) and {r["lang_pred"] for r in found} == {"xx", "yy"}


def test_every_language_is_learned(spark):
    rows = [(k * 2 + i, f"word{chr(97 + k // 26)}{chr(97 + k % 26)} text", f"l{k}") for k in range(230) for i in range(2)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {f"l{k}" for k in range(230)}


def test_word_sums_equal_whole_text_features():
    model = language_id.train([("a", *language_id.features([b"abc", b"de"])), ("b", *language_id.features([b"xyz"]))], [])
    words = [b"abc", b"abc", b"xyz", b"q"]
    buckets = language_id.subwords(words)[0]
    table = language_id.WordTable(model.rows)
    sums = table.sums([words])[0]
    assert sums[0] == len(buckets) and np.allclose(sums[1:], model.table[buckets].sum(0), atol=1e-5)


def test_ordinal_model_orders_grades(spark):
    rng = random.Random(5)
    base = lambda: [sample(rng, "etaoin", 1) for _ in range(40)]
    rows, grades = [], []
    for i in range(300):
        words, grade = base(), i % 3
        if grade == 0:
            words[rng.randrange(40)] = rng.choice(["vile", "rotten"])
        if grade == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        grades.append((i, grade))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (0, rows[0][1])], "doc_id long, text string")
    ratings = spark.createDataFrame([*grades, (5, None), (None, 2), (7, 2)], "doc_id long, grade int")
    model = quality_model.fit(docs, ratings)
    assert list(model.thresholds) == sorted(model.thresholds)
    found = {r["doc_id"]: r for r in quality_model.grade(docs, model).collect()}
    right = sum(round(found[i]["expected_grade"]) == g and found[i]["kept"] == (g == 2) for i, g in grades)
    assert right >= 285 and not found[900]["kept"] and not found[901]["kept"]
    assert not quality_model.grade(docs, quality_model.fit(docs, ratings.limit(0))).where("kept").count()


@pytest.mark.parametrize("operator", ["token_counts", "quality_rules"])
def test_row_operators_meet_odd_rows(spark, documents, operator):
    rows = [(1, None), (2, ""), (3, "word " * 3000), (3, "word " * 3000), (None, "x\ud7ff\n\n  y")]
    make = {"token_counts": token_counts.token_counts, "quality_rules": quality_rules.quality_rules}[operator]
    found = make(documents(rows)).collect()
    assert len(found) == 5 and make(documents([])).count() == 0
    if operator == "token_counts":
        assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found)[:2] == [(0, 0, False)] * 2
    else:
        assert not any(r["kept"] for r in found)
