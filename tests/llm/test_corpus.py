"""Operators over a corpus, against brute force on small tables."""

import random
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from pyspark.sql import functions as F

from wayfold.llm import decontaminate, language_id, line_dedup, simhash, span_dedup
from wayfold.llm.queries import ORACLE, QUERIES


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def removed_by_brute_force(rows):
    lines = sorted((d, i, x) for d, t in rows for i, x in enumerate(line_dedup.lines_of(t)) if len(x) >= line_dedup.MIN_CHARS)
    out = {}
    for k, (d, i, x) in enumerate(lines):
        if any(one_edit(x, y) and (e, j) != (d, i) for e, j, y in lines[:k]):
            out.setdefault(d, []).append(i)
    return out


def edited(rng, line):
    k = rng.randrange(len(line))
    return rng.choice([line[:k] + line[k + 1 :], line[:k] + rng.choice("xyz ü") + line[k:], line[:k] + "Q" + line[k + 1 :], line])


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup_equals_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abc de", k=rng.choice([24, 25, 31, 32, 33, 63, 64, 65, 100, 400]))).strip().ljust(24, "k") for _ in range(25)]
    rows = [(d, "\n".join(edited(rng, edited(rng, rng.choice(base))) if rng.random() < 0.7 else "short" for _ in range(rng.randint(1, 6)))) for d in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "a" * 30000)]
    found = {r["doc_id"]: [x["i"] for x in r["removed"]] for r in line_dedup.line_report(documents(rows)).collect()}
    expected = removed_by_brute_force(rows)
    assert len(expected) > 5 and found == {d: expected.get(d, []) for d, _ in rows}


@settings(max_examples=300, deadline=None)
@given(line=st.text(alphabet="ab", min_size=24, max_size=70), k=st.integers(0, 69), kind=st.integers(0, 2))
def test_levels_share_a_key_within_one_edit(line, k, kind):
    k %= len(line)
    other = [line[:k] + line[k + 1 :], line[:k] + "x" + line[k:], line[:k] + "x" + line[k + 1 :]][kind]
    if len(other) < 24:
        return
    one, two = ({key: (lo, hi) for key, lo, hi in line_dedup.first_level(x)} for x in (line, other))
    same = one.keys() & two.keys()
    assert same
    fine = [{key: (lo, hi) for key, lo, hi in line_dedup.second_level(x, [level[s] for s in same])} for x, level in ((line, one), (other, two))]
    both = fine[0].keys() & fine[1].keys()
    assert both
    last = [{key for key, _ in line_dedup.third_level(x, [f[s] for s in both])} for x, f in zip((line, other), fine, strict=True)]
    assert last[0] & last[1]


def test_line_dedup_rewrites_texts_and_drops_what_is_empty(spark, documents):
    line = "this line is surely long enough"
    rows = [(1, f"{line}\nown text one"), (2, f"first\n{line}!\nlast"), (3, f"\n{line}\n"), (4, None), (5, ""), (None, line), (1, f"{line}\nown text one")]
    found = line_dedup.dedup_lines(documents(rows))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in found.where("text is not null").collect()) == [(0, line), (1, rows[0][1]), (1, rows[0][1]), (2, "first\nlast"), (5, "")]
    assert found.where("text is null").count() == 1 and line_dedup.dedup_lines(documents([])).count() == 0


def test_short_lines_go_as_copies_and_by_one_edit_from_its_bound(spark, documents):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcd", k=k)) for k in (8, 8, 9, 9, 10, 11, 12, 13, 15, 16, 17, 18, 20, 23, 24, 25)]
    rows = [(d, "\n".join(edited(rng, rng.choice(base)) if rng.random() < 0.7 else rng.choice(["}", "yes", "yet", "All."]) for _ in range(5))) for d in range(60)]
    lines = [(d, i, x) for d, t in rows for i, x in enumerate(line_dedup.lines_of(t)) if x]
    expected = {d: [] for d, _ in rows}
    for k, (d, i, x) in enumerate(lines):
        if any(x == y or min(len(x), len(y)) >= line_dedup.MIN_EDIT and one_edit(x, y) for _, _, y in lines[:k]):
            expected[d].append(i)
    assert {r["doc_id"]: [x["i"] for x in r["removed"]] for r in line_dedup.line_report(documents(rows)).collect()} == expected


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \n\té\u00a0", max_size=40))
def test_fingerprint_equals_the_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def close_groups(rng, n):
    out = []
    for _ in range(n):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 6])):
            out.append(f)
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                f ^= 1 << b
    return out


def brute_components(fps):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    every = sorted(label)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {f: root(f) for f in every}


@pytest.mark.parametrize("shard", [40, 0.05])  # the second makes the tree deeper than 12
def test_tree_links_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    fps = close_groups(random.Random(8), 400)
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    class_of = brute_components(set(fps))
    sizes = Counter(class_of.values())
    near = {f for f, c in class_of.items() if sizes[c] > 1}
    going = {r["fp"] % (1 << 64) for r in simhash.crowded(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert near <= going and len(going) < len(class_of) - 100  # most that are alone go no further
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    whole = simhash.connected_components(found, "fp", "root").collect()
    got = {}
    for r in whole:
        got.setdefault(r["component"], set()).add(r["node"] % (1 << 64))
    expected = {}
    for f, c in class_of.items():
        expected.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


def test_near_duplicates_of_odd_rows(spark, documents):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text), (3, text.upper()), (9, None), (7, ""), (8, " \n"), (4, "one two"), (4, "one two"), (None, text), (6, text + " more")]
    found = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(rows)).collect())
    assert [(d, c) for d, _, c in found if d != 6] == [(0, 3), (3, 3), (4, 4), (4, 4), (5, 3), (7, 7), (8, 7), (9, 7)]
    assert dict((d, f) for d, f, _ in found)[9] == "0" * 16 and dict((d, f) for d, f, _ in found)[5] == f"{plain_fingerprint(text):016x}"
    assert simhash.near_duplicates(documents([])).count() == 0


def test_near_duplicates_equal_brute_force_jaccard(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(3)
    prose = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n)]
    hot = prose(30)
    rows = []
    for _ in range(25):
        base = prose(rng.choice([3, 5, 6, 12, 60, 200])) + rng.choice([[], hot])
        for _ in range(rng.choice([1, 2, 9])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(50))
            rows.append((len(rows), " ".join(words)))
    sets = {}
    for d, t in rows:
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    label = {d: d for d, _ in rows}
    for a in label:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if c == high else c for d, c in label.items()}
    rows += [(None, rows[0][1]), (500, rows[0][1].upper()), (501, None), (502, "")]
    label |= {500: label[0], 501: 501, 502: 501, None: label[0]}
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(rows), shingle=5, least=0.8).collect()}
    assert found == label and len(set(label.values())) < len(rows) - 20


def test_the_pipeline_drops_near_copies_beyond_two_bits(spark, documents):
    words = [f"w{k * 7919 % 1009}" for k in range(200)]
    near = [*words[:60], "x", *words[61:140], "y", *words[141:]]
    a, b = " ".join(words), " ".join(near)
    assert (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 2
    kept = corpus_pipeline.dedup_near(spark, documents([(1, a), (2, b), (3, " ".join(words[100:] + words[:40]))]), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]


def test_the_pipeline_drops_what_fingerprints_link(spark, documents):
    """A stretch that repeats decides the fingerprint, while most of the two sets differs."""
    stretch = " ".join(f"s{k}" for k in range(7)) + " "
    a, b = (stretch * 60 + " ".join(f"{c}{k}" for k in range(12)) for c in "ab")
    assert (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() <= 2
    sets = [set(simhash.shingles(t, 5).tolist()) for t in (a, b)]
    assert len(sets[0] & sets[1]) < 0.5 * len(sets[0] | sets[1])
    other = " ".join(f"o{k}" for k in range(40))
    kept = corpus_pipeline.dedup_near(spark, documents([(4, b), (1, a), (2, other), (3, other.upper())]), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]


def plain_alignment(item, text):
    best, h = 0, [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best / (2 * len(item))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(-1, 4), min_size=1, max_size=20))
def test_alignment_equals_the_table(item, text):
    import numpy as np

    score, a, b = decontaminate.align(np.array(item), np.array([x if x >= 0 else -1 for x in text]))
    assert score == pytest.approx(plain_alignment(item, text))
    if score:
        assert plain_alignment(item, text[a:b]) == pytest.approx(score)


@given(st.lists(st.integers(0, 4), min_size=1, max_size=8), st.lists(st.integers(-1, 5), max_size=60), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_alignment_by_windows_equals_alignment_of_the_whole(item, text, window):
    import numpy as np

    score, a, b = decontaminate.align_windows(np.array(item), np.array(text, np.int64), window)
    assert score == decontaminate.align(np.array(item), np.array(text, np.int64))[0]
    assert not score or decontaminate.align(np.array(item), np.array(text[a:b], np.int64))[0] == score


def test_leaks_find_exact_and_edited_copies_only(spark, documents):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: prose(30) for k in range(12)} | {50: prose(3)}
    items[13] = items[0]
    broken = list(items[2])
    for k in range(0, 30, 7):
        broken[k] = "other"
    rows = [(i, " ".join(prose(120))) for i in range(40)]
    rows += [(100, " ".join([*prose(50), *items[0], *prose(50)])), (101, ", ".join(items[1]).upper()), (102, " ".join([*prose(20), *broken, *prose(20)])), (103, " ".join(items[3][:8] + prose(60))), (104, None), (105, ""), (101, ", ".join(items[1]).upper())]
    bench = spark.createDataFrame([(k, " ".join(v), "x") for k, v in items.items()] + [(60, None, "x"), (61, "", "x")], "item_id long, text string, doc_id string")
    for most in (10_000, 70):
        found = decontaminate.leaks(documents(rows), bench, block_words=most).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(100, 0), (100, 13), (101, 1), (101, 1), (102, 2)]
    assert all(r["score"] == 1 for r in found if r["doc_id"] != 102)
    assert [r["start_word"] for r in found if r["doc_id"] == 100] == [50, 50]
    left = decontaminate.without_leaks(documents(rows), bench, block_words=70)
    assert sorted(r["doc_id"] for r in left.collect()) == [*range(40), 103, 104, 105]
    assert decontaminate.leaks(documents(rows), bench.limit(0)).count() == 0 and decontaminate.leaks(documents([]), bench).count() == 0


def test_leaked_pairs_equal_alignment_of_everything(spark, documents):
    """No pair is lost by the seeds: random edits, and one at every second to fifth word, against Smith-Waterman of every item over every whole text."""
    import numpy as np

    rng = random.Random(14)
    vocabulary = ["".join(rng.choices("etaoinshr", k=rng.randint(3, 8))) for _ in range(600)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: prose(rng.randint(12, 40)) for k in range(15)}
    rows = [(d, " ".join(prose(rng.randint(0, 80)))) for d in range(20)]
    for d in range(20, 90):
        copy = list(items[rng.randrange(15)])
        for _ in range(rng.randrange(len(copy) // 3)):
            k = rng.randrange(len(copy))
            copy[k : k + rng.randint(0, 1)] = rng.choice([[], prose(1), prose(2)])
        rows.append((d, " ".join(prose(rng.randint(0, 60)) + copy + prose(rng.randint(0, 60)))))
    edits = {"replaced": lambda w: prose(1), "left out": lambda w: [], "put in": lambda w: [w, *prose(1)]}
    planted = {}
    for kind, edit in edits.items():
        for step in (1, 2, 3, 4, 5) if kind == "put in" else (2, 3, 4, 5):
            for k, item in items.items():
                copy = [x for j, w in enumerate(item, 1) for x in (edit(w) if j % step == 0 else [w])]
                planted[len(rows)] = k
                rows.append((len(rows), " ".join(prose(20) + copy + prose(20))))
    number = {w: k for k, w in enumerate(vocabulary)}
    every = {(d, i) for d, t in rows for i, item in items.items() if decontaminate.align(np.array([number[w] for w in item]), np.array([number[w] for w in t.split()], np.int64))[0] >= decontaminate.MIN_SCORE}
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(None, " ".join(items[0]))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(rows), bench).collect()}
    assert found == every and len(every) > 50
    assert len({(d, i) for d, i in planted.items()} & found) > 0.7 * len(planted)  # the rest scores less


def test_hot_leaks_short_items_and_long_texts(spark, documents):
    """Copies beyond counting, items of few words, a text of many windows and a word said over and over."""
    item, short = [f"w{k}" for k in range(24)], ["one", "two", "three", "four", "five"]
    every_third = " ".join("x" if k % 3 == 2 else w for k, w in enumerate(item))
    rows = [(i, f"start{i} {every_third} end") for i in range(80)]
    rows += [(100, "one two three"), (101, "so one two three four it is"), (102, "w1 w2 " * 40_000), (103, "far " * 70_000 + every_third + " far" * 70_000), (104, "w3 " * 200_000), (105, " ".join(item[:12])), (106, " ".join(item[:11]))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, "one two three")], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(rows), bench).collect())
    assert found == [*((i, 1) for i in range(80)), (101, 2), (103, 1), (105, 1)]


def test_a_hot_leak_keeps_its_seeds(spark, documents):
    item = " ".join(f"unusual{k}" for k in range(20))
    rows = [(i, f"{item} filler{i}" if i % 2 else f"clean text number{i} here") for i in range(60)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.leaks(documents(rows), bench).collect()) == list(range(1, 60, 2))


def test_an_edited_copy_is_found_beside_common_phrases(spark, documents):
    """Many edited copies do not hide behind the rest of the item, and a common phrase alone is no leak."""
    words = [f"w{k}" for k in range(30)]
    spread = " ".join(words[:12] + ["x"] * 4 + words[16:30])
    rows = [(i, f"start{i} {spread} end") for i in range(50)] + [(60, " ".join(words))] + [(70 + i, f"{' '.join(words[:4])} other{i} text") for i in range(300)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.leaks(documents(rows), bench).collect()) == [*range(50), 60]


def spans_by_brute_force(rows):
    """The smallest (id, hash of text, sentence) of each run stays; runs grow until they have their words."""
    first, places = {}, []
    for d, row, t in sorted(rows):
        s = span_dedup.sentences(t)
        for k in range(len(s) - span_dedup.RUN + 1):
            size = next((z for z in range(span_dedup.RUN, len(s) - k + 1) if sum(x[3] for x in s[k : k + z]) >= span_dedup.MIN_WORDS), 0)
            if size:
                key = b" ".join(x[2] for x in s[k : k + size])
                first.setdefault(key, (d, row, k))
                places.append((key, d, row, k, size))
    out = {}
    for key, d, row, k, size in places:
        if first[key] != (d, row, k):
            out.setdefault((d, row), set()).update(range(k, k + size))
    return {d: sorted(v) for d, v in out.items()}


def hashed(spark, rows):
    """The rows with a hash of their texts between."""
    return [tuple(r) for r in spark.createDataFrame(rows, "d long, t string").selectExpr("d", "xxhash64(t)", "t").collect()]


def test_spans_equal_brute_force(spark, documents):
    rng = random.Random(6)
    sentence = lambda: " ".join("".join(rng.choices("etaoin", k=4)) for _ in range(rng.randint(3, 24))) + rng.choice([".", "!", "?"])
    passages = [[sentence() for _ in range(5)] for _ in range(4)]
    rows = [(d % 25, " ".join([sentence(), *rng.choice(passages), sentence(), *(rng.choice(passages)[:4]), sentence()])) for d in range(30)]
    rows += [(50, None), (51, ""), (52, "One. Two. Three."), (53, "word " * 4000)]
    found = {(r["doc_id"], r["row"]): list(r["removed"]) for r in span_dedup.covered(documents([*rows, (None, rows[0][1]), rows[3]])).collect()}
    assert found == spans_by_brute_force(hashed(spark, rows)) and len(found) > 20
    left = {(r["doc_id"], r["n_chars"]): r["text"] for r in span_dedup.dedup_spans(documents(rows)).collect()}
    for d, row, t in hashed(spark, rows):
        gone = set(found.get((d, row), ()))
        assert b" ".join(x[2] for x in span_dedup.sentences(left[d, len(t or "")])) == b" ".join(x[2] for k, x in enumerate(span_dedup.sentences(t)) if k not in gone)
    assert span_dedup.covered(documents([])).count() == 0 and span_dedup.dedup_spans(documents([])).count() == 0


def test_a_passage_of_very_short_sentences_is_covered(spark, documents):
    passage = " ".join(f"w{k} v{k}." for k in range(30))
    rows = [(1, f"Begin here. {passage} End one."), (2, f"Another start. {passage} Other end.")]
    found = span_dedup.covered(documents(rows)).collect()
    assert [(r["doc_id"], list(r["removed"]), list(r["first_ids"])) for r in found] == [(2, list(range(1, 31)), [1])]


CLASHES = "_gone string, _gone_id long, doc_id_ long, h long, key long, fp long, removed string, _owner string, _row long, _numbers int, _mine int, _stays int, row long, sig long, `a.b` string, `text.of` long, `doc_id.` string"


def clashing(spark, rows):
    """Documents with columns named like ones that operators make."""
    names = [x.split()[0] for x in CLASHES.split(", ")]
    kinds = [x.split()[1] for x in CLASHES.split(", ")]
    return spark.createDataFrame([(i, t, *("x" if k == "string" else 7 for k in kinds)) for i, t in rows], "doc_id long, text string, " + ", ".join(map(" ".join, zip(names, kinds, strict=True))))


def test_rows_that_share_an_id_keep_their_own_text(spark):
    shared = "a line that several rows of this table have"
    own = [f"some words that only row number {'abcdefgh'[k] * 3} has in it" for k in range(4)]
    rows = [(1, f"{shared}\n{own[0]}"), (2, f"{own[1]} begins\n{shared}"), (2, f"{shared}\n{own[2]} here"), (-3, f"{own[3]} stands\nalone"), (None, shared), (None, shared)]
    docs = clashing(spark, rows)
    found = line_dedup.dedup_lines(docs)
    assert found.columns == docs.columns
    assert sorted(r["text"] for r in found.collect()) == sorted([rows[0][1], rows[3][1], shared, shared, f"{own[1]} begins", f"{own[2]} here"])
    passage = " ".join(f"word{k} goes with number{k} here." for k in range(8))
    texts = [" ".join(f"{x}{k} is {x}only text{k} of row{x}." for k in range(7)) for x in "pqrs"]
    rows = [(1, f"{texts[0]} {passage}"), (2, f"{passage} {texts[1]}"), (2, f"{texts[2]} {passage} {texts[3]}"), (2, f"{texts[2]} {passage} {texts[3]}"), (-1, None)]
    kept = span_dedup.dedup_spans(clashing(spark, rows))
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(["", rows[0][1], texts[1], f"{texts[2]} {texts[3]}", f"{texts[2]} {texts[3]}"])


@pytest.mark.parametrize("least", [None, 0.8])
def test_one_row_of_each_component_stays(spark, least):
    rng = random.Random(9)
    prose = lambda: " ".join("".join(rng.choices("etaoinshr", k=5)) for _ in range(40))
    a, b, c, d = (prose() for _ in range(4))
    rows = [(5, a), (5, a), (5, b), (3, b), (-7, c), (-7, a), (None, d), (None, d), (None, c), (9, None), (8, "")]
    docs = clashing(spark, rows)
    found = simhash.without_near_duplicates(docs, least=least)
    assert found.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in found.collect()) == sorted([(-7, a), (3, b), (-7, c), (0, d), (8, "")])
    assert simhash.without_near_duplicates(docs.limit(0), least=least).count() == 0


def test_bands_find_what_is_similar():
    import numpy as np

    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(400):
        items = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        other = np.concatenate([items[:90], rng.integers(0, 1 << 63, 12).astype(np.uint64)])  # similarity 0.804
        missed += not np.intersect1d(simhash.bands(items), simhash.bands(other)).size
        odd = np.bitwise_count(np.frombuffer(simhash.parities(items), np.uint8) ^ np.frombuffer(simhash.parities(other), np.uint8)).sum()
        assert odd <= 22
    assert missed <= 2


@pytest.mark.parametrize("seed", range(3))
def test_a_passage_is_found_at_every_offset_of_unpunctuated_text(spark, documents, seed):
    rng = random.Random(seed)
    prose = lambda n: ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(n)]
    passage = prose(51)
    rows = [(d, " ".join([*prose(d), *passage, *prose(40)])) for d in range(40)]
    found = {r["doc_id"]: r["removed"] for r in span_dedup.covered(documents(rows)).collect()}
    assert sorted(found) == list(range(1, 40))
    for d, text in rows[1:]:
        words = [set(x[2].split()) for k, x in enumerate(span_dedup.sentences(text)) if k in found[d]]
        assert set().union(*words) <= {w.encode() for w in passage} and sum(map(len, words)) >= span_dedup.MIN_WORDS


def test_queries_are_named_by_number():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_pipeline_stages_keep_columns_and_clean_documents(spark, documents, tmp_path):
    rng = random.Random(12)
    kinds = {"xx": "abcdefg", "yy": "pqrstuv"}
    text = lambda k: "\n".join(" ".join("".join(rng.choices(kinds[k], k=rng.randint(2, 7))) for _ in range(12)) + "." for _ in range(6))
    clean = [(i, text(k), k) for i, k in enumerate(["xx", "yy"] * 25)]
    item = " ".join("".join(rng.choices(kinds["xx"], k=6)) for _ in range(30))
    rows = [*clean, (100, clean[0][1], "xx"), (101, None, "xx"), (102, "1234 !!", "yy"), (103, f"{text('xx')}\n{item}", "xx")]
    frame = spark.createDataFrame([(i, t, k, "src", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(50)) and all(r["round_trip"] for r in found)


def test_odd_names_pass_through_every_operator_that_keeps_rows(spark):
    """Names with dots come back as they were, from each operator and through the stages of the pipeline."""
    rows = [(k, f"This is quite an ordinary English sentence number {k} about the weather and the old harbour of the town.") for k in range(12)]
    docs = clashing(spark, rows).withColumn("lang", F.lit("en"))
    model = language_id.fit(docs)
    found = [
        language_id.identify(docs, model, keep=True, min_score=0.0),
        line_dedup.dedup_lines(docs),
        span_dedup.dedup_spans(docs),
        simhash.without_near_duplicates(docs, shingle=5, least=0.8),
        decontaminate.without_leaks(docs, spark.createDataFrame([(1, "no text of the corpus has any of these words in it at all")], "item_id long, text string")),
    ]
    for out in found:
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        kept = out.collect()
        assert kept and all(r["a.b"] == "x" and r["text.of"] == 7 and r["doc_id."] == "x" for r in kept)
    assert language_id.identify(docs, model).columns == ["doc_id", "lang_pred", "score", "rejected"]


def test_a_dense_ball_of_fingerprints_is_linked(spark):
    """Every fingerprint within two bits of one centre, and some far ones: all blocks are shared, and the ball is one component."""
    centre = 0x0123456789ABCDEF
    ball = {centre ^ (1 << a) ^ (1 << b if b != a else 0) for a in range(64) for b in range(a, 64)} | {centre}
    far = [random.Random(k).getrandbits(64) for k in range(50)]
    signed = [f - (1 << 64) if f >> 63 else f for f in [*ball, *far]]
    found = simhash.connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")), "fp", "root").collect()
    assert {r["node"] % (1 << 64) for r in found} == ball and len({r["component"] for r in found}) == 1
