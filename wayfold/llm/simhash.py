"""SimHash near-duplicates, linked through a vantage-point tree over Hamming distance.

Fingerprint: A-Z is lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]``, and every run of 3 words (all of them if there
are fewer) is hashed by XXH64 with seed 42; a bit is set if more than half of the hashes have it.  A text without words,
or null, has fingerprint 0, which links like any other.  Fingerprints link at ``RADIUS`` differing bits or fewer, and a
component's id is the smallest document id in it.

Links between distinct fingerprints: two that differ by ``RADIUS`` bits agree in all but so many of ``RADIUS`` + 3 blocks of bits, so
a fingerprint that has no three blocks in common with another one has no link, and only the others go on.  A tree of vantage points is built on the driver from a sample of bounded size.
Every node has a fingerprint and a median distance; a fingerprint goes home to the inner or outer side.  A pair on
both sides of a node must have the outer one within ``median + RADIUS`` of the vantage point (triangle inequality), so only
those are also sent to the inner shard, as queries; further down, a query follows every side that the bound leaves open.
Each shard compares its home fingerprints with all that it got, in blocks, and again only where their distances from a
vantage point of its own differ by ``RADIUS`` at most.  So every link is seen, exactly.  A shard gives not its pairs but one row
for each linked fingerprint, with the smallest that the shard connects it to, and components of these rows make the result: links of a dense group
are compared in blocks but never become rows.

With ``least``, pairs are near duplicates if the exact Jaccard similarity of their sets of shingles is that or more, and the
tree is not used: at similarity 0.8 fingerprints differ by some 10 bits and by up to 20, where unrelated ones
differ by 32, so no bound of the tree closes a side.  Candidates come from ``BANDS`` hashed bands of ``ROWS`` minimum hashes each instead:
two sets of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8 and more above.
All sets of a band are first compared with its smallest; what that links is one class.  Then, in bands that still have
several classes, sets of different classes are compared, in blocks of ``BLOCK`` sets of a band, by the parity of their shingles in ``PARITY`` buckets: two sets
have at least as many shingles apart as parities, so a pair that this rules out is never a link, and what it leaves is
verified on whole sets.  No group of sets is gathered anywhere, and rows grow with sets, not with pairs.
With ``both``, fingerprints that the tree links are links beside these.

Exact copies are one fingerprint (with ``least``, one set) from the start.  Repeated ids give repeated rows; null ids take part and are
never the smallest unless alone.  ``without_near_duplicates`` tells rows apart by id and text: of each component the row with the
smallest id (then the least hash of its text) stays, null ids last, and of rows equal in both one stays.  Other columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut, per_row, plain_names, release, rows_and_text, ship, unused
from wayfold.operators.bitmap import KeyFilter
from wayfold.operators.components import connected_components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Home fingerprints a shard should have; the tree's largest sample, and its largest depth (some 10 MB, for four thousand million fingerprints).
SHARD = 4096
SAMPLE = 1 << 18
DEPTH = 20
#: Minimum hashes of a band, and bands.
ROWS = 5
BANDS = 20
#: Buckets of shingles whose parities bound how far two sets are apart.
PARITY = 1024
#: Sets of a band that are compared at once.
BLOCK = 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each run of words, in order."""
    words = (text or "").encode().lower().split()
    runs = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) > shingle else [words] if words else []
    return np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in runs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    if not len(hashes):
        return 0
    each = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(each[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text."""
    return majority(shingles(text, shingle))


def fingerprints(named: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row, fp (the 64 bits as a signed long) of each row of doc_id, text, row."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "row", "fp"])

    return per_row(named, block, "doc_id long, row long, fp long")


class Tree:
    """Vantage points and medians in heap order; leaves are shards."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.point = np.zeros(1 << depth, np.uint64)
        self.median = np.full(1 << depth, 32, np.int16)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            part = parts.pop(node)
            if len(part) > 1:
                best = None
                for v in rng.choice(part, 8, replace=False) if len(part) > 64 else part[:1]:
                    d = np.bitwise_count(part ^ v)
                    m = int(np.median(d))
                    cost = np.mean((d > m) & (d <= m + RADIUS)) + abs(np.mean(d <= m) - 0.5)
                    if best is None or cost < best[0]:
                        best = (cost, v, m)
                self.point[node], self.median[node] = best[1:]
            elif len(part):
                self.point[node] = part[0] ^ np.uint64(0xFFFFFFFF)  # half its bits away
            inner = np.bitwise_count(part ^ self.point[node]) <= self.median[node]
            parts[2 * node], parts[2 * node + 1] = part[inner], part[~inner]

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, shard and whether the shard is its home, for every place that a fingerprint goes to."""
        row, node, home = np.arange(len(fps)), np.ones(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(fps[row] ^ self.point[node]).astype(np.int16)
            m = self.median[node]
            inner, outer = d <= m, d > m
            as_query_in = np.where(home, outer & (d <= m + RADIUS), d <= m + RADIUS)
            to_in = np.where(home, inner, False) | as_query_in
            to_out = np.where(home, outer, d > m - RADIUS)
            row, node, home = (
                np.concatenate([row[to_in], row[to_out]]),
                np.concatenate([2 * node[to_in], 2 * node[to_out] + 1]),
                np.concatenate([(home & inner)[to_in], (home & outer)[to_out]]),
            )
        return row, node, home


def linked(home: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints with a link in this shard and, for each, the smallest one that the shard's links connect it to."""
    every = np.concatenate([home, query])
    n = len(every)
    if n < 2:
        return every[:0], every[:0]
    far = np.bitwise_count(every ^ every[0]).astype(np.int16)
    order = np.argsort(far, kind="stable")
    every, far, is_home = every[order], far[order], (np.arange(n) < len(home))[order]
    rank = np.argsort(np.argsort(every))
    label = rank.copy()
    rows = np.flatnonzero(is_home)
    start, size = 0, 16
    while start < len(rows):
        block = rows[start : start + size]
        lo, hi = np.searchsorted(far, far[block[0]] - RADIUS), np.searchsorted(far, far[block[-1]] + RADIUS, "right")
        near = np.bitwise_count(every[block, None] ^ every[None, lo:hi]) <= RADIUS
        near &= label[block, None] != label[None, lo:hi]
        i, j = np.nonzero(near)
        if len(i):
            _merge(label, block[i], lo + j)
        start, size = start + size, min(256, size * 2)
    size_of = np.bincount(label, minlength=n)
    some = size_of[label] > 1
    by_rank = np.empty_like(every)
    by_rank[rank] = every
    return every[some], by_rank[label[some]]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the smallest label of each class that the pairs join to all that have a label of it."""
    names, at = np.unique(np.concatenate([label[a], label[b]]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    to = np.arange(len(label))
    to[names] = names[root]
    label[:] = to[label]


def crowded(distinct: DataFrame) -> DataFrame:
    """The distinct fingerprints that have three blocks of bits in common with another; no other one has a link.

    Three blocks are 38 bits or more: of n random fingerprints a share of some n / 2**35 goes on.  Keys are hashed, which lets more go on and never fewer.
    """
    bits = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.arange(64), RADIUS + 3)]
    masks = [reduce(int.__or__, three) for three in combinations(bits, 3)]
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(int(np.uint64(m).view(np.int64))))) for k, m in enumerate(masks)]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select("key")
    return keyed.join(shared, "key", "left_semi").select("fp").distinct()


def links(distinct: DataFrame) -> DataFrame:
    """fp, root: for each fingerprint that a shard links, the smallest that this shard connects it to."""
    spark = distinct.sparkSession
    distinct = cut(crowded(distinct))
    n = distinct.count()
    depth = 0
    while depth < DEPTH and n > SHARD * 2**depth:
        depth += 1
    share = min(1.0, min(SAMPLE, 128 << depth) / max(1, n))
    sample = distinct.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toPandas()["fp"].to_numpy(np.int64) if depth else np.zeros(0, np.int64)
    ship(spark)
    tree = spark.sparkContext.broadcast(Tree(np.sort(sample.view(np.uint64)), depth))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, node, home = tree.value.route(fps)
            for k in range(0, len(row), 50_000):
                part = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(node[part].astype(np.int32)), pa.array(fps[row[part]].view(np.int64)), pa.array(home[part])], ["shard", "fp", "home"])

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fps, home = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["home"].to_numpy(bool)
        one, root = linked(fps[home], fps[~home])
        return pd.DataFrame({"fp": one.view(np.int64), "root": root.view(np.int64)})

    return distinct.select("fp").mapInArrow(route, "shard int, fp long, home boolean").groupBy("shard").applyInPandas(compare, "fp long, root long")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """sig (a hash of the set), items (the set) of each row of text."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(shingles(t.as_py(), shingle)) for t in batch.column(0)]
        sigs = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), lists], ["sig", "items"])

    return per_row(docs.select("text"), block, "sig long, items array<long>")


_MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 63, ROWS * BANDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def bands(items: np.ndarray) -> np.ndarray:
    """The keys of a set's bands."""
    least = np.full(len(_MULTIPLIERS), np.uint64(2**64 - 1))
    for k in range(0, len(items), 4096):
        mixed = items[None, k : k + 4096] * _MULTIPLIERS[:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
    return key


def parities(items: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls into each bucket."""
    odd = np.bincount((items >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def packed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row, sig, n, fp, parity, keys of each row of doc_id, text, row; an empty set has no keys."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs, sizes, fps, odd, keys = [], [], [], [], []
        for text in batch.column(1):
            every = shingles(text.as_py(), shingle)
            items = np.unique(every)
            sigs.append(xxhash.xxh64_intdigest(items.tobytes(), SEED))
            sizes.append(len(items))
            fps.append(majority(every))
            odd.append(parities(items))
            keys.append(bands(items).view(np.int64) if len(items) else [])
        columns = [pa.array(np.array(sigs, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(odd, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "row", "sig", "n", "fp", "parity", "keys"])

    return per_row(docs, block, "doc_id long, row long, sig long, n int, fp long, parity binary, keys array<long>")


def across(members: DataFrame, least: float) -> DataFrame:
    """a, b: pairs of sets of one band (list, sig, class, n, parity) and of different classes that may be similar enough.

    A band of more than ``BLOCK`` sets is dealt into blocks, and each pair of blocks is compared in a task of its own.
    """
    sized = members.groupBy("list").agg(F.count("*").alias("size")).select("list", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sized, "list").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("sig", F.lit(5)), F.col("blocks"))).otherwise(0).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("x"), F.greatest("block", k).alias("y")))
    dealt = dealt.select("list", "sig", "class", "n", "parity", "block", F.explode(others).alias("pair"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None  # rows of a pair of blocks whose end was not seen yet
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]) if kept is not None else rows
            names = np.stack([rows.column(c).to_numpy() for c in ("list", "x", "y")], 1)
            edges = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            done = int(edges[-1]) if len(edges) else 0
            yield pairs(rows.slice(0, done), [0, *edges.tolist()])
            kept = rows.slice(done)
        if kept is not None:
            yield pairs(kept, [0, len(kept)])
        release()

    def pairs(rows: pa.Table, edges: list[int]) -> pa.RecordBatch:
        x, y, block, sig, of, n = (rows.column(c).to_numpy() for c in ("x", "y", "block", "sig", "class", "n"))
        odd = np.frombuffer(b"".join(rows.column("parity").to_pylist()), np.uint64).reshape(len(rows), PARITY // 64)
        out = [np.zeros((0, 2), np.int64)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            left, right = lo + np.flatnonzero(block[lo:hi] == x[lo]), lo + np.flatnonzero(block[lo:hi] == y[lo])
            for k in range(0, len(left), 64):
                i = left[k : k + 64]
                # both >= t (n - both) and apart = n - 2 both give apart <= n (1 - t) / (1 + t)
                most = (n[i, None] + n[right]) * ((1 - least) / (1 + least)) + 1e-6
                fits = (of[i, None] != of[right]) & (np.abs(n[i, None] - n[right]) <= most)
                if x[lo] == y[lo]:
                    fits &= sig[i, None] < sig[right]
                p, q = np.nonzero(fits)
                near = np.bitwise_count(odd[i[p]] ^ odd[right[q]]).sum(1) <= most[p, q]
                out.append(np.stack([sig[i[p[near]]], sig[right[q[near]]]], 1))
        found = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(found.min(1)), pa.array(found.max(1))], ["a", "b"])

    ship(members.sparkSession)
    dealt = dealt.select("list", "pair.x", "pair.y", "sig", "class", "n", "parity", "block").repartition("list", "x", "y").sortWithinPartitions("list", "x", "y")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs whose sets have the similarity."""
    pairs = cut(pairs)
    need = cut(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
    of = cut(rows.select("sig", "row").join(need, "sig").groupBy("sig").agg(F.min("row").alias("row")).select("row"))
    some = texts.where(KeyFilter(of, "row").may_have(F.col("row"))).join(of, "row").dropDuplicates(["row"])
    sets = cut(_sets(some, shingle).dropDuplicates(["sig"]))
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("items").alias("of_a")), "a").join(sets.select(F.col("sig").alias("b"), F.col("items").alias("of_b")), "b")
    shared = both.select("a", "b", (F.size("of_a") + F.size("of_b")).alias("n"), F.size(F.array_intersect("of_a", "of_b")).alias("both"))
    return cut(shared.where(F.col("both") >= least * (F.col("n") - F.col("both")) - 1e-9).select("a", "b"))


def similar(docs: DataFrame, shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, row, sig, fp of every row of doc_id, text, row, and the pairs a, b of sets whose similarity links them."""
    rows = cut(packed(docs, shingle))
    sets = rows.where("n > 0").select("sig", "n", "parity", "keys").dropDuplicates(["sig"])
    flat = cut(sets.select("sig", F.explode("keys").alias("list")))
    shared = cut(flat.groupBy("list").agg(F.min("sig").alias("first"), F.max("sig").alias("last")).where("first != last").select("list", "first"))
    here = cut(flat.where(KeyFilter(shared, "list").may_have(F.col("list"))).join(shared, "list"))
    first = verified(here.where("sig != first").select(F.col("first").alias("a"), F.col("sig").alias("b")).distinct(), rows, docs, shingle, least)
    found = connected_components(first, "a", "b").select(F.col("node").alias("sig"), F.col("component").alias("class"))
    named = here.join(found, "sig", "left").select("list", "sig", F.coalesce("class", "sig").alias("class"))
    mixed = named.groupBy("list").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("list")
    members = cut(named.join(mixed, "list"))
    facts = rows.where(KeyFilter(members, "sig").may_have(F.col("sig"))).select("sig", "n", "parity").dropDuplicates(["sig"])
    return rows, first.union(verified(across(members.join(facts, "sig"), least), rows, docs, shingle, least))


def by_fingerprint(rows: DataFrame) -> DataFrame:
    """a, b: links of sets through their fingerprints, each set to the smallest of its fingerprint and that one to the fingerprint's root."""
    known = rows.select("fp", "sig").distinct()
    first = cut(known.groupBy("fp").agg(F.min("sig").alias("first"), F.max("sig").alias("last")))
    shared = first.where("first != last").select("fp", "first")
    near = cut(links(first.select("fp")).where("fp != root").distinct())
    one = near.join(first.select("fp", F.col("first").alias("a")), "fp").join(first.select(F.col("fp").alias("root"), F.col("first").alias("b")), "root")
    return known.join(shared, "fp").where("sig != first").select(F.col("first").alias("a"), F.col("sig").alias("b")).union(one.select("a", "b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float | None = None, both: bool = False) -> DataFrame:
    """doc_id, row (a hash of the text), fp, and root (a name of the component), of every row."""
    named = rows_and_text(docs, id_col, text_col)
    if least is None:
        rows = cut(fingerprints(named, shingle)).withColumn("key", F.col("fp"))
        edges = links(rows.select("fp").distinct()).toDF("a", "b")
    else:
        rows, edges = similar(named, shingle, least)
        if both:
            edges = edges.union(by_fingerprint(rows))
        rows = rows.select("doc_id", "row", "fp", F.col("sig").alias("key"))
    found = connected_components(edges, "a", "b").withColumnRenamed("node", "key")
    return rows.join(found, "key", "left").select("doc_id", "row", "fp", F.coalesce("component", "key").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row; with ``least`` links are verified by Jaccard similarity."""
    rows = cut(classes(docs, id_col, text_col, shingle, least))
    component = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(component, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@plain_names
def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float | None = None, both: bool = False) -> DataFrame:
    """The rows of docs, one of each component."""
    rows = cut(classes(docs, id_col, text_col, shingle, least, both))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    # A root with one row alone needs no decision.
    kept = rows.groupBy("root").agg(F.min(place).alias("keep"), F.count("*").alias("size")).where("size > 1")
    of = rows.join(kept, "root").select("doc_id", "row", (place == F.col("keep")).alias("stays"))
    owner, row, stays, mine = unused(docs, "_owner", "_row", "_stays", "_mine")
    decided = cut(of.distinct().select(F.col("doc_id").alias(owner), F.col("row").alias(row), F.col("stays").alias(stays)))
    keyed = docs.withColumn(mine, F.xxhash64(F.col(text_col).cast("string")))
    touched = KeyFilter(decided, row).may_have(F.col(mine))  # only these are shuffled
    some = keyed.where(touched).join(decided, F.col(id_col).cast("long").eqNullSafe(F.col(owner)) & (F.col(mine) == F.col(row)), "left")
    names = docs.columns
    one = some.where(F.col(stays)).dropDuplicates([id_col, mine]).select(*names)
    return one.unionByName(some.where(F.col(stays).isNull()).select(*names)).unionByName(keyed.where(~touched).select(*names))
