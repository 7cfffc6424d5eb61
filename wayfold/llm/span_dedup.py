"""Substring dedup over sentence spans: sentences covered by a repeated run of sentences go, but for its first place.

A sentence ends behind ``.``, ``!`` or ``?`` with the marks that close it, before a blank, and at a line end.  One with twice
``LEAST`` words or more is cut where its words say so (``starts``), so a passage makes the same pieces wherever in a sentence it
starts.  A piece counts as a sentence.  Words are lower-cased (A-Z).  Every run of ``RUN`` consecutive sentences is hashed; one with
fewer than ``MIN_WORDS`` words goes on, sentence by sentence, until it has them, so the words "and so on. It is. Yes." alone are no
repeat.  Of all places of a hash in the corpus the first (least document, then sentence) stays; the sentences of every other place
are covered, and covered sentences are removed.

Hashes are reduced to first and last place before they meet their places again, so a passage that a third of all documents share is one row
on that side, and adaptive execution can split the other side.

Rows equal in id and text count as one document and get the same result; rows that share an id but differ in text are documents of
their own, in the order of a hash of the text, and each loses its own sentences only.  Rows with a null id are never changed and
are nobody's first place.  Null and empty texts, and texts with fewer than ``RUN`` sentences or ``MIN_WORDS`` words, have no runs.  Other
columns pass through under any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut, per_row, plain_names, release, rows_and_text, ship, unused
from wayfold.operators.bitmap import KeyFilter

RUN = 3
MIN_WORDS = 24
#: Fewest words of a piece of a longer sentence, and the length from which a piece without a boundary of its own is cut again.
LEAST = 4
LONG = 32
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_END = re.compile(r"([.!?][\"')\]]*)[ \t\r\v\f]+|\n+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def starts(each: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The first word of every piece, given the words' hashes and the first word of each sentence.

    A word starts a piece if its hash, with that of the word before it, is the least of those fewer than ``LEAST`` words away, and
    ``LEAST`` words of its sentence stand before and behind.  What is ``LONG`` or more (periodic text has no least) is cut at the least
    hash in its middle, again and again.  So what stands around a passage decides nothing behind its first such word.
    """
    n = len(each)
    mixed = (each * _MIX[0] ^ np.roll(each, 1)) * _MIX[1]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[0]
    low = np.ones(n, bool)
    for k in range(1, LEAST):
        low[k:] &= mixed[k:] < mixed[:-k]
        low[:-k] &= mixed[:-k] <= mixed[k:]
    ends = np.append(bounds[1:], n)
    for k in range(1, LEAST):
        low[np.minimum(bounds + k, n - 1)] = False
        low[np.maximum(ends - k, 0)] = False
    low[bounds] = True
    found = np.flatnonzero(low)
    size = np.diff(np.append(found, n))
    more: list[int] = []
    open_ = [(int(a), int(a + s)) for a, s in zip(found[size >= LONG], size[size >= LONG], strict=True)]
    while open_:
        x, y = open_.pop()
        if y - x >= LONG:
            k = x + LEAST + int(mixed[x + LEAST : min(y - LEAST, x + 2 * LONG) + 1].argmin())
            more.append(k)
            open_ += [(x, k), (k, y)]
    return np.sort(np.append(found, more)).astype(np.int64) if more else found


def words_of(text: str | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words, their hashes, and the first word of each sentence or piece of one."""
    text = text or ""
    every: list[bytes] = []
    bounds, begin = [], 0
    for stop, following in [*((m.start() if m[1] is None else m.end(1), m.end()) for m in _END.finditer(text)), (len(text), len(text))]:
        words = text[begin:stop].encode().lower().split()
        if words:
            bounds.append(len(every))
            every += words
        begin = following
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, every), np.uint64, len(every))
    return every, each, starts(each, np.array(bounds)) if every else np.zeros(0, np.int64)


def runs(text: str | None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The number of sentences; and of every run that has its words its first sentence, length and hash."""
    every, each, first = words_of(text)
    none = np.zeros(0, np.int64)
    if len(first) < RUN or len(every) < MIN_WORDS:
        return len(first), none, none, none
    edge = np.append(first, len(every))
    end = np.searchsorted(edge, edge[:-1] + MIN_WORDS)  # the first sentence end with enough words
    at = np.arange(len(first))
    end = np.maximum(end, at + RUN)
    at, end = at[end < len(edge)], end[end < len(edge)]
    # A run's words as digits: sums up to each word, taken apart and shifted to the start.
    power = np.full(len(every), _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.append(np.uint64(0), np.cumsum(each * power))
    back = np.full(len(every), _INVERSE, np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    x, y = edge[at], edge[end]
    hashed = (total[y] - total[x]) * back[x] ^ (y - x).astype(np.uint64)
    hashed ^= hashed >> np.uint64(31)
    return len(first), at, end - at, (hashed * _MIX[1]).view(np.int64)


def sentences(text: str | None) -> list[tuple[int, int, bytes, int]]:
    """Start, end, joined words and their number, of each sentence or piece of one."""
    text = text or ""
    every, _, first = words_of(text)
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[x][0], at[y - 1][1], b" ".join(every[x:y]), y - x) for x, y in zip(first.tolist(), [*first[1:].tolist(), len(every)], strict=False)]


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a hash of the text), n_sentences, removed (numbers of covered sentences, from 0) and first_ids (documents with the first places), of documents with any."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [runs(t.as_py()) for t in batch.column(1)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[1]) for x in found])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]).astype(t))) for k, t in ((1, np.int32), (2, np.int32), (3, np.int64))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0] for x in found], pa.int32()), *lists], ["doc_id", "row", "n", "i", "size", "h"])

    schema = "doc_id long, row long, n int, i array<int>, size array<int>, h array<long>"
    packed = cut(per_row(rows_and_text(docs, id_col, text_col).where("doc_id is not null"), block, schema))
    flat = packed.select("doc_id", "row", F.explode(F.arrays_zip("i", "size", "h")).alias("x")).select("doc_id", "row", "x.i", "x.size", "x.h")
    place = F.struct("doc_id", "row", "i")
    first = flat.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h", "first")
    hit = (
        flat.join(first, "h")
        .where(F.struct("doc_id", "row", "i") != F.col("first"))
        .groupBy("doc_id", "row")
        .agg(F.collect_set(F.struct("i", "size")).alias("starts"), F.sort_array(F.collect_set("first.doc_id")).alias("first_ids"))
        .select("doc_id", "row", F.array_sort(F.array_distinct(F.expr("flatten(transform(starts, s -> sequence(s.i, s.i + s.size - 1)))"))).alias("removed"), "first_ids")
    )
    sizes = packed.select("doc_id", "row", F.col("n").alias("n_sentences")).dropDuplicates(["doc_id", "row"])
    return hit.join(sizes, ["doc_id", "row"]).select("doc_id", "row", "n_sentences", "removed", "first_ids")


def without(text: str | None, gone: list[int]) -> str:
    """The text without these sentences and the blanks behind them."""
    text, out = text or "", set(gone)
    found = sentences(text)
    parts, at = [], 0
    for k, (start, stop, _, _) in enumerate(found):
        if k in out:
            parts.append(text[at:start])
            at = found[k + 1][0] if k + 1 < len(found) else max(stop, len(text.rstrip()))
    return "".join(parts) + text[at:]


def rewritten(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_rows: bool = True) -> DataFrame:
    """The rows of docs, texts without the sentences that ``covered`` found; without ``all_rows`` only those that lose any."""
    owner, row, numbers, mine = unused(docs, "_owner", "_row", "_numbers", "_mine")
    lists = found.select(F.col("doc_id").alias(owner), F.col("row").alias(row), F.col("removed").alias(numbers))
    names = docs.columns
    at = names.index(text_col)
    keyed = docs.withColumn(mine, F.xxhash64(F.col(text_col).cast("string")))
    touched = KeyFilter(lists, row).may_have(F.col(mine))  # only these are shuffled
    joined = keyed.where(touched).join(lists, (F.col(id_col).cast("long") == F.col(owner)) & (F.col(mine) == F.col(row)), "left" if all_rows else "inner").select(*names, numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t if g is None else without(t, g) for t, g in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, batch.column(at).type) if k == at else c for k, c in enumerate(batch.columns[: len(names)])], names)
        release()

    ship(docs.sparkSession)
    out = joined.mapInArrow(run, docs.schema)
    return out.unionByName(keyed.where(~touched).select(*names)) if all_rows else out


@plain_names
def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, texts without covered sentences."""
    return rewritten(docs, cut(covered(docs, id_col, text_col)), id_col, text_col)
