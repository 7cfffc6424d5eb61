"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of ASCII letters and digits and of anything beyond ASCII.  A document's stretch is aligned with an
item by Smith-Waterman over words (``MATCH``, ``MISMATCH``, ``GAP``).  The score is the best local alignment over that of the
item with itself, 0 to 1, so edited, cut and paraphrased copies score by what is left of the item.  A pair with ``MIN_SCORE`` or more
is a leak.

N-grams are pairs of words, next to each other or with one word between.  If an alignment scores s of an item of m words, then at most
2 (M - s m) words are edited besides its M matches, so of the M - 1 steps from match to match at least s m - 1 have one edit or none
(``links``), and each of these is an n-gram that both have.  An item has m - 1 places where n-grams start.  They are ranked by the number of
documents that have them; the rarest are the item's seeds, as many that at least ``SEEDS`` (all, if fewer are due) are among any ``links`` of them.
So a stretch that scores enough has that many seeds, and no two matches of it drift apart by more than 2 (1 - s) m words (``drift``).  Where a document has
them so close, its links are counted, and with enough of them it is aligned.  No pair is lost for its kind of edits, and an item that
was copied a million times keeps its seeds, which are rare among its own.

Documents are read twice and never shuffled: the items are the stated query set, sent to all tasks in blocks of
``BLOCK_WORDS`` words at most, one pass over the documents a block.  Counts of seeds are summed on the executors; what comes
back is a number an n-gram of the block.

Items under ``GRAM`` words match nothing, as their words alone tell no copy from common speech, and items under twice that need as many links as a run
of ``GRAM`` words has; nor do null and empty texts match.  Items with a null id are left out, as a pair could not name them.  Items with equal texts are reported each; repeated rows of documents give repeated rows.
A stretch of any length is aligned whole, in overlapping windows of ``WINDOW`` words and three times the item's, so memory doesn't follow the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import id_and_text, plain_names, ship

GRAM = 4
SEEDS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
BLOCK_WORDS = 1_000_000
WINDOW = 1 << 16
SCHEMA = "doc_id long, item_id long, score double, start_word long, end_word long"
_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_BLANK).split()


def links(m: int, score: float) -> int:
    """The number of steps with one edit or none that an alignment of this score has at least, for an item of m words."""
    return max(math.ceil(score * m - 1 - 1e-9), GRAM - 1)


def drift(m: int, score: float) -> int:
    """How far matches of such an alignment may lie off one another's diagonals at most."""
    return math.floor(2 * (1 - score) * m + 1e-9)


@dataclass
class Block:
    """A block of items: words by number, each item's words, and the n-grams as sorted keys with the places they have in items."""

    items: list[int]
    vocabulary: dict[bytes, int]
    words: list[np.ndarray]
    keys: np.ndarray
    #: Places of key k are first[k] to first[k + 1].
    first: np.ndarray
    item_at: np.ndarray
    offset_at: np.ndarray
    held: dict[float, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple[int, list[bytes]]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in x], np.int64) for _, x in rows]
        some = [k for k, w in enumerate(words) if len(w) >= GRAM]
        every = np.concatenate([np.zeros(0, np.int64), *(_pairs(words[k], step, len(vocabulary)) for k in some for step in (1, 2))])
        sizes = [len(words[k]) - step for k in some for step in (1, 2)]
        item = np.repeat(np.repeat(np.array(some, np.int64), 2), sizes)
        offset = np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)])
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        return Block([i for i, _ in rows], vocabulary, words, keys, np.append(first, len(every)), item[order], offset[order])

    def grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the block's n-grams start in a document, and their keys' numbers."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for step in (1, 2) if len(self.keys) else ():
            at = np.flatnonzero((ids[:-step] >= 0) & (ids[step:] >= 0))
            keys = ids[at] * len(self.vocabulary) + ids[at + step]
            k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            same = self.keys[k] == keys
            found.append((at[same], k[same]))
        at, key = zip(*found, strict=True)
        return np.concatenate(at), np.concatenate(key)

    def numbers(self, text: str | None) -> np.ndarray:
        """A document's words by number, -1 for words that no item has."""
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def seeds(self, df: np.ndarray, min_score: float) -> Block:
        """The block with each item's rarest n-grams only, given the number of documents of each key."""
        sizes = np.array([len(w) for w in self.words], np.int64)
        base = np.cumsum(sizes) - sizes
        each = np.repeat(df, np.diff(self.first))
        slot = base[self.item_at] + self.offset_at
        n = np.bincount(slot, each, sizes.sum())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        n[base[sizes > 0] + sizes[sizes > 0] - 1] = np.inf  # no n-gram starts at the last word
        rank = np.empty(len(n), np.int64)
        rank[np.lexsort((n, owner))] = np.arange(len(n))
        due = np.array([links(m, min_score) for m in sizes.tolist()], np.int64)
        rare = (rank - base[owner] < (sizes - 1 - due + np.minimum(due, SEEDS))[owner])[slot] & (each > 0)
        used, first = np.unique(np.repeat(np.arange(len(self.keys)), np.diff(self.first))[rare], return_index=True)
        return Block(self.items, self.vocabulary, self.words, self.keys[used], np.append(first, rare.sum()), self.item_at[rare], self.offset_at[rare])

    def limits(self, min_score: float) -> tuple[np.ndarray, np.ndarray]:
        """For each item the seeds that a leak has at least, and how far they may drift."""
        if min_score not in self.held:
            self.held[min_score] = self._limits(min_score)
        return self.held[min_score]

    def _limits(self, min_score: float) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(w) for w in self.words]
        return np.array([min(links(m, min_score), SEEDS) for m in sizes], np.int64), np.array([drift(m, min_score) for m in sizes], np.int64)

    def stretches(self, ids: np.ndarray, min_score: float) -> Iterator[tuple[int, np.ndarray]]:
        """Items and the places where they would start, by the seeds that a document has close enough, in their order."""
        at, key = self.grams(ids)
        count = self.first[key + 1] - self.first[key]
        place = np.repeat(self.first[key], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item, start = self.item_at[place], np.repeat(at, count) - self.offset_at[place]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        due, far = self.limits(min_score)
        due, far = due[item], far[item]
        begin = np.flatnonzero(np.arange(len(item)) + due <= len(item))
        end = begin + due[begin] - 1
        close = (item[end] == item[begin]) & (start[end] - start[begin] <= far[begin])
        if not close.any():
            return
        inside = np.zeros(len(item) + 1, np.int64)
        np.add.at(inside, begin[close], 1)
        np.add.at(inside, end[close] + 1, -1)
        kept = np.flatnonzero(np.cumsum(inside)[:-1])
        item, start, far = item[kept], start[kept], far[kept]
        cuts = np.flatnonzero((item[1:] != item[:-1]) | (start[1:] - start[:-1] > far[1:])) + 1
        for one in np.split(np.arange(len(item)), cuts) if len(item) else ():
            yield int(item[one[0]]), start[one]

    def leaks(self, text: str | None, min_score: float) -> list[tuple[int, float, int, int]]:
        """Item, score, first word and end of the best alignment of each item that a text leaks, of equal ones the first."""
        ids = self.numbers(text)
        best: dict[int, tuple[float, int, int]] = {}
        for one, starts in self.stretches(ids, min_score):
            words = self.words[one]
            m = len(words)
            if one in best and best[one][0] == 1.0:
                continue
            exact = next((s for s in dict.fromkeys(starts.tolist()) if s >= 0 and np.array_equal(ids[s : s + m], words)), None)
            if exact is not None:
                best[one] = (1.0, exact, exact + m)
                continue
            lo = max(0, int(starts[0]) - drift(m, min_score))
            near = ids[lo : int(starts[-1]) + m + drift(m, min_score)]
            if len(near) <= WINDOW and linked(words, near) < links(m, min_score):
                continue
            score, a, b = align_windows(words, near)
            if score >= min_score and score > best.get(one, (0.0,))[0]:
                best[one] = (score, a + lo, b + lo)
        return [(self.items[one], *x) for one, x in best.items()]


def linked(item: np.ndarray, text: np.ndarray) -> int:
    """At how many of its words an item has an n-gram of the text, whichever of the two has a word between."""
    same = text[:, None] == item[None, :]
    some = np.zeros(len(item), bool)
    for down in (1, 2):
        for over in (1, 2):
            some[:-over] |= (same[:-down, :-over] & same[down:, over:]).any(0)
    return int(some.sum())


def _pairs(words: np.ndarray, step: int, size: int) -> np.ndarray:
    return words[:-step] * size + words[step:]


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman: score over the item's own, and the stretch of text aligned (its start is where the best path leaves 0)."""
    n = len(text)
    if not n or not len(item):
        return 0.0, 0, 0
    slope = -GAP * np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, span = 0, (0, 0)
    for w in item:
        over = row[:-1] + np.where(text == w, MATCH, MISMATCH)
        down = row[1:] + GAP
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(np.maximum(over, down), 0)
        source = np.arange(n + 1)
        source[1:] = np.where(new[1:] == 0, source[1:], np.where(new[1:] == over, begin[:-1], begin[1:]))
        # Gaps in the item: the largest earlier value, less the distance.
        lifted = np.maximum.accumulate(new + slope)
        where = np.maximum.accumulate(np.where(new + slope == lifted, np.arange(n + 1), 0))
        row = lifted - slope
        begin = np.where(row > new, source[where], source)
        k = int(row.argmax())
        if row[k] > best:
            best, span = int(row[k]), (int(begin[k]), k)
    return best / (MATCH * len(item)), *span


def align_windows(item: np.ndarray, text: np.ndarray, window: int = WINDOW) -> tuple[float, int, int]:
    """The same over a text of any length; of equal alignments one of the first window that has any.

    An alignment has at most the item's words matched, at ``MATCH`` each, and every further word of the text costs a ``GAP``: it is under
    1 + MATCH / -GAP items long, so one that starts in a window ends within that overlap.
    """
    overlap = len(item) * (1 + MATCH // -GAP)
    best = (0.0, 0, 0)
    for lo in range(0, max(len(text), 1), window):
        score, a, b = align(item, text[lo : lo + window + overlap])
        best = max(best, (score, a + lo, b + lo), key=lambda x: x[0])
    return best


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[Block]:
    rows: list[tuple[int, list[bytes]]] = []
    size = 0
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).where(F.col(item_col).isNotNull()).orderBy(item_col, text_col).toLocalIterator():
        words = words_of(r[1])
        if rows and size + len(words) > most:
            yield Block.of(rows)
            rows, size = [], 0
        rows.append((r[0], words))
        size += len(words)
    if rows:
        yield Block.of(rows)


def _seeded(rows: DataFrame, block: Block, min_score: float) -> Block:
    """The block with the seeds that counts over the corpus give."""
    sent = rows.sparkSession.sparkContext.broadcast(block)  # BLOCK_WORDS words at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent.value.keys), np.int64)
        for batch in batches:
            for text in batch.column(0):
                df[np.unique(sent.value.grams(sent.value.numbers(text.as_py()))[1])] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["key", "n"])

    df = np.zeros(len(block.keys), np.int64)
    counted = rows.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    df[counted["key"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return block.seeds(df, min_score)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score and the stretch of words, for every leaked pair."""
    spark = docs.sparkSession
    ship(spark)
    rows = id_and_text(docs, id_col, text_col)
    out = spark.createDataFrame([], SCHEMA)
    for k, block in enumerate(blocks(benchmark, item_col, item_text_col, block_words)):
        sent = spark.sparkContext.broadcast(_seeded(rows, block, min_score))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in sent.value.leaks(text.as_py(), min_score)]
                columns = zip(*found, strict=True) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word"])

        part = rows.mapInArrow(find, SCHEMA)
        out = out.union(part) if k else part
    return out


@plain_names
def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that leak no item, as they were."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text_col, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(_seeded(docs.select(F.col(text_col).cast("string").alias("text")), block, min_score))

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.leaks(t.as_py(), min_score) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
