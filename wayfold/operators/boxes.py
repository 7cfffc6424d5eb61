"""Areas of unions of upright rectangles, with their coordinates as they are: nothing is snapped, and nothing is linked to rings.

A key's rectangles are cut into strips between neighbouring left and right sides; a strip's area is its width times what the rectangles in it cover
upright.  Keys follow each other in sorted partitions and many are worked out at once; a key's strips come in portions, so memory doesn't grow with a crowded key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.session import ship

#: Rectangles whose keys are worked out together; pairs of a rectangle and a strip at once.
ROWS, PORTION = 1 << 16, 1 << 20
SIDES = ["w", "s", "e", "n"]


def areas(boxes: DataFrame, key: str) -> DataFrame:
    """key, area: of the union of each key's rectangles (w, s, e, n).

    Keys are whole numbers.  Rectangles without area, or with a null or infinite side, count for nothing; a key with no others has no row.
    """
    sound = [F.coalesce(F.abs(F.col(c)) < 1e300, F.lit(False)) for c in SIDES]
    whole: Column = F.col(key).isNotNull() & (F.col("w") < F.col("e")) & (F.col("s") < F.col("n"))
    for one in sound:
        whole = whole & one
    rows = boxes.where(whole).select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in SIDES])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(map(len, kept)) < ROWS:
                continue
            table = pa.Table.from_batches(kept)
            keys = table.column(0).to_numpy()
            done = int(np.searchsorted(keys, keys[-1]))  # more of the last key may follow
            if done:
                yield made(table.slice(0, done))
                kept = table.slice(done).to_batches()
        if kept:
            yield made(pa.Table.from_batches(kept))

    def made(table: pa.Table) -> pa.RecordBatch:
        names, found = union_areas(*(c.to_numpy() for c in table.columns))
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(found)], [key, "area"])

    ship(boxes.sparkSession)
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(work, f"{key} long, area double")


def union_areas(keys: np.ndarray, w: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, each once, and the area that each one's rectangles cover."""
    order = np.argsort(s, kind="stable")  # so those of a strip come from below
    keys, w, s, e, n = (c[order] for c in (keys, w, s, e, n))
    names, code = np.unique(keys, return_inverse=True)
    side, of = np.concatenate([w, e]), np.concatenate([code, code])
    at = np.lexsort((side, of))
    side, of = side[at], of[at]
    new = np.ones(len(at), bool)
    new[1:] = (side[1:] != side[:-1]) | (of[1:] != of[:-1])
    place = np.empty(len(at), np.int64)
    place[at] = np.cumsum(new) - 1
    side, of = side[new], of[new]  # strip k lies between the sides k and k + 1
    lo, hi = place[: len(w)], place[len(w) :]
    before = np.concatenate([[0], np.cumsum(np.cumsum(np.bincount(lo, minlength=len(side)) - np.bincount(hi, minlength=len(side))))])
    tops, rank = np.unique(n, return_inverse=True)
    found, a = np.zeros(len(names), np.longdouble), 0
    while a < len(side):
        b = max(a + 1, int(np.searchsorted(before, before[a] + PORTION, "right")) - 1)
        some = np.flatnonzero((lo < b) & (hi > a))
        first, many = np.maximum(lo[some], a), np.minimum(hi[some], b) - np.maximum(lo[some], a)
        box = np.repeat(some, many)
        strip = np.arange(len(box)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        up = np.argsort(strip, kind="stable")
        box, strip = box[up], strip[up]
        if len(box):
            top = np.maximum.accumulate((strip - a) * len(tops) + rank[box])  # the highest so far in the strip
            start = np.ones(len(box), bool)
            start[1:] = (strip[1:] != strip[:-1]) | (s[box[1:]] > tops[top[:-1] % len(tops)])
            start = np.flatnonzero(start)
            high = tops[top[np.append(start[1:], len(box)) - 1] % len(tops)].astype(np.longdouble)
            at = strip[start]
            part = (side[at + 1].astype(np.longdouble) - side[at]) * (high - s[box[start]])
            ends = np.flatnonzero(np.concatenate([[True], of[at][1:] != of[at][:-1]]))
            found[of[at[ends]]] += np.add.reduceat(part, ends)
        a = b
    return names, found.astype(float)
