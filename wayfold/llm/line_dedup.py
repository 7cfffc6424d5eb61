"""Line dedup by a deletion-neighbourhood join: a line goes if an earlier one is within one edit of it.

Lines are the ``\\n``-split pieces of a text without the ASCII blanks around them; empty ones are left
alone.  Lines are ordered by (document, line number).  A line is removed if any earlier line equals it or, both having
``MIN_EDIT`` characters or more, has edit distance 1 from it (one character inserted, deleted or replaced), whether or not that line is itself removed, so the earliest always
stays.

Exact copies meet by hash.  For the rest every line emits hashed variants: itself with a window deleted.  The windows of a
line cover each place an edit can be in, so two lines within one edit share the variant whose window holds the edit;
prefixes are measured from the start and suffixes from the end in steps of the window, which makes the variants of lines
with n and n + 1 characters equal as well.  Three levels keep their number small: windows of a quarter to a half of the line for every
line (3 to 4 hashes a line); for lines that share such a variant with a different line, windows of a sixteenth of that,
inside the shared one; and for those that still share one, every single-character deletion inside it.  On
the last level equal keys mean a replacement at the same place, or a whole line equal to a variant of a longer one; each
key gives the earliest line of either kind, and the pair is verified by its edit distance.

Every join is by a key that is first reduced to its least and greatest line, so lines that share a variant are never
paired up: a group of a million similar lines costs rows in proportion.  Rows that can't meet a partner are dropped before
each join of large tables by a filter of fixed size; texts without candidates or removals are never shuffled.

Documents with nothing left of what was there are dropped by ``dedup_lines``; null, empty and untouched texts stay as they
are.  Rows equal in id and text count as one document and get the same result; rows that share an id but differ in text are documents
of their own, in the order of a hash of the text, and each loses its own lines only.  Rows with a null id are never changed and are
nobody's earlier line.  Other columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut, per_row, plain_names, release, rows_and_text, ship, unused
from wayfold.operators.bitmap import KeyFilter

#: Shorter lines are no lines.
MIN_CHARS = 1
#: Shorter lines go only as exact copies: one edit there is an eighth of the line or more, and mostly another word or number.
MIN_EDIT = 8
#: Windows of the second level are so many times smaller.
FINER = 16
BLANKS = " \t\n\v\f\r"


def lines_of(text: str | None) -> list[str]:
    return [x.strip(BLANKS) for x in (text or "").split("\n")]


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def coarse(n: int) -> int:
    """Window step of a line of n characters: a power of two, a quarter to a half of it."""
    return 1 << (n // 2).bit_length() - 1


def windows(n: int, step: int, lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    """(prefix, suffix) lengths kept, with the deleted window inside [lo, hi] or over a part of it.

    A line with n characters also has the suffix that a line one shorter has, where the two differ.
    """
    out = []
    for a in range(lo // step * step, (n if hi is None else min(n, hi)) + 1, step):
        rest = n - a - step
        s = rest // step * step if rest > 0 else 0
        out.append((a, s))
        if rest >= step and rest % step == 0:
            out.append((a, s - step))
    return out


def steps(n: int) -> set[int]:
    """A line takes part with its own step and with that of lines one shorter."""
    return {coarse(n), coarse(n - 1)}


def first_level(line: str) -> list[tuple[int, int, int]]:
    """Key, and the deleted window as start and end, for each coarse variant."""
    n = len(line)
    return [(hash_of(f"{step} {a} {s} {line[:a]}\0{line[n - s :]}"), a, n - s) for step in steps(n) for a, s in windows(n, step)]


def second_level(line: str, shared: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The same with finer windows, inside the shared ones."""
    n, out = len(line), {}
    for step in {max(1, x // FINER) for x in steps(n)}:
        for lo, hi in shared:
            for a, s in windows(n, step, lo, hi):
                out[step, a, s] = (hash_of(f"{step} {a} {s} {line[:a]}\0{line[n - s :]}"), a, n - s)
    return list(out.values())


def third_level(line: str, shared: list[tuple[int, int]]) -> list[tuple[int, bool]]:
    """Keys of single deletions inside the windows and of the whole line, and whether the key stands for the whole line.

    A replacement at place p leaves equal (p, deletion); an insertion leaves a deletion of the longer line equal to the
    whole of the shorter one.
    """
    n = len(line)
    out = {(hash_of(f"w {n} {line}"), True)}
    for lo, hi in shared:
        for p in range(lo, min(n, hi)):
            rest = line[:p] + line[p + 1 :]
            out.add((hash_of(f"r {p} {n} {rest}"), False))
            out.add((hash_of(f"w {n - 1} {rest}"), False))
    return list(out)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, n_lines, and for the lines that count: number, hash and coarse variants."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        totals, found = [], []
        for text in batch.column(1):
            text = text.as_py()
            lines = lines_of(text)
            totals.append(len(lines) if text else 0)
            found.append([{"i": i, "h": hash_of(x), "keys": [k for k, _, _ in first_level(x)] if len(x) >= MIN_EDIT else []} for i, x in enumerate(lines) if len(x) >= MIN_CHARS])
        kind = pa.list_(pa.struct([("i", pa.int32()), ("h", pa.int64()), ("keys", pa.list_(pa.int64()))]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals, pa.int32()), pa.array(found, kind)], ["doc_id", "row", "n_lines", "lines"])

    return per_row(rows_and_text(docs, id_col, text_col), block, "doc_id long, row long, n_lines int, lines array<struct<i: int, h: long, keys: array<long>>>")


def _shared(keys: DataFrame) -> DataFrame:
    """Keys that two different lines have."""
    return keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi").select("key")


def near_lines(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h, keeper_doc, keeper_row, keeper_line: each distinct line whose earliest line within one edit is a different, earlier one."""
    flat = lines.select("doc_id", "row", F.explode("lines").alias("x")).where("doc_id is not null").select("doc_id", "row", "x.i", "x.h", F.posexplode("x.keys").alias("window", "key"))
    shared = cut(_shared(flat))
    found = cut(
        flat.where(KeyFilter(shared, "key").may_have(F.col("key")))
        .join(shared, "key")
        .groupBy("h")
        .agg(F.min(F.struct("doc_id", "row", "i")).alias("at"), F.collect_set("window").alias("windows"))
        .groupBy("at.doc_id", "at.row")
        .agg(F.collect_list(F.struct("at.i", "h", "windows")).alias("lines"))
    )
    texts = rows_and_text(docs, id_col, text_col)
    texts = texts.where(KeyFilter(found, "row").may_have(F.col("row"))).join(found, ["doc_id", "row"]).select("doc_id", "row", "text", "lines")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, row, text, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                every = lines_of(text)
                for x in some:
                    level = first_level(line := every[x["i"]])
                    out.append((doc, row, x["i"], x["h"], line, [dict(zip(("key", "lo", "hi"), y, strict=True)) for y in second_level(line, [level[w][1:] for w in x["windows"]])]))
            kind = pa.list_(pa.struct([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), kind), strict=True)], ["doc_id", "row", "i", "h", "line", "parts"])
        release()

    ship(docs.sparkSession)
    some = cut(texts.mapInArrow(first, "doc_id long, row long, i int, h long, line string, parts array<struct<key: long, lo: int, hi: int>>").dropDuplicates(["h"]))
    fine = some.select("h", F.explode("parts").alias("p")).select("h", "p.key", "p.lo", "p.hi")
    narrow = fine.join(_shared(fine), "key").groupBy("h").agg(F.collect_set(F.struct("lo", "hi")).alias("parts"))
    left = some.drop("parts").join(narrow, "h").select("doc_id", "row", "i", "h", "line", "parts")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (doc, row, i, h, key, whole)
                for doc, row, i, h, line, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for key, whole in third_level(line, [(p["lo"], p["hi"]) for p in parts])
            ]
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["doc_id", "row", "i", "h", "key", "whole"])
        release()

    variants = left.mapInArrow(last, "doc_id long, row long, i int, h long, key long, whole boolean").select("h", "key", "whole", F.struct("doc_id", "row", "i", "h").alias("at"))
    # A replacement key has variants only; a line of its own length is never its whole key's variant.
    least = variants.groupBy("key").agg(
        F.min(F.when(F.col("whole"), F.col("at"))).alias("of_whole"),
        F.min(F.when(~F.col("whole"), F.col("at"))).alias("of_variant"),
        F.max("h").alias("hi"),
        F.min("h").alias("lo"),
    ).where("lo != hi")
    # Whether a key is of replacements is in its text, not its number: it is one if no whole line has it, and then variants pair with variants.
    # Deletions of two longer lines that equal no whole line also look so; the edit distance below decides.
    pairs = (
        variants.join(least, "key")
        .select("h", "at", F.when(F.col("whole"), F.col("of_variant")).otherwise(F.coalesce("of_whole", "of_variant")).alias("other"))
        .where("other < at")
        .select("h", F.col("other.h").alias("other"), F.col("other.doc_id").alias("keeper_doc"), F.col("other.row").alias("keeper_row"), F.col("other.i").alias("keeper_line"))
        .distinct()
    )
    text = some.select("h", "line")
    return (
        pairs.join(text, "h")
        .join(text.select(F.col("h").alias("other"), F.col("line").alias("other_line")), "other")
        .where(F.levenshtein("line", "other_line", 1).between(0, 1))
        .groupBy("h")
        .agg(F.min(F.struct("keeper_doc", "keeper_row", "keeper_line")).alias("k"))
        .select("h", "k.keeper_doc", "k.keeper_row", "k.keeper_line")
    )


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The packed lines, and doc_id, row, removed: line numbers (from 0) in order with the place of the earlier line."""
    lines = cut(packed(docs, id_col, text_col))
    flat = lines.select("doc_id", "row", F.explode("lines").alias("x")).where("doc_id is not null").select("doc_id", "row", "x.i", "x.h")
    near = near_lines(docs, lines, id_col, text_col).withColumn("near", F.lit(True))
    place = F.struct("doc_id", "row", "i")
    places = flat.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h", "first")
    decided = cut(
        places.join(near, "h", "full").select(
            "h",
            F.coalesce("near", F.lit(False)).alias("near"),
            F.coalesce("keeper_doc", "first.doc_id").alias("keeper_doc"),
            F.coalesce("keeper_row", "first.row").alias("keeper_row"),
            F.coalesce("keeper_line", "first.i").alias("keeper_line"),
        )
    )
    gone = (
        flat.join(decided, "h")
        .where("near or doc_id != keeper_doc or row != keeper_row or i != keeper_line")
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set(F.struct("i", "keeper_doc", "keeper_line"))).alias("removed"))
    )
    return lines, gone


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, and the removed lines with the place of an earlier line, of every row."""
    lines, gone = removals(docs, id_col, text_col)
    return lines.select("doc_id", "row", "n_lines").join(gone, ["doc_id", "row"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", F.expr("array()")).alias("removed")
    )


def without(text: str, gone: list[int]) -> str | None:
    """The text without these lines; None if only blank ones are left."""
    out = set(gone)
    left = [x for i, x in enumerate(text.split("\n")) if i not in out]
    return "\n".join(left) if any(x.strip(BLANKS) for x in left) else None


@plain_names
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without removed lines, and without the documents that had nothing else."""
    _, gone = removals(docs, id_col, text_col)
    names = docs.columns
    at = names.index(text_col)
    owner, row, numbers, mine = unused(docs, "_owner", "_row", "_numbers", "_mine")
    lists = cut(gone.select(F.col("doc_id").alias(owner), F.col("row").alias(row), F.col("removed.i").alias(numbers)))
    keyed = docs.withColumn(mine, F.xxhash64(F.col(text_col).cast("string")))
    touched = KeyFilter(lists, row).may_have(F.col(mine))
    joined = keyed.where(touched).join(lists, (F.col(id_col).cast("long") == F.col(owner)) & (F.col(mine) == F.col(row)), "left").select(*names, numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone_of = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            new = [t if g is None else without(t or "", g) for t, g in zip(texts, gone_of, strict=True)]
            stays = np.array([g is None or n is not None for n, g in zip(new, gone_of, strict=True)], bool)
            columns = [pa.array(new, batch.column(at).type) if k == at else c for k, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stays))
        release()

    ship(docs.sparkSession)
    return joined.mapInArrow(run, docs.schema).unionByName(keyed.where(~touched).select(*names))
