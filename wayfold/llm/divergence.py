"""Source divergence audit: how far the sources of a language are from each other, and which terms set each of them apart.

Every group (a language's source) and every language as a whole gives each kept term the share
``p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))`` of its N occurrences of the language's V kept terms; a term is kept if
``LEAST`` or more documents of the language have it.  The distance of two groups is the sum of ``|p - q|`` over all kept terms.

That sum is not taken term by term.  A pair of groups has few distinct (count, count) combinations, so for each pair those are tallied
into a joint histogram: cells where both counts are positive come from the terms that both groups have, with a count before the
shuffle; cells where one count is 0 are implied by each group's own histogram less what the positive cells have of it, and the cell (0, 0) by
V.  The distance is evaluated once a cell and multiplied.  No term is ever paired with a group that lacks it.

Words are counted inside tasks, documents before the shuffle, into dictionaries of bounded size; the sums are those over all documents.  Arithmetic is in
whole numbers throughout, exact for counts up to 9 * 10^15.  Null texts, languages and sources are empty strings; repeated rows count as
documents each; a language without kept terms has distances of 0.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import cut, portions, release, ship

LEAST, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Distinct (group, term) entries that a task holds before it passes them on.
HELD = 200_000
#: What is no ASCII letter separates; A-Z are lower-cased; bytes of other characters stay.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters and of any other characters beyond ASCII."""
    return (text or "").encode().translate(_LETTERS).split()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), name(text_col).alias("text"))

    def rows_of(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs_) in held.items():
            size = len(n)
            columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(n.values()), pa.int64()), pa.array([docs_[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        try:
            for part in (x for batch in batches for x in portions(batch, 2)):
                for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = terms(text)
                    n, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(n)
                    n.update(words)
                    docs_.update(set(words))
                    size += len(n)
                if size > HELD:
                    yield from rows_of(held)
                    held, size = {}, 0
            yield from rows_of(held)
        finally:
            release()

    ship(docs.sparkSession)
    made = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term and counts, an array of (source, n) by source, of the terms that enough documents of their language have."""
    pairs = F.sort_array(F.collect_list(F.struct("source", "n")))  # one entry a source
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), pairs.alias("counts")).where(F.col("docs") >= least).select("lang", "term", "counts")


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kinds)), by long division in three steps of a thousand, so that no product overflows."""
    whole = F.greatest(total + PRIOR * kinds, F.lit(1))
    left, digits = count + PRIOR, F.lit(0).cast("long")
    for _ in range(3):  # SCALE is a thousand cubed
        left = left * 1000
        digits = digits * 1000 + F.call_function("div", left, whole)
        left = left % whole
    return digits + 1


def totals(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), have (kept terms that occur), kinds (kept terms of the language) of every group."""
    flat = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"), F.count("*").alias("have"))
    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return groups.join(flat, ["lang", "source"], "left").join(kinds, "lang", "left").select("lang", "source", zero("total"), zero("have"), zero("kinds"))


def cells(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, one, two, x, y, m: for each pair of groups how many kept terms occur x times in the one and y times in the other, zeros included.

    pairs: lang, one, two (a source behind the first), have1, have2 (kept terms that occur in each) and kinds.
    """
    both = kept.select("lang", "counts", F.posexplode("counts").alias("i", "a")).select("lang", "a", F.explode(F.slice("counts", F.col("i") + 2, F.size("counts"))).alias("b"))
    joint = both.groupBy("lang", F.col("a.source").alias("one"), F.col("b.source").alias("two"), F.col("a.n").alias("x"), F.col("b.n").alias("y")).agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("long")
    cell = lambda x, y, m: F.struct(x.alias("x"), y.alias("y"), m.alias("m"))
    x, y, m = F.col("x"), F.col("y"), F.col("m")
    keys = ["lang", "one", "two"]
    positive = joint.select(*keys, F.explode(F.array(cell(x, y, m), cell(x, zero, -m), cell(zero, y, -m), cell(zero, zero, m))).alias("c"))
    own = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source"), F.col("c.n").alias("n")).agg(F.count("*").alias("m"))
    first = pairs.join(own.withColumnRenamed("source", "one"), ["lang", "one"]).select(*keys, cell(F.col("n"), zero, m).alias("c"))
    second = pairs.join(own.withColumnRenamed("source", "two"), ["lang", "two"]).select(*keys, cell(zero, F.col("n"), m).alias("c"))
    neither = pairs.select(*keys, cell(zero, zero, F.col("kinds") - F.col("have1") - F.col("have2")).alias("c"))
    every = positive.unionByName(first).unionByName(second).unionByName(neither)
    return every.groupBy(*keys, F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.sum("c.m").alias("m")).where("m != 0")


def distances(kept: DataFrame, facts: DataFrame) -> DataFrame:
    """lang, one, two, value: the distance of every two groups of a language, one row a pair."""
    one = facts.select("lang", F.col("source").alias("one"), F.col("total").alias("total1"), F.col("have").alias("have1"), "kinds")
    two = facts.select("lang", F.col("source").alias("two"), F.col("total").alias("total2"), F.col("have").alias("have2"))
    pairs = cut(one.join(two, "lang").where("one < two"))  # as many rows as the report has
    p, q = share(F.col("x"), F.col("total1"), F.col("kinds")), share(F.col("y"), F.col("total2"), F.col("kinds"))
    summed = cells(kept, pairs).join(pairs, ["lang", "one", "two"]).groupBy("lang", "one", "two").agg(F.sum(F.col("m") * F.abs(p - q)).alias("value"))
    return pairs.select("lang", "one", "two").join(summed, ["lang", "one", "two"], "left").select("lang", "one", "two", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = rows.withColumn("rank", F.row_number().over(order))
    return found if most is None else found.where(F.col("rank") <= most)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair`` has each other source of the language with its distance; part ``term`` the ``top`` kept terms whose share in the group is above
    that in the language, by how much.  Equal values rank by the bytes of the item.
    """
    name = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    kept = cut(kept_terms(counted(docs, text_col, lang_col, source_col), least))
    facts = cut(totals(docs.select(name(lang_col, "lang"), name(source_col, "source")).distinct(), kept))
    found = distances(kept, facts)
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    pairs = _ranked(found.select("lang", both.alias("e"), "value").select("lang", "e.source", "e.item", "value"))
    everywhere = facts.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    flat = kept.select("lang", F.col("term").alias("item"), F.aggregate("counts", F.lit(0).cast("long"), lambda t, c: t + c["n"]).alias("lang_n"), F.explode("counts").alias("c")).select("lang", "item", "lang_n", "c.source", "c.n")
    over = share(F.col("n"), F.col("total"), F.col("kinds")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))
    apart = flat.join(facts, ["lang", "source"]).join(everywhere, "lang").withColumn("value", over).where("value > 0")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(_ranked(apart.select("lang", "source", "item", "value"), top).withColumn("part", F.lit("term")).select(*columns))
