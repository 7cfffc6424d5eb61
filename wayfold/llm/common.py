"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.components import cut as cut
from wayfold.operators.components import discard as discard
from wayfold.session import ship as ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_row(docs: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to every Arrow batch, by portions of its text; a partition keeps no state beyond the worker's bounded caches."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in portions(batch, at):
                    yield function(part)
        finally:
            release()

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns only, so that no other column can clash and the scan reads no more."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def rows_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, row: ``row`` is a hash of the text, so (doc_id, row) tells documents apart that share an id."""
    return id_and_text(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))


def unused(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plain_names(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator that passes columns on see names without dots and backticks, and give its result the names that came.

    Such names can be read as fields of structs by selections and by Arrow.  Tables without them go through unchanged.
    """

    @functools.wraps(function)
    def call(docs: DataFrame, *args: object, **options: object) -> DataFrame:
        odd = [c for c in docs.columns if "." in c or "`" in c]
        if not odd:
            return function(docs, *args, **options)
        to = dict(zip(odd, unused(docs, *(f"column{k}" for k in range(len(odd)))), strict=True))
        named = lambda v: to.get(v, v) if isinstance(v, str) else v
        found = function(docs.toDF(*[to.get(c, c) for c in docs.columns]), *map(named, args), **{k: named(v) for k, v in options.items()})
        back = {v: k for k, v in to.items()}
        return found.toDF(*[back.get(c, c) for c in found.columns])

    return call


def release() -> None:
    """Give memory that a worker has freed back to the machine; the worker lives on for other tasks and keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def portions(batch: pa.RecordBatch, at: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch with so many bytes of text in column ``at`` at most (or one row), so that what is made of them stays small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start = size = 0
    for k, n in enumerate(sizes):
        if k > start and size + n > most:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)
