"""A pipeline over ``documents``: language ID, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which ``run`` writes as Parquet to the
shared folder and reads again for the next stage.  All but the last return the columns of documents.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import decontaminate, language_id, line_dedup, sentence_pieces, simhash
from wayfold.llm.common import discard, release, table
from wayfold.operators.components import shared_folder

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: no letters, or a calibrated score below its limit."""
    return language_id.identify(docs, language_id.fit(docs), keep=True)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go, and documents that had only such lines."""
    return line_dedup.dedup_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays: fingerprints that the tree links, and pairs at a Jaccard similarity of 0.8 or more, over runs of five words."""
    return simhash.without_near_duplicates(docs, shingle=5, least=0.8, both=True)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the ids of its best segmentation, its score and the N best scores."""
    return sentence_pieces.encode(docs, keep=["doc_id"])


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("sentence_pieces", encode_pieces),
]

#: SQL expresses none of the trained, hashed and aligned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)  # the last stage's files are the result
        before = path
        _tidy(spark)
    return docs


def _tidy(spark: SparkSession) -> None:
    """Drop what a stage has left on the driver: its filters, its plans and what its model was fitted on."""
    gc.collect()
    release()
    spark._jvm.System.gc()
