"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_LOCK = threading.Lock()
_BUSY: dict[str, list] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, one of our own in local mode and an error on a cluster."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not where and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "wayfold-checkpoints"))
    return where or sc._jsc.sc().getCheckpointDir().get()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared checkpoint folder: lineage ends there and lost executors cost nothing.

    The shuffles that made them are deleted as soon as the files are whole.  The setting that says so belongs to the session: it is
    set while any thread is in here, and what it was is put back behind the last one.
    """
    spark = df.sparkSession
    shared_folder(spark)
    key = str(id(spark._jsparkSession))
    with _LOCK:
        held = _BUSY.setdefault(key, [0, spark.conf.get(_CLEAN, None)])
        held[0] += 1
        spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew, under the setting
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                del _BUSY[key]
                spark.conf.set(_CLEAN, held[1]) if held[1] is not None else spark.conf.unset(_CLEAN)


def shuffled(df: DataFrame) -> DataFrame:
    """The same rows for a join that sends neither side to the driver: Spark guesses the size of rows behind an ``explode`` or a checkpoint from before it, and would broadcast millions of them."""
    return df.hint("merge")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that each node of an edge can reach.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every step hangs neighbours on the smallest
    node known, so the number of rounds follows the logarithm of the components' size.  Neighbours are never gathered: a
    step is a minimum per node, combined before the shuffle, and an equi-join that adaptive execution can split at a hub.
    Loops keep their node as a component of its own; null ends are left out.  The edges are read once.
    """
    given = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    given = cut(given.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    loops = given.where("u = v").select(F.col("u").alias("node"))
    now = given.where("u != v")
    mark = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u != v").distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).union(loops).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.join(now, roots["node"] == now["u"], "left_anti").select("node", F.col("node").alias("component")))
