"""Dated boundary snapshots: partitioned files, a manifest of what there is, resolution of what is asked for, and a name index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import text as t

KEYS = ["provider", "prefecture", "resolution"]
SCHEMA = "name string, parent string, id string, geom string, provider string, prefecture string, resolution string, date string"


def write_snapshot(rows: DataFrame, root: str) -> None:
    """Write the snapshots that the rows belong to; every other one stays.  rows: provider, prefecture, resolution, date, name, parent, id, geom (GeoJSON text)."""
    out = rows.select(*[F.col(c).cast("string").alias(c) for c in ("name", "parent", "id", "geom", *KEYS, "date")])
    out.repartition(*KEYS, "date").sortWithinPartitions(*KEYS, "date", "id").write.partitionBy(*KEYS, "date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All rows; a filter on provider, prefecture, resolution or date prunes the scan."""
    return spark.read.schema(SCHEMA).parquet(root)


def manifest(rows: DataFrame) -> DataFrame:
    """provider, prefecture, resolution, date, n_features, n_parents of every snapshot."""
    return rows.groupBy(*KEYS, "date").agg(F.count("*").alias("n_features"), F.countDistinct("parent").alias("n_parents"))


def resolve(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """The requests with ``exact`` (the date asked for, if it is held), ``resolved`` (else the latest one) and ``problem``.

    wanted: provider, prefecture, resolution, date (or null), parents (whether the parents' display is asked for).  held: ``manifest``.  An exact request reads
    ``exact`` and never falls back.  Without any snapshot, or without parents in the one that is found, ``problem`` says so.
    """
    dates = held.groupBy(*KEYS).agg(F.max("date").alias("latest"))
    some = held.select(*KEYS, "date", F.lit(True).alias("_held"))
    found = wanted.join(some, [*KEYS, "date"], "left").join(dates, KEYS, "left")
    exact = F.when(F.col("_held"), F.col("date"))
    dated = found.withColumn("exact", exact).withColumn("resolved", F.coalesce(exact, "latest")).drop("_held", "latest")
    counts = held.select(*KEYS, F.col("date").alias("resolved"), "n_parents")
    problem = F.when(F.col("resolved").isNull(), "no snapshot").when(F.col("parents") & (F.coalesce("n_parents", F.lit(0)) == 0), "no parents")
    return dated.join(counts, [*KEYS, "resolved"], "left").withColumn("problem", problem).drop("n_parents")


def name_index(rows: DataFrame) -> DataFrame:
    """provider, prefecture, level (municipality or parent), name, dates (resolution to sorted dates), by normalised names; null names are left out."""
    levels = F.explode(F.array(F.struct(F.lit("municipality").alias("level"), F.col("name").alias("name")), F.struct(F.lit("parent").alias("level"), F.col("parent").alias("name"))))
    flat = rows.select(*KEYS, "date", levels.alias("l")).select(*KEYS, "date", "l.level", "l.name").where("name is not null").distinct()
    each = flat.groupBy("provider", "prefecture", "level", "name", "resolution").agg(F.sort_array(F.collect_set("date")).alias("dates"))
    return each.groupBy("provider", "prefecture", "level", "name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("resolution", "dates")))).alias("dates"))


def search(index: DataFrame, name: str) -> DataFrame:
    """Entries whose normalised name is the one asked for."""
    form = lambda c: F.trim(F.regexp_replace(t.nfkc(c), r"\s+", " "))
    return index.where(form(F.col("name")) == form(F.lit(name)))
