"""A Parquet cache of features by class, with flat bounds for pushdown, and its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.sources.features import vertices

BOUNDS = ("bbox_west", "bbox_south", "bbox_east", "bbox_north")


def with_bounds(rows: DataFrame) -> DataFrame:
    """Flat columns, so that row groups can be skipped by their least and greatest values."""
    b = g.bounds(vertices(F.col("geom")))
    return rows.withColumns({c: b[k] for k, c in zip("wsen", BOUNDS, strict=True)})


def write_cache(rows: DataFrame, root: str, class_col: str) -> None:
    """Write the classes that the rows have; others that the cache holds stay.  The manifest has every class's count and bounds."""
    spark = rows.sparkSession
    out = with_bounds(rows.withColumn("class", F.col(class_col).cast("string")))
    out.repartition("class", F.floor(F.col("bbox_west"))).sortWithinPartitions("class", "bbox_west").write.partitionBy("class").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/features")
    every = spark.read.parquet(f"{root}/features")
    every.groupBy(F.col("class").cast("string").alias("class")).agg(F.count("*").alias("n"), *[(F.min if c in BOUNDS[:2] else F.max)(c).alias(c) for c in BOUNDS]).coalesce(1).write.mode("overwrite").json(f"{root}/manifest")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("class string, n long, bbox_west double, bbox_south double, bbox_east double, bbox_north double").json(f"{root}/manifest")


def missing_classes(spark: SparkSession, root: str, wanted: list[str]) -> DataFrame:
    """Wanted classes that the cache does not hold."""
    return spark.createDataFrame([(c,) for c in wanted], "class string").join(manifest(spark, root), "class", "left_anti")


def read_cache(spark: SparkSession, root: str, classes: list[str] | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features of some classes whose bounds meet a box; classes prune partitions and the box reaches the scan."""
    rows = spark.read.parquet(f"{root}/features").withColumn("class", F.col("class").cast("string"))
    if classes is not None:
        rows = rows.where(F.col("class").isin(classes))
    if box:
        w, s, e, n = box
        rows = rows.where((F.col("bbox_west") <= e) & (F.col("bbox_east") >= w) & (F.col("bbox_south") <= n) & (F.col("bbox_north") >= s))
    return rows


def read_registry(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Entries of JSON documents by an explicit schema, and the names of documents that are malformed."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.input_file_name().alias("file"), F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.where(~bad).select("r.*", "file").drop("_corrupt"), rows.where(bad).select("file")
