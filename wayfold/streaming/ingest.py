"""An extension: features that arrive as files of one GeoJSON feature a line go into the class cache batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfold.sources.cache import with_bounds
from wayfold.sources.features import geometry


def ingest(spark: SparkSession, source: str, root: str, class_key: str, checkpoint: str) -> StreamingQuery:
    """Append each new file's features to ``root/features`` by class, once, and stop when none is left."""
    rows = spark.readStream.schema("id string, properties map<string, string>, geometry string").json(source)
    shaped = rows.select("id", "properties", geometry(F.col("geometry")).alias("geom"), F.col("properties")[class_key].alias("class")).where("class is not null")

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is tried again replaces its own folder, so nothing comes twice.
        with_bounds(batch).write.partitionBy("class").mode("overwrite").parquet(f"{root}/features/batch={number}")

    return shaped.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
