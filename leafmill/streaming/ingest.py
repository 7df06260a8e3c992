"""A folder of files as a stream: each micro-batch is classified, inspected and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.sources import images

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """New files of a folder with their kind."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).load(folder)
    return files.withColumn("kind", images.source_type(F.col("content")))


def inspect_into(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the image headers of arriving files as Parquet, once for each file, and stop when none are left."""

    def batch(df: DataFrame, batch_id: int) -> None:
        images.inspected(df.where("kind <> 'pdf'")).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kind_counts(files: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Files and bytes by kind and event-time window; later ones than ``late`` are left out."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", every), "kind").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
