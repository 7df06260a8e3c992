"""The folder that driver and executors share, and results kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session gets a folder of its own; a cluster,
    whose executors would each write to their own disk, gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        jvm_dir = context._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found and context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='leafmill-')}")
        found = context._jsc.sc().getCheckpointDir().get()
    return found


def reliable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: made once, where a checkpoint is made twice.

    Its joins are sorted ones: files of like rows are a small part of the rows'
    size, so millions of them would pass for a table to broadcast and come to the driver.
    """
    path = f"{shared_dir(df.sparkSession)}/leafmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
