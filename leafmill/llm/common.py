"""What several operators share: reading, settling results, and Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back; options: of the Parquet writer.

    Cuts lineage and keeps what is used twice from being made twice; lost
    executors take nothing with them.
    """
    path = f"{shared_dir(df.sparkSession)}/leafmill-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables from which everything that is still needed has been settled since."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text, whatever else docs has; a null text stays null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def blobs(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """A string column; null is empty, and bytes that are not valid UTF-8 read as U+FFFD."""
    return [x.decode("utf-8", "replace") for x in blobs(column)]


def unsqueezed(column: pa.Array) -> list[bytes]:
    """Texts from Zstandard frames; null is empty."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [b"" if x is None else unpack(x) for x in column.to_pylist()]


#: Spark's simple types as Arrow's, for the flat results of mapInArrow.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


#: Rows of a batch are worked on in slices of about so many bytes, so that a worker holds little at a time.
SLICE = 4 << 20


def sliced(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows of about ``size`` bytes; empty batches are left out."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(size, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def map_batches(df: DataFrame, ddl: str, make: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """mapInArrow for a function that yields dicts of columns for each batch.

    ddl: "name type, ..." with the types of ARROW.
    """
    schema = pa.schema([(n, ARROW[t]) for n, t in (x.split() for x in ddl.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for columns in make(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)
