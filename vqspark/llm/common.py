"""What the operators share: reading tables, cutting lineage durably and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_libc = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where none is set, as in tests."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not held:
        held = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="vqspark-")
        shared_dir.own = held
    return held.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/vqspark/{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later work doesn't depend on lost executors.

    Results are read lazily, so the files stay while the application runs; see `discard`.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> bool:
    """Deletes what this application has written by `durable`, once no result that reads it is wanted any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    return bool(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts(batch: pa.RecordBatch, column: str, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The batch in slices of a bounded number of bytes of the given string column, or of one row."""
    size = np.zeros(batch.num_rows + 1, dtype=np.int64)
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    np.cumsum(lengths.to_numpy(zero_copy_only=False), out=size[1:])
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(size, size[row] + most, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def trim() -> None:
    """Hands freed memory back, as a Python worker stays for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def held_out() -> F.Column:
    """True for the rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
