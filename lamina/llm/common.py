"""What the operators of this subpackage share: tables, shared folders, hold-out rules, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import shared_folder, ship

#: At most so many rows or bytes reach a Python worker at once, whatever the session had.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: A side of a join is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches of the session by rows and by bytes, so that very long texts cannot fill a worker, and ships the package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return ship(spark)


def written(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, read again.  Lost executors cost no recomputation.

    rows_per_file: for rows of many MB, so that a reader never holds more of them than that."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lamina/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later plan reads; tables that lie anywhere else stay."""
    conf, new = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    whole = lambda p: p.getFileSystem(conf).makeQualified(p)
    own = whole(new(f"{shared_folder(spark)}/lamina")).toString()
    for path in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        p = whole(new(path))
        if p.getParent() is not None and p.getParent().toString() == own:
            p.getFileSystem(conf).delete(p, True)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables, and lets Spark clean the shuffle files of finished plans."""
    deleted(spark, *tables)
    gc.collect()
    spark._jvm.System.gc()


def trimmed() -> None:
    """Gives a worker's freed memory back to the system at the end of a task, for workers live on and several share a machine."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def held_out(doc_id: Column, modulus: int) -> Column:
    """True for the rows that no model learns from: crc32(doc_id as text) mod modulus is 2.  A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == 2, F.lit(False))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only for a side whose counted rows stay within the bound; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
