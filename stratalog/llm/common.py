"""Shared plumbing of the llm operators: reading tables, shared storage, small joins."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: Rows up to which a side of a join counts as small enough to broadcast; callers count first.
BROADCAST_ROWS = 200_000


#: Rows in an Arrow batch to Python: whole texts can be long, and Spark bounds a batch by rows alone.
ARROW_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Set for the session, as plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def released(batches: Iterator[T]) -> Iterator[T]:
    """The batches of a task; when it is done its Python worker, which later tasks use too, gives
    back to the system what it has freed."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        libc = ctypes.util.find_library("c")
        trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None  # glibc only
        if trim is not None:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a private one only where the cluster names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        folder = known or f"file://{tempfile.mkdtemp(prefix='stratalog-')}"
        if not known:
            spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalog/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint where its counted rows are within BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """df with `rank` (long, from 0) in the given order, without one task that sorts all rows.

    Rows are range-partitioned and sorted, then each partition adds the counts of those
    before it. df is stored first, as sampled ranges must not move between two reads."""
    spark = df.sparkSession
    ranged = stored(df, "rank-in").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)), "rank-out")
    counts = ranged.groupBy("_p").count().orderBy("_p").collect()  # a row per partition
    at, first = 0, []
    for row in counts:
        first.append((row["_p"], at))
        at += row["count"]
    if not first:
        return ranged.withColumn("rank", F.lit(0).cast("long")).drop("_p", "_i")
    offsets = spark.createDataFrame(first, "_p int, _first long")
    return ranged.join(F.broadcast(offsets), "_p").withColumn("rank", F.col("_first") + F.col("_i")).drop("_p", "_i", "_first")
