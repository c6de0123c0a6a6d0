"""Streams of mutations: runs by micro-batch, and newest per key as streaming state.

Order is carried by seq, so late rows need no watermark; a store keeps tombstones for them until
they are settled. Checkpoints hold what a write-ahead
log would; a batch that is run again publishes the same run number once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.plans.store import RunStore


def to_runs(stream: DataFrame, store: RunStore, checkpoint: str, compact_at: int | None = None) -> StreamingQuery:
    """Each micro-batch becomes a run of the store; with compact_at, runs are merged when there are so many."""

    def publish(batch: DataFrame, number: int) -> None:
        store.flush(batch, number)
        if compact_at is not None:
            store.maybe_compact(compact_at)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_stream(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row per key of an unbounded stream, in update mode."""
    rest = [c for c in stream.columns if c != key]
    last = stream.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def newest_to_table(stream: DataFrame, key: str, order: str, checkpoint: str, folder: str) -> StreamingQuery:
    """Keep newest_stream() as Parquet: each batch writes the keys it changed under its number."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return newest_stream(stream, key, order).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
