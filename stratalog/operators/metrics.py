"""Space, read and write amplification of a log and its runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.model import LOG_HEAD, record_size
from stratalog.operators import state


def sized(log: DataFrame, head: int = LOG_HEAD) -> DataFrame:
    """log (key, value, tombstone) with `bytes` of each record."""
    return log.withColumn("bytes", record_size(F.col("key"), F.col("value"), F.col("tombstone"), head))


def space(log: DataFrame, order: str = "seq") -> DataFrame:
    """One row: bytes of the log a store keeps (without the deletes it refuses), of its live
    records, and their ratio."""
    kept = sized(state.accepted(log, "key", order, "tombstone"))
    all_bytes = kept.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("log_bytes"))
    merged = state.live(kept, ["key"], order, "tombstone").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("merged_bytes"))
    both = all_bytes.crossJoin(F.broadcast(merged))  # two rows of one
    return both.select("log_bytes", "merged_bytes", F.when(F.col("merged_bytes") > 0, F.col("log_bytes") / F.col("merged_bytes")).alias("amplification"))


def overwritten(sets: DataFrame, times: list[int]) -> DataFrame:
    """Per number of overwrites: log bytes, bytes after a merge and their ratio. The sets are
    written that many times, and the last of each key is kept."""
    each = sets.withColumn("overwrites", F.explode(F.array(*[F.lit(n).cast("long") for n in times])))
    log = sized(each.withColumn("_round", F.explode(F.sequence(F.lit(1).cast("long"), F.col("overwrites")))))
    written = log.groupBy("overwrites").agg(F.sum("bytes").alias("log_bytes"))
    merged = state.live(log, ["overwrites", "key"], "_round", "tombstone").groupBy("overwrites").agg(F.sum("bytes").alias("merged_bytes"))
    return written.join(merged, "overwrites").withColumn("amplification", F.col("log_bytes") / F.col("merged_bytes"))


def absorption(log: DataFrame, gen: str = "gen", order: str = "seq") -> DataFrame:
    """Per generation: bytes written ahead and bytes of entries that its run keeps."""
    written = sized(log, 12).groupBy(gen).agg(F.sum("bytes").alias("written_bytes"), F.count("*").alias("writes"))
    kept = sized(state.newest(log, [gen, "key"], order), 12).groupBy(gen).agg(F.sum("bytes").alias("run_bytes"), F.count("*").alias("entries"))
    return written.join(kept, gen)
