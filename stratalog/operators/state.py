"""Current state of a mutation log: newest per key, lookups, scans, outcomes of deletes.

Columns are named by the caller; rows need an order column that is unique per key. The
newest mutation of each key comes from max_by, so the shuffle moves one row per key and
task. A tombstone is a flag beside a null value, never the null alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.operators.joins import small_side


def newest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`, tombstones included."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def newest_narrow(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """newest() for wide rows of a large stored log: a hash aggregate of the order column alone,
    then a semi-join back, so whole rows aren't sorted. `order` must be stored, not generated."""
    last = log.groupBy(*keys).agg(F.max(order).alias(order))
    return log.join(last, [*keys, order], "left_semi")


def live(log: DataFrame, keys: list[str], order: str, tombstone: str = "tomb") -> DataFrame:
    """Current rows of the keys that aren't deleted."""
    return newest(log, keys, order).where(~F.col(tombstone))


def get(log: DataFrame, key: str, value: object, order: str) -> DataFrame:
    """The newest mutation of one key. The filter runs in the scan, ahead of the aggregate."""
    return newest(log.where(F.col(key) == F.lit(value)), [key], order)


def status(probes: DataFrame, log: DataFrame, key: str, order: str, tombstone: str = "tomb") -> DataFrame:
    """probes with `status`: live, deleted or absent, by their column `key`."""
    last = newest(log, [key], order).select(F.col(key).alias("_k"), F.col(tombstone).alias("_dead"))
    found = probes.join(last, F.col(key) == F.col("_k"), "left")
    return found.withColumn("status", F.when(F.col("_k").isNull(), "absent").when(F.col("_dead"), "deleted").otherwise("live")).drop("_k", "_dead")


def multi_get(log: DataFrame, probes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest mutations of a list of keys; the log is cut to them before it is aggregated."""
    return newest(log.join(small_side(probes.select(key).distinct()), key, "left_semi"), [key], order)


def range_scan(log: DataFrame, key: str, low: object, high: object, order: str, tombstone: str = "tomb") -> DataFrame:
    """Live rows with low <= key <= high; the bounds reach the scan."""
    return live(log.where(F.col(key).between(F.lit(low), F.lit(high))), [key], order, tombstone)


def ordered_scan(log: DataFrame, key: str, order: str, tombstone: str = "tomb", parts: int = 64) -> DataFrame:
    """Live rows in key order with `place`, from 1. Keys are numbers.

    Approximate quantiles of the keys bound `parts` ranges; rows are numbered inside each, and
    the counts of the ranges before, one number each, are added."""
    rows = live(log, [key], order, tombstone)
    cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts))]).cast("array<long>")
    ranged = rows.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col(key))))
    before, at = [], 0
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():  # a row per range
        before.append((r["_range"], at))
        at += r["count"]
    base = log.sparkSession.createDataFrame(before, "_range int, _base long")
    place = F.row_number().over(W.partitionBy("_range").orderBy(key)) + F.col("_base")
    return ranged.join(F.broadcast(base), "_range").withColumn("place", place.cast("long")).drop("_range", "_base").orderBy(key)


#: Values of the order column that make a block of a key's history.
BLOCK = 1 << 20


def _dead_before(log: DataFrame, key: str, order: str, tombstone: str, block: int) -> DataFrame:
    """log with `_gone`: whether the mutation before a row, of the same key, was a tombstone, or none.

    A key's history is cut to blocks of the order column, a number, so that no task holds all of a hot
    key; the first row of a block looks at the last one of the block before, of which there is
    a row per key and block."""
    cut = log.withColumn("_block", F.floor(F.col(order) / block))
    ends = cut.groupBy(key, "_block").agg(F.max_by(tombstone, order).alias("_end"))
    ends = ends.select(key, "_block", F.lag("_end").over(W.partitionBy(key).orderBy("_block")).alias("_last"))
    inside = F.lag(tombstone).over(W.partitionBy(key, "_block").orderBy(order))
    marked = cut.withColumn("_own", inside).join(ends, [key, "_block"])
    return marked.withColumn("_gone", F.coalesce("_own", "_last", F.lit(True))).drop("_own", "_last", "_block")


def delete_outcomes(log: DataFrame, key: str, order: str, tombstone: str = "tomb", block: int = BLOCK) -> DataFrame:
    """Deletes with `outcome`: what a store that refuses deletes of absent keys says.

    A key is there if the mutation before was a set; a refused delete changes nothing."""
    marked = _dead_before(log, key, order, tombstone, block).withColumn("outcome", F.when(F.col("_gone"), "not_found").otherwise("ok"))
    return marked.where(F.col(tombstone)).drop("_gone")


def accepted(log: DataFrame, key: str, order: str, tombstone: str = "tomb", block: int = BLOCK) -> DataFrame:
    """The log without the deletes that delete_outcomes() refuses."""
    return _dead_before(log, key, order, tombstone, block).where(~F.col(tombstone) | ~F.col("_gone")).drop("_gone")


def apply_deletes(current: DataFrame, deletes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(deletes of keys that are live, those that are refused) of a batch of deletes."""
    return deletes.join(current.select(key), key, "left_semi"), deletes.join(current.select(key), key, "left_anti")


def running_offsets(log: DataFrame, size: Column, order: str, block: int = 100_000) -> DataFrame:
    """log with `offset`: the bytes of all records before it.

    Sums run inside blocks of the order column, in parallel; only a sum per block is
    accumulated over all, which is `block` times fewer rows."""
    sized = log.withColumn("_size", size).withColumn("_block", F.floor(F.col(order) / block))
    blocks = sized.groupBy("_block").agg(F.sum("_size").alias("_bytes"))
    before = F.coalesce(F.sum("_bytes").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = blocks.select(F.col("_block"), before.alias("_base"))
    inside = F.coalesce(F.sum("_size").over(W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("_inside", inside).join(base, "_block").withColumn("offset", (F.col("_base") + F.col("_inside")).cast("long")).drop("_size", "_block", "_inside", "_base")
