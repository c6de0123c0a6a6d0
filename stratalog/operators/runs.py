"""Sorted runs: flush, read path, merge and compaction as queries over (gen, key) rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators.state import newest


def flush(log: DataFrame, key: str = "k", gen: str = "gen", order: str = "seq") -> DataFrame:
    """One row per generation and key: what each run holds, tombstones included."""
    return newest(log, [gen, key], order)


def run_stats(runs: DataFrame, gen: str = "gen", tombstone: str = "tomb") -> DataFrame:
    return runs.groupBy(gen).agg(F.count("*").alias("entries"), F.count_if(F.col(tombstone)).alias("tombstones"))


def read_path(runs: DataFrame, key: str = "k", gen: str = "gen") -> DataFrame:
    """The newest run's row of each key: the first run with an opinion answers, a tombstone too."""
    return newest(runs, [key], gen)


def merge(runs: DataFrame, drop_tombstones: bool, key: str = "k", gen: str = "gen", tombstone: str = "tomb") -> DataFrame:
    """Newest row per key. Tombstones may only go if the oldest run is part of the merge: else
    an older value below would be seen again."""
    merged = newest(runs, [key], gen)
    return merged.where(~F.col(tombstone)) if drop_tombstones else merged


def resurrected(runs: DataFrame, from_gen: int, key: str = "k", gen: str = "gen", tombstone: str = "tomb") -> DataFrame:
    """Keys that a merge of the runs from `from_gen` on would bring back if it dropped tombstones."""
    right = merge(runs, True, key, gen, tombstone).select(key)
    upper = merge(runs.where(F.col(gen) >= from_gen), True, key, gen, tombstone)
    wrong = merge(runs.where(F.col(gen) < from_gen).unionByName(upper), True, key, gen, tombstone)
    return wrong.join(right, key, "left_anti")


def compaction_stats(runs: DataFrame, key: str = "k", gen: str = "gen", tombstone: str = "tomb") -> DataFrame:
    """Per run: its entries, how many survive a full compaction, and tombstones dropped."""
    best = runs.groupBy(key).agg(F.max(gen).alias("_top"))
    seen = runs.join(best, key).withColumn("_wins", F.col(gen) == F.col("_top"))
    return seen.groupBy(gen).agg(F.count("*").alias("entries_in"), F.count_if(F.col("_wins") & ~F.col(tombstone)).alias("entries_out"), F.count_if(F.col("_wins") & F.col(tombstone)).alias("tombstones_dropped"))


def tables_probed(runs: DataFrame, key: str = "k", gen: str = "gen") -> DataFrame:
    """Runs that a lookup of each key opens, newest first, until one has it."""
    last = runs.agg(F.max(gen).alias("_last"))
    return runs.groupBy(key).agg(F.max(gen).alias("_top")).crossJoin(F.broadcast(last)).select(key, (F.col("_last") - F.col("_top") + 1).cast("long").alias("probed"))


def runs_after(flushes: int, threshold: int) -> int:
    """Runs left after so many flushes, with a full compaction whenever there are `threshold`."""
    runs = 0
    for _ in range(flushes):
        runs += 1
        if runs >= threshold and runs > 1:
            runs = 1
    return runs


def flush_by_bytes(log: DataFrame, threshold: int, store: str, key: str = "key", value: str = "value", tombstone: str = "tombstone", order: str = "seq") -> DataFrame:
    """log with `gen` as a memory table of `threshold` bytes would flush it.

    Where a flush falls depends on all records since the last one, so each store is walked in
    order; rows of one store stream through, and only keys of the open generation are held."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, size, gen = None, {}, 0, 0
        for frame in frames:
            gens = []
            for s, k, v, dead in zip(frame[store], frame[key], frame[value], frame[tombstone]):
                if s != now:
                    now, held, size, gen = s, {}, 0, 0
                new = 0 if dead or v is None else len(v)
                size += new - held[k] if k in held else len(k) + new
                held[k] = new
                gens.append(gen)
                if size >= threshold:
                    held, size, gen = {}, 0, gen + 1
            yield frame.assign(gen=pd.Series(gens, index=frame.index, dtype="int64"))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema)
    return log.repartition(store).sortWithinPartitions(store, order).mapInPandas(walk, f"{columns}, gen long")


def memtable_bytes(key: Column, value: Column, tombstone: Column) -> Column:
    """What an entry adds to the size of a memory table: key and current value."""
    return (F.octet_length(key) + F.when(tombstone, F.lit(0)).otherwise(F.coalesce(F.octet_length(value), F.lit(0)))).cast("long")
