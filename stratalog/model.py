"""The one logical table: mutations (seq, key, value, tombstone), and what a valid one is.

Engines differ in how they materialise it and in what they accept:

- `map`: any key; deletes of absent keys do nothing;
- `log`: keys of 1 to MAX_KEY bytes, values up to MAX_VALUE; deleting an absent key is refused;
- `lsm`: the same limits; deletes always write a tombstone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the formats: limits of a key and a value in bytes, and sizes of the record heads.
MAX_KEY, MAX_VALUE = 65_536, 16 << 20
LOG_HEAD, TABLE_HEAD, TOMBSTONE_LENGTH = 20, 12, 0xFFFFFFFF

MUTATION = T.StructType([
    T.StructField("seq", T.LongType(), False), T.StructField("ts", T.LongType(), True), T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType(), True), T.StructField("tombstone", T.BooleanType(), False),
])


def from_events(spark: SparkSession, sf_dir: str, gen_size: int = 1000) -> DataFrame:
    """events as a mutation log: a user is a key, an error deletes it. Columns seq, k, v, tomb, gen."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tomb = F.col("event_type") == "error"
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.when(~tomb, F.col("value")).alias("v"), tomb.alias("tomb"), F.floor(F.col("event_id") / gen_size).cast("int").alias("gen"))


def bytes_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with byte keys `user:%08d` and props as values, the shape of MUTATION."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tomb = F.col("event_type") == "error"
    key = F.concat(F.lit("user:"), padded(F.col("user_id"), 8)).cast("binary")
    return e.select(F.col("event_id").alias("seq"), (F.col("event_id") * 1000).alias("ts"), key.alias("key"), F.when(~tomb, F.col("props").cast("binary")).alias("value"), tomb.alias("tombstone"))


def padded(number: Column, width: int) -> Column:
    """The number with zeros in front; unlike lpad alone, longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def verdict(key: Column, value: Column, tombstone: Column | None = None, max_key: int = MAX_KEY, max_value: int = MAX_VALUE) -> Column:
    """ok, empty_key, key_too_large or value_too_large. A tombstone's value is not looked at."""
    dead = F.lit(False) if tombstone is None else tombstone
    return (
        F.when(F.coalesce(F.octet_length(key), F.lit(0)) == 0, "empty_key")
        .when(F.octet_length(key) > max_key, "key_too_large")
        .when(~dead & (F.coalesce(F.octet_length(value), F.lit(0)) > max_value), "value_too_large")
        .otherwise("ok")
    )


def record_size(key: Column, value: Column, tombstone: Column, head: int = LOG_HEAD) -> Column:
    """Bytes of a record: head, key and, unless it is a tombstone, value."""
    body = F.when(tombstone, F.lit(0)).otherwise(F.coalesce(F.octet_length(value), F.lit(0)))
    return (F.lit(head) + F.octet_length(key) + body).cast("long")


def table_file_size(records: DataFrame, key: str = "key", value: str = "value", tombstone: str = "tombstone") -> DataFrame:
    """One row: the bytes of a table file with these entries (records, dense index, Bloom filter, footer)."""
    n = F.count("*")
    bits = F.ceil(F.greatest(n, F.lit(1)) * 10 / 8) * 8
    body = F.sum(record_size(F.col(key), F.col(value), F.col(tombstone), TABLE_HEAD))
    index = F.sum(F.lit(12) + F.octet_length(key))
    return records.agg(n.alias("entries"), (F.coalesce(body + index, F.lit(0)) + 5 + bits / 8 + 36).cast("long").alias("file_bytes"))
