"""Bloom filters as columns: FNV-1a hashes, bit positions, membership by join.

A filter of n keys has m = 10 n bits, rounded up to whole bytes, and 7 hashes; position i is
((h1 + i * h2) mod 2**32) mod m with h1 and h2 the low and high half of the 64-bit FNV-1a hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators.joins import small_side

# Halves of the FNV-1a 64 start, low part of its prime 2**40 + 435, and bits per key.
FNV_LOW, FNV_HIGH, FNV_PRIME_LOW = 2216829733, 3421674724, 435
BITS_PER_KEY = 10
#: The number of hashes with fewest false positives for so many bits: 7.
HASHES = round(BITS_PER_KEY * math.log(2))
_MASK = (1 << 32) - 1


def fnv1a(key: Column) -> Column:
    """struct<h1, h2>: low and high 32 bits of FNV-1a over the key's bytes.

    Each step is worked out on two halves, as a product of 64 bits would overflow."""
    text = F.hex(key)
    places = F.filter(F.sequence(F.lit(0), F.octet_length(key)), lambda i: i > 0)
    start = F.struct(F.lit(FNV_LOW).cast("long").alias("h1"), F.lit(FNV_HIGH).cast("long").alias("h2"))

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.substr(text, (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("long")
        x = acc["h1"].bitwiseXOR(byte)
        low = x * FNV_PRIME_LOW
        high = acc["h2"] * FNV_PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(x, 8)
        return F.struct(low.bitwiseAND(F.lit(_MASK)).alias("h1"), high.bitwiseAND(F.lit(_MASK)).alias("h2"))

    return F.aggregate(places, start, step)


def filter_bits(keys: Column) -> Column:
    """Bits of a filter of so many keys; one key's worth at least."""
    return (F.ceil(F.greatest(keys, F.lit(1)) * BITS_PER_KEY / 8) * 8).cast("long")


def positions(h1: Column, h2: Column, bits: Column) -> Column:
    """The HASHES bit positions of a key with these hashes, as an array; they may repeat."""
    return F.array(*[((h1 + h2 * i).bitwiseAND(F.lit(_MASK)) % bits).cast("long") for i in range(HASHES)])


def _hashed(df: DataFrame) -> DataFrame:
    """df with h1 and h2 of its column _key, worked out once per row ahead of all that uses them."""
    return df.withColumn("_h", fnv1a(F.col("_key"))).select("*", F.col("_h.h1").alias("_h1"), F.col("_h.h2").alias("_h2")).drop("_h")


def build(keys: DataFrame, key: str, run: str | None = None) -> DataFrame:
    """The set bits: distinct (run, bits, pos). Without a run column there is one filter, run 0."""
    own = keys.select((F.col(run) if run else F.lit(0)).alias("run"), F.col(key).cast("binary").alias("_key"))
    sizes = own.groupBy("run").agg(filter_bits(F.count("*")).alias("bits"))
    return _hashed(own).join(small_side(sizes), "run").select("run", "bits", F.explode(positions(F.col("_h1"), F.col("_h2"), F.col("bits"))).alias("pos")).distinct()


def may_contain(probes: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """(key, run) for each filter that says maybe: all distinct positions of the key are set.

    Filters of equal size have a key at equal positions, so positions are worked out by key and
    size, and meet the set bits of all filters of the size in one equi-join: every filter is
    asked, however many there are; an absent key costs what positions happen to be set."""
    sizes = bits.select("bits").distinct()
    own = _hashed(probes.select(F.col(key).cast("binary").alias("_key")).distinct())
    asked = own.join(small_side(sizes), how="cross").select("_key", "bits", F.array_distinct(positions(F.col("_h1"), F.col("_h2"), F.col("bits"))).alias("_at"))
    need = asked.select("_key", "bits", F.size("_at").alias("_need"), F.explode("_at").alias("pos"))
    hits = need.join(bits.select("run", "bits", "pos"), ["bits", "pos"]).groupBy("_key", "run", "_need").agg(F.count("*").alias("_n"))
    return hits.where("_n = _need").select(F.col("_key").alias(key), "run")


def packed(bits: DataFrame) -> DataFrame:
    """(run, bits, hashes, byte, value): the filter's bytes, bit p in byte p / 8 at p mod 8, where not 0."""
    value = F.bit_or(F.expr("shiftleft(1, cast(pos % 8 as int))")).cast("int")
    return bits.groupBy("run", "bits", F.floor(F.col("pos") / 8).alias("byte")).agg(value.alias("value")).withColumn("hashes", F.lit(HASHES))
