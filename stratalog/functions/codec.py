"""Records as bytes, in column expressions.

A log record is crc32, timestamp, key length, value length, key, value; a table record is the
same without timestamp. Numbers are big-endian, the checksum covers all that follows it, and a
value length of 0xFFFFFFFF marks a tombstone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.model import LOG_HEAD, MAX_KEY, MAX_VALUE, TABLE_HEAD, TOMBSTONE_LENGTH


def big_endian(number: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * size, "0"))


def unsigned(data: Column, at: int, size: int) -> Column:
    """The number in `size` bytes from byte `at` (from 0) on."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("decimal(20,0)").cast("long")


def _body(key: Column, value: Column, tombstone: Column) -> list[Column]:
    plain = F.coalesce(value, F.lit("").cast("binary"))
    length = F.when(tombstone, F.lit(TOMBSTONE_LENGTH).cast("long")).otherwise(F.octet_length(plain).cast("long"))
    return [big_endian(F.octet_length(key), 4), big_endian(length, 4), key, F.when(tombstone, F.lit("").cast("binary")).otherwise(plain)]


def _summed(parts: list[Column]) -> Column:
    body = F.concat(*parts)
    return F.concat(big_endian(F.crc32(body), 4), body)


def encode_log(ts: Column, key: Column, value: Column, tombstone: Column) -> Column:
    """The bytes of a log record. Validate rows with model.verdict() first."""
    return _summed([big_endian(ts, 8), *_body(key, value, tombstone)])


def encode_table(key: Column, value: Column, tombstone: Column) -> Column:
    """The bytes of a record of a table or a write-ahead log."""
    return _summed(_body(key, value, tombstone))


def decode(data: Column, head: int = LOG_HEAD) -> Column:
    """struct<status, ts, key, value, tombstone> of one record's bytes.

    status: ok; short (fewer bytes than the record needs); corrupt (lengths beyond the limits,
    or the checksum differs). Lengths are judged before the checksum. The other fields are
    null unless ok; ts is null for table records (head TABLE_HEAD)."""
    at = 12 if head == LOG_HEAD else 4
    key_length, value_length = unsigned(data, at, 4), unsigned(data, at + 4, 4)
    dead = value_length == TOMBSTONE_LENGTH
    size = F.lit(head) + key_length + F.when(dead, F.lit(0)).otherwise(value_length)
    beyond = (key_length == 0) | (key_length > MAX_KEY) | (~dead & (value_length > MAX_VALUE))
    body = F.substr(data, F.lit(5), (size - 4).cast("int"))
    status = (
        F.when(F.octet_length(data) < head, "short")
        .when(beyond, "corrupt")
        .when(F.octet_length(data) < size, "short")
        .when(F.crc32(body) != unsigned(data, 0, 4), "corrupt")
        .otherwise("ok")
    )
    ok = status == "ok"
    ts = F.when(ok, unsigned(data, 4, 8)) if head == LOG_HEAD else F.lit(None).cast("long")
    key = F.when(ok, F.substr(data, F.lit(head + 1), key_length.cast("int")))
    value = F.when(ok & ~dead, F.substr(data, (F.lit(head + 1) + key_length).cast("int"), value_length.cast("int")))
    return F.struct(status.alias("status"), ts.alias("ts"), key.alias("key"), value.alias("value"), F.when(ok, dead).alias("tombstone"))


__all__ = ["LOG_HEAD", "TABLE_HEAD", "big_endian", "decode", "encode_log", "encode_table", "unsigned"]
