"""The registered queries over keyed state, and the same questions as DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog import model
from stratalog.functions import bloom, codec
from stratalog.operators import metrics, ordered, runs, state
from stratalog.plans.store import RunStore
from stratalog.sources import files
from stratalog.streaming import upsert


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return model.from_events(spark, d)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.flush(_log(spark, d))


def _folder(spark: SparkSession) -> str:
    """A fresh folder of the shared storage; a private one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/stratalog"
    return f"{base}/{uuid.uuid4().hex}"


# --- state ---


def live_snapshot(spark, d):
    return state.live(_log(spark, d), ["k"], "seq").select("k", "v")


def live_snapshot_narrow(spark, d):
    return state.newest_narrow(_log(spark, d), ["k"], "seq").where("not tomb").select("k", "v")


def keydir_rebuild(spark, d):
    return state.live(_log(spark, d), ["k"], "seq").select("k", "seq")


def point_get(spark, d):
    return state.get(_log(spark, d), "k", 42, "seq").select("k", "seq", "v", "tomb")


def multi_get_status(spark, d):
    probes = _read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return state.status(probes, _log(spark, d), "k", "seq")


def multi_get_rows(spark, d):
    probes = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return state.multi_get(_log(spark, d), probes, "k", "seq").select("k", "seq", "v", "tomb")


def range_scan(spark, d):
    return state.range_scan(_log(spark, d), "k", 40, 60, "seq").select("k", "v")


def ordered_scan(spark, d):
    return state.ordered_scan(_log(spark, d), "k", "seq").select("k", "v", "place")


def delete_outcome_log(spark, d):
    return state.delete_outcomes(_log(spark, d), "k", "seq").select("seq", "k", "outcome")


def delete_outcome_lsm(spark, d):
    out = state.delete_outcomes(_log(spark, d), "k", "seq")
    return out.select("seq", "k", F.lit("accepted").alias("outcome"), (F.col("outcome") == "ok").alias("shadowed_live"))


def delete_batch(spark, d):
    current = state.live(_log(spark, d), ["k"], "seq").select("k")
    asked = _read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    taken, refused = state.apply_deletes(current, asked, "k")
    return taken.withColumn("outcome", F.lit("ok")).unionByName(refused.withColumn("outcome", F.lit("not_found")))


def validation(spark, d):
    docs = _read(spark, d, "documents")
    verdict = model.verdict(F.encode(F.col("source"), "utf-8"), F.encode(F.col("text"), "utf-8"), max_value=16_384)
    return docs.select("doc_id", verdict.alias("verdict"))


def counts(spark, d):
    log = _log(spark, d)
    last = state.newest(log, ["k"], "seq")
    keys = last.agg(F.count_if(~F.col("tomb")).alias("live"), F.count("*").alias("with_tombstones"))
    tables = log.agg(F.count_distinct("gen").alias("tables"), F.count("*").alias("mutations"))
    records = model.bytes_of_events(spark, d)
    size = runs.memtable_bytes(F.col("key"), F.col("value"), F.col("tombstone"))
    memory = state.newest(records, ["key"], "seq").agg(F.coalesce(F.sum(size), F.lit(0)).alias("memory_bytes"))
    kept = metrics.sized(state.accepted(records, "key", "seq", "tombstone")).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("log_bytes"))
    return keys.crossJoin(F.broadcast(tables)).crossJoin(F.broadcast(memory)).crossJoin(F.broadcast(kept))  # a row each


# --- runs ---


def flush_stats(spark, d):
    return runs.run_stats(_runs(spark, d))


def sstable_scan(spark, d):
    return _runs(spark, d).select("gen", "k", "seq", "v", "tomb")


def read_path_source(spark, d):
    return runs.read_path(_runs(spark, d)).select("k", "gen", "tomb")


def partial_merge_keep_tombstones(spark, d):
    return runs.merge(_runs(spark, d).where("gen >= 5"), False).select("k", "gen", "v", "tomb")


def full_compaction(spark, d):
    return runs.merge(_runs(spark, d), True).select("k", "v")


def unsafe_partial_drop_diff(spark, d):
    return runs.resurrected(_runs(spark, d), 5).select("k", "gen", "v")


def compaction_stats(spark, d):
    return runs.compaction_stats(_runs(spark, d))


def maybe_compact(spark, d):
    n = _log(spark, d).agg(F.count_distinct("gen")).first()[0]
    return spark.createDataFrame([(t, n, runs.runs_after(n, t)) for t in (3, 5, 20)], "threshold long, flushes long, runs long")


def tables_probed(spark, d):
    return runs.tables_probed(_runs(spark, d))


def memtable_absorption(spark, d):
    log = model.bytes_of_events(spark, d).withColumn("gen", F.floor(F.col("seq") / 1000).cast("int"))
    return metrics.absorption(log).select("gen", "writes", "written_bytes", "entries", "run_bytes")


def flush_by_bytes(spark, d):
    log = model.bytes_of_events(spark, d).withColumn("store", F.substring("key", 13, 1))
    out = runs.flush_by_bytes(log, 200, "store")
    return out.groupBy(F.hex("store").alias("store"), "gen").agg(F.count("*").alias("mutations"), F.min("seq").alias("first_seq"))


# --- ordered sets ---


def ordered_distinct_keys(spark, d):
    return ordered.distinct_keys(_read(spark, d, "lineitem"), "l_partkey")


def insert_outcome(spark, d):
    li = _read(spark, d, "lineitem")
    return ordered.insert_outcomes(li, "l_partkey", *[F.col(c) for c in sorted(li.columns)]).select("l_partkey", "l_orderkey", "l_linenumber", "inserted")


def sorted_keys(spark, d):
    return ordered.sorted_keys(_read(spark, d, "lineitem"), "l_suppkey")


def search_hits(spark, d):
    probes = spark.range(0, 5000, 7).select(F.col("id").alias("l_partkey"))
    return ordered.search(probes, _read(spark, d, "lineitem"), "l_partkey")


def ordered_range(spark, d):
    return ordered.range_keys(_read(spark, d, "lineitem"), "l_partkey", 100, 160)


def btree_shape(spark, d):
    shapes = [(n, t, ordered.tree_shape(range(n), t)) for n, t in ((1000, 2), (10_000, 2), (100_000, 2))]
    return spark.createDataFrame([(n, t, s["height"], s["nodes"], round(100 * s["fill"], 1)) for n, t, s in shapes], "n long, t long, height long, nodes long, fill_percent double").withColumn("log2_n", F.round(F.log2("n"), 1))


def run_invariants(spark, d):
    return ordered.check_runs(_runs(spark, d), "gen", "k").select("gen", "entries", "keys", "low", "high", "unique", "overlaps")


# --- space ---


def record_offsets(spark, d):
    log = state.accepted(model.bytes_of_events(spark, d), "key", "seq", "tombstone")
    size = model.record_size(F.col("key"), F.col("value"), F.col("tombstone"))
    return state.running_offsets(log, size, "seq").select("seq", "offset")


def space_amplification(spark, d):
    return metrics.space(model.bytes_of_events(spark, d))


def space_amp_by_overwrite(spark, d):
    keys = spark.range(1000).select(F.concat(F.lit("key:"), model.padded(F.col("id"), 8)).cast("binary").alias("key"), F.lit("x" * 100).cast("binary").alias("value"), F.lit(False).alias("tombstone"))
    return metrics.overwritten(keys, [1, 2, 5, 10, 50])


def delete_space_cost(spark, d):
    key = F.concat(F.lit("key:"), model.padded(F.col("id") % 1000, 8)).cast("binary")
    rows = spark.range(1500).select(F.col("id").alias("seq"), key.alias("key"), F.when(F.col("id") < 1000, F.lit("x" * 100).cast("binary")).alias("value"), (F.col("id") >= 1000).alias("tombstone"))
    sized = metrics.sized(rows)
    written = sized.where("seq < 1000").agg(F.sum("bytes").alias("bytes")).select(F.lit("write").alias("step"), "bytes")
    deleted = sized.agg(F.sum("bytes").alias("bytes")).select(F.lit("delete").alias("step"), "bytes")
    merged = state.live(sized, ["key"], "seq", "tombstone").agg(F.sum("bytes").alias("bytes")).select(F.lit("merge").alias("step"), "bytes")
    return written.unionByName(deleted).unionByName(merged)


def table_file_bytes(spark, d):
    keys = spark.range(500).select(F.concat(F.lit("k"), model.padded(F.col("id"), 6)).cast("binary").alias("key"), F.lit("x" * 100).cast("binary").alias("value"), F.lit(False).alias("tombstone"))
    return model.table_file_size(keys)


# --- Bloom filters ---


def _members(spark, n, prefix):
    return spark.range(n).select(F.concat(F.lit(prefix), model.padded(F.col("id"), 6)).alias("key"))


def fnv1a(spark, d):
    h = bloom.fnv1a(F.col("key").cast("binary"))
    return _members(spark, 2000, "key").select("key", h["h1"].alias("h1"), h["h2"].alias("h2"))


def bloom_positions(spark, d):
    return bloom.build(_members(spark, 10_000, "key"), "key").select("bits", "pos")


def _maybe(spark, n, prefix):
    probes = _members(spark, n, prefix).select(F.col("key").cast("binary").alias("key"))
    return bloom.may_contain(probes, "key", bloom.build(_members(spark, 10_000, "key"), "key"))


def bloom_false_positives(spark, d):
    return _maybe(spark, 100_000, "absent").agg(F.count("*").alias("maybe"))


def bloom_no_false_negatives(spark, d):
    return _maybe(spark, 10_000, "key").agg((F.lit(10_000) - F.count("*")).cast("long").alias("missed"))


def bloom_skip_tables(spark, d):
    entries = _runs(spark, d).select("gen", F.concat(F.lit("user:"), model.padded(F.col("k"), 8)).alias("key"))
    bits = bloom.build(entries, "key", "gen")
    probes = spark.range(1000).select(F.concat(F.lit("missing-"), F.col("id")).cast("binary").alias("key"))
    return bloom.may_contain(probes, "key", bits).groupBy(F.col("key").cast("string").alias("key")).agg(F.count("*").alias("maybe_runs"))


# --- formats ---


def _documents_kv(spark, d):
    return _read(spark, d, "documents").select(F.col("doc_id").alias("seq"), (F.col("doc_id") + 1_755_000_000_000_000_000).alias("ts"), codec.big_endian(F.col("doc_id"), 8).alias("key"), F.encode("text", "utf-8").alias("value"), F.lit(False).alias("tombstone"))


def encode_records(spark, d):
    rec = codec.encode_log(F.col("ts"), F.col("key"), F.col("value"), F.col("tombstone"))
    return _documents_kv(spark, d).select("seq", F.md5(F.substr(rec, F.lit(5), F.octet_length(rec))).alias("body_md5"), F.octet_length(rec).cast("long").alias("bytes"))


def decode_records(spark, d):
    log = model.bytes_of_events(spark, d)
    back = codec.decode(codec.encode_log(F.col("ts"), F.col("key"), F.col("value"), F.col("tombstone")))
    r = log.select("seq", back.alias("r"))
    return r.select("seq", F.col("r.status").alias("status"), F.col("r.ts").alias("ts"), F.col("r.key").cast("string").alias("key"), F.col("r.value").cast("string").alias("value"), F.col("r.tombstone").alias("tombstone"))


def bit_flip_detection(spark, d):
    """A record of a 5-byte key with one byte changed in each of its regions."""
    rec = codec.encode_log(F.lit(1_755_000_000_000_000_000), F.lit("hello").cast("binary"), F.lit("world").cast("binary"), F.lit(False))
    spots = spark.createDataFrame([("timestamp", 8), ("key_length", 12), ("value_length", 17), ("key", 21), ("value", 27)], "region string, at int")
    changed = F.concat(F.substring("rec", 1, 4), F.substr(F.col("rec"), F.lit(5), F.col("at") - 4), codec.big_endian(codec.unsigned(F.substr(F.col("rec"), F.col("at") + 1, F.lit(1)), 0, 1).bitwiseXOR(F.lit(16).cast("long")), 1), F.substr(F.col("rec"), F.col("at") + 2, F.octet_length("rec")))
    return spots.withColumn("rec", rec).select("region", codec.decode(changed)["status"].alias("status"))


def torn_tail_recovery(spark, d):
    """The log in three files, as they are, each cut by 7 bytes, and each followed by 11 bytes of
    junk: what the reader finds, and why it ends."""
    folder = _folder(spark)
    files.write_log(model.bytes_of_events(spark, d), f"{folder}/whole", 3)
    whole = spark.read.format("binaryFile").load(f"{folder}/whole").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    files.place(whole.withColumn("content", F.substr("content", F.lit(1), F.octet_length("content") - 7)), f"{folder}/cut")
    files.place(whole.withColumn("content", F.concat("content", F.unhex(F.lit("00" * 11)))), f"{folder}/junk")
    found = None
    for kind in ("whole", "cut", "junk"):
        report = files.recovery_report(spark, f"{folder}/{kind}").select(F.lit(kind).alias("file"), "records", "lost_bytes", "ends")
        found = report if found is None else found.unionByName(report)
    read = found.groupBy("file", "ends").agg(F.sum("records").alias("records"), F.count("*").alias("files"), F.sum(F.when(F.col("file") == "junk", F.col("lost_bytes")).otherwise(0)).alias("junk_bytes"))
    return read.select("file", "records", "ends", "files", "junk_bytes")


def log_files(spark, d):
    """The log written to files and read back; the last mutation of each key."""
    folder = _folder(spark)
    files.write_log(model.bytes_of_events(spark, d), folder, 3)
    back = files.read_log(spark, folder).withColumn("key", F.col("key").cast("string"))
    return state.live(back.withColumn("at", F.struct("file", "offset")), ["key"], "at", "tombstone").select("key", F.col("value").cast("string").alias("value"), "ts")


def sst_import(spark, d):
    """Runs written as table files and read back."""
    entries = runs.flush(model.bytes_of_events(spark, d).withColumn("gen", F.floor(F.col("seq") / 1000).cast("int")), "key")
    folder = _folder(spark)
    files.write_tables(entries, folder)
    back = files.read_tables(spark, folder)
    return back.select((F.col("gen") - 1).cast("int").alias("gen"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "tombstone")


def wal_replay(spark, d):
    folder = _folder(spark)
    files.write_wal(model.bytes_of_events(spark, d), folder)
    back = files.read_wal(spark, folder).withColumn("at", F.struct("file", "offset"))
    return state.live(back, ["key"], "at", "tombstone").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def log_merge(spark, d):
    """The log written in two batches and merged: its live records with their own timestamps."""
    folder, log = _folder(spark), model.bytes_of_events(spark, d)
    half = log.agg(F.max("seq")).first()[0] or 0
    files.write_log(log.where(F.col("seq") * 2 <= half), f"{folder}/log", 2)
    files.append_log(spark, log.where(F.col("seq") * 2 > half), f"{folder}/log", 2)
    files.merge_log(spark, f"{folder}/log", f"{folder}/merged", 2)
    back = files.read_log(spark, f"{folder}/merged")
    return back.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "ts", "tombstone")


def wal_append(spark, d):
    """Three batches added to a write-ahead log one after the other, read back, then the log is
    reset; its bytes before and after."""
    folder, log = _folder(spark), model.bytes_of_events(spark, d)
    top = (log.agg(F.max("seq")).first()[0] or 0) + 1
    for i in range(3):
        files.append_wal(spark, log.where((F.col("seq") * 3 >= i * top) & (F.col("seq") * 3 < (i + 1) * top)), folder)
    size = files.wal_size(spark, folder)
    back = files.read_wal(spark, folder).withColumn("at", F.struct("file", "offset"))
    kept = f"{folder}/kept"
    state.live(back, ["key"], "at", "tombstone").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).write.parquet(kept)
    files.reset_wal(spark, folder)
    sizes = F.lit(size).cast("long").alias("wal_bytes"), F.lit(files.wal_size(spark, folder)).cast("long").alias("after_reset")
    return spark.read.schema("key string, value string").parquet(kept).select("key", "value", *sizes)


def sst_get(spark, d):
    """Keys of the first 200 users, and as many that don't exist, looked up in table files."""
    entries = runs.flush(model.bytes_of_events(spark, d).withColumn("gen", F.floor(F.col("seq") / 1000).cast("int")), "key")
    folder = _folder(spark)
    files.write_tables(entries, folder)
    asked = [f"user:{i:08d}".encode() for i in range(200)] + [f"missing-{i}".encode() for i in range(200)]
    found = files.get_from_tables(spark, folder, asked)
    return found.select(F.col("key").cast("string").alias("key"), (F.col("gen") - 1).cast("int").alias("gen"), F.col("value").cast("string").alias("value"), "tombstone")


def lsm_open(spark, d):
    """Table files of all but the last mutations, these in the write-ahead log, opened as one store."""
    log = model.bytes_of_events(spark, d).withColumn("gen", F.floor(F.col("seq") / 1000).cast("int"))
    last = log.agg(F.max("seq")).first()[0] or 0
    folder = _folder(spark)
    files.write_tables(runs.flush(log.where(F.col("seq") <= last - 300), "key"), folder)
    files.write_wal(log.where(F.col("seq") > last - 300), folder)
    opened = files.open_store(spark, folder).withColumn("order", F.struct("gen", "at"))
    return state.live(opened, ["key"], "order", "tombstone").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


# --- durable runs and streams ---


def _interleaved(store: RunStore, log: DataFrame, flushes: int, compact_at: int | None = None) -> None:
    """Flush every so-many-th mutation together, so that each run has rows older than those before it."""
    for i in range(flushes):
        store.flush(log.where(F.pmod("seq", F.lit(flushes)) == flushes - 1 - i), i)
        if compact_at is not None:
            store.maybe_compact(compact_at)


def _strings(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), *more)


def run_store(spark, d):
    """Three flushes to a store of Parquet runs, one compaction, then its live rows."""
    store = RunStore(spark, _folder(spark))
    _interleaved(store, model.bytes_of_events(spark, d), 3)
    store.compact()
    return _strings(store.live())


def store_compaction(spark, d):
    """The one run that a compaction leaves when all is settled: no tombstones, the newest seq of each key."""
    store, log = RunStore(spark, _folder(spark)), model.bytes_of_events(spark, d)
    _interleaved(store, log, 5)
    store.compact(settled=log.agg(F.max("seq")).first()[0])
    return _strings(store.runs(), "seq", "tombstone").withColumn("tables", F.lit(store.tables()).cast("long"))


def store_maybe_compact(spark, d):
    """Six flushes, with a compaction whenever there are three runs; late rows come after compactions."""
    store = RunStore(spark, _folder(spark))
    _interleaved(store, model.bytes_of_events(spark, d), 6, 3)
    return _strings(store.live(), "seq").withColumn("tables", F.lit(store.tables()).cast("long"))


def _event_stream(spark, d):
    spark_schema = _read(spark, d, "events").schema
    folder, _, name = f"{d}/events.parquet".rpartition("/")
    e = spark.readStream.schema(spark_schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")
    tomb = F.col("event_type") == "error"
    key = F.concat(F.lit("user:"), model.padded(F.col("user_id"), 8)).cast("binary")
    return e.select(F.col("event_id").alias("seq"), (F.col("event_id") * 1000).alias("ts"), key.alias("key"), F.when(~tomb, F.col("props").cast("binary")).alias("value"), tomb.alias("tombstone"))


def stream_upsert(spark, d):
    folder = _folder(spark)
    upsert.newest_to_table(_event_stream(spark, d), "key", "seq", f"{folder}/checkpoint", f"{folder}/rows").awaitTermination()
    rows = spark.read.schema(model.MUTATION).parquet(f"{folder}/rows")
    return state.live(rows, ["key"], "seq", "tombstone").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def stream_runs(spark, d):
    folder = _folder(spark)
    store = RunStore(spark, f"{folder}/store")
    upsert.to_runs(_event_stream(spark, d), store, f"{folder}/checkpoint", compact_at=3).awaitTermination()
    store.compact(force=True)
    return store.live().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


_ALL = [
    live_snapshot, live_snapshot_narrow, keydir_rebuild, point_get, multi_get_status, multi_get_rows, range_scan, ordered_scan, delete_outcome_log, delete_outcome_lsm, delete_batch, validation, counts,
    flush_stats, sstable_scan, read_path_source, partial_merge_keep_tombstones, full_compaction, unsafe_partial_drop_diff, compaction_stats, maybe_compact, tables_probed, memtable_absorption, flush_by_bytes,
    ordered_distinct_keys, insert_outcome, sorted_keys, search_hits, ordered_range, btree_shape, run_invariants,
    record_offsets, space_amplification, space_amp_by_overwrite, delete_space_cost, table_file_bytes,
    fnv1a, bloom_positions, bloom_false_positives, bloom_no_false_negatives, bloom_skip_tables,
    encode_records, decode_records, bit_flip_detection, torn_tail_recovery, log_files, log_merge, sst_import, sst_get, wal_replay, wal_append, lsm_open, run_store, store_compaction, store_maybe_compact, stream_upsert, stream_runs,
]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_LOG = "log as (select event_id as seq, user_id as k, case when event_type = 'error' then null else value end as v, event_type = 'error' as tomb, cast(floor(event_id / 1000.0) as int) as gen from events)"
_LAST = f"{_LOG}, last as (select * from log qualify row_number() over (partition by k order by seq desc) = 1)"
_SST = f"{_LOG}, sst as (select * from log qualify row_number() over (partition by gen, k order by seq desc) = 1)"
_KV = """kv as (select event_id as seq, event_id * 1000 as ts, 'user:' || lpad(user_id::varchar, 8, '0') as key, case when event_type = 'error' then null else props end as value, event_type = 'error' as tombstone,
  cast(floor(event_id / 1000.0) as int) as gen, 13 + case when event_type = 'error' then 0 else strlen(props) end as body from events)"""
_KV_LAST = f"{_KV}, last as (select * from kv qualify row_number() over (partition by key order by seq desc) = 1)"
_ACCEPTED = f"{_KV}, seen as (select *, lag(tombstone) over (partition by key order by seq) as gone from kv), acc as (select * from seen where not tombstone or not coalesce(gone, true))"
_SIZES = "memory_bytes, log_bytes"
_SIZE_TABLES = f"""(select coalesce(sum(body), 0)::bigint as memory_bytes from (with {_KV_LAST} select * from last)), (select coalesce(sum(20 + body), 0)::bigint as log_bytes from (with {_ACCEPTED} select * from acc))"""
_FNV = """list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(string_split({k}, ''), lambda x: ascii(x)::uhugeint)), lambda a, b: (xor(a, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"""
_POS = "((((h % 4294967296::uhugeint) + i::uhugeint * (h // 4294967296::uhugeint)) % 4294967296::uhugeint) % {m}::uhugeint)::bigint"


def _maybe_sql(n: int, prefix: str, out: str) -> str:
    key = "'{}' || lpad(range::varchar, 6, '0')"
    return f"""with m as (select {key.format("key")} as key from range(10000)), mh as (select {_FNV.format(k="key")} as h from m),
bits as (select distinct {_POS.format(m=100000)} as pos from mh, range(7) r(i)),
p as (select {key.format(prefix)} as key from range({n})), ph as (select key, {_FNV.format(k="key")} as h from p),
pp as (select distinct key, {_POS.format(m=100000)} as pos from ph, range(7) r(i)),
x as (select key, count(*) as need, count(bits.pos) as hit from pp left join bits using (pos) group by key)
select {out} from x where need = hit"""


def oracle_sql() -> dict[str, str]:
    kv_live = f"with {_KV_LAST} select key, value from last where not tombstone"
    snapshot = f"with {_LAST} select k, v from last where not tomb"
    return {
        "live_snapshot": snapshot,
        "live_snapshot_narrow": snapshot,
        "keydir_rebuild": f"with {_LAST} select k, seq from last where not tomb",
        "point_get": f"with {_LAST} select k, seq, v, tomb from last where k = 42",
        "multi_get_status": f"with {_LAST} select c_custkey as k, case when k is null then 'absent' when tomb then 'deleted' else 'live' end as status from customer left join last on k = c_custkey",
        "multi_get_rows": f"with {_LAST} select k, seq, v, tomb from last where k in (select s_suppkey from supplier)",
        "range_scan": f"with {_LAST} select k, v from last where not tomb and k between 40 and 60",
        "ordered_scan": f"with {_LAST} select k, v, row_number() over (order by k) as place from last where not tomb order by k",
        "delete_outcome_log": f"with {_LOG}, s as (select *, lag(tomb) over (partition by k order by seq) as gone from log) select seq, k, case when coalesce(gone, true) then 'not_found' else 'ok' end as outcome from s where tomb",
        "delete_outcome_lsm": f"with {_LOG}, s as (select *, lag(tomb) over (partition by k order by seq) as gone from log) select seq, k, 'accepted' as outcome, not coalesce(gone, true) as shadowed_live from s where tomb",
        "delete_batch": f"with {_LAST} select c_custkey as k, case when k is not null then 'ok' else 'not_found' end as outcome from customer left join (select k from last where not tomb) on k = c_custkey",
        "validation": "select doc_id, case when strlen(source) = 0 then 'empty_key' when strlen(source) > 65536 then 'key_too_large' when strlen(text) > 16384 then 'value_too_large' else 'ok' end as verdict from documents",
        "counts": f"with {_LAST} select (select count(*) from last where not tomb) as live, (select count(*) from last) as with_tombstones, (select count(distinct gen) from log) as tables, (select count(*) from log) as mutations, {_SIZES} from {_SIZE_TABLES}",
        "flush_stats": f"with {_SST} select gen, count(*) as entries, count(*) filter (tomb) as tombstones from sst group by gen",
        "sstable_scan": f"with {_SST} select gen, k, seq, v, tomb from sst",
        "read_path_source": f"with {_SST} select k, gen, tomb from sst qualify row_number() over (partition by k order by gen desc) = 1",
        "partial_merge_keep_tombstones": f"with {_SST} select k, gen, v, tomb from sst where gen >= 5 qualify row_number() over (partition by k order by gen desc) = 1",
        "full_compaction": snapshot,
        "unsafe_partial_drop_diff": f"""with {_SST}, up as (select * from sst where gen >= 5 qualify row_number() over (partition by k order by gen desc) = 1),
every as (select * from sst where gen < 5 union all select * from up where not tomb),
top as (select * from every qualify row_number() over (partition by k order by gen desc) = 1)
select k, gen, v from top where not tomb and k not in (select k from (select * from sst qualify row_number() over (partition by k order by gen desc) = 1) where not tomb)""",
        "compaction_stats": f"with {_SST}, w as (select *, gen = max(gen) over (partition by k) as wins from sst) select gen, count(*) as entries_in, count(*) filter (wins and not tomb) as entries_out, count(*) filter (wins and tomb) as tombstones_dropped from w group by gen",
        "maybe_compact": f"with {_LOG}, n as (select count(distinct gen) as n from log) select t::bigint as threshold, n as flushes, (case when n < t then n else 1 + (n - t) % (t - 1) end)::bigint as runs from n, (values (3), (5), (20)) v(t)",
        "tables_probed": f"with {_SST} select k, ((select max(gen) from sst) - max(gen) + 1)::bigint as probed from sst group by k",
        "memtable_absorption": f"""with {_KV}, r as (select * from kv qualify row_number() over (partition by gen, key order by seq desc) = 1)
select gen, w.writes, w.written_bytes, r2.entries, r2.run_bytes from (select gen, count(*) as writes, sum(12 + body)::bigint as written_bytes from kv group by gen) w join (select gen, count(*) as entries, sum(12 + body)::bigint as run_bytes from r group by gen) r2 using (gen)""",
        "flush_by_bytes": f"""with recursive {_KV},
o as (select seq, substr(key, 13, 1) as store, key, body::bigint as size, row_number() over (partition by substr(key, 13, 1) order by seq) as i from kv),
w as (
  select store, 0::bigint as i, null::bigint as seq, 0::bigint as gen, 0::bigint as next_gen, map([]::varchar[], []::bigint[]) as held from (select distinct store from o)
  union all
  select store, i, seq, gen, gen + case when list_sum(map_values(now)) >= 200 then 1 else 0 end, case when list_sum(map_values(now)) >= 200 then map([]::varchar[], []::bigint[]) else now end
  from (select o.store, o.i, o.seq, w.next_gen as gen, map_concat(w.held, map([o.key], [o.size])) as now from w join o on o.store = w.store and o.i = w.i + 1))
select hex(store) as store, gen, count(*) as mutations, min(seq) as first_seq from w where i > 0 group by all""",
        "ordered_distinct_keys": "select distinct l_partkey from lineitem",
        "insert_outcome": "select l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by l_commit) = 1 as inserted from (select *, row_number() over (order by l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax) as l_commit from lineitem)",
        "sorted_keys": "select distinct l_suppkey from lineitem order by 1",
        "search_hits": "select range as l_partkey from range(0, 5000, 7) where range in (select l_partkey from lineitem)",
        "ordered_range": "select distinct l_partkey from lineitem where l_partkey between 100 and 160 order by 1",
        "run_invariants": f"""with {_SST}, s as (select gen, count(*) as entries, count(distinct k) as keys, min(k) as low, max(k) as high from sst group by gen)
select *, entries = keys as unique, coalesce(max(high) over (order by low, gen rows between unbounded preceding and 1 preceding) >= low, false) as overlaps from s""",
        "record_offsets": f"with {_ACCEPTED} select seq, coalesce(sum(20 + body) over (order by seq rows between unbounded preceding and 1 preceding), 0)::bigint as offset from acc",
        "space_amplification": f"""with {_ACCEPTED}, l as (select * from acc qualify row_number() over (partition by key order by seq desc) = 1), a as (select sum(20 + body)::bigint as log_bytes from acc), m as (select coalesce(sum(20 + body), 0)::bigint as merged_bytes from l where not tombstone)
select log_bytes, merged_bytes, case when merged_bytes > 0 then log_bytes::double / merged_bytes end as amplification from a, m""",
        "space_amp_by_overwrite": "select n::bigint as overwrites, (132000 * n)::bigint as log_bytes, 132000::bigint as merged_bytes, n::double as amplification from (values (1), (2), (5), (10), (50)) t(n)",
        "delete_space_cost": "select * from (values ('write', 132000::bigint), ('delete', 148000::bigint), ('merge', 66000::bigint)) t(step, bytes)",
        "table_file_bytes": "select 500::bigint as entries, 69666::bigint as file_bytes",
        "fnv1a": f"with m as (select 'key' || lpad(range::varchar, 6, '0') as key from range(2000)), mh as (select key, {_FNV.format(k='key')} as h from m) select key, (h % 4294967296::uhugeint)::bigint as h1, (h // 4294967296::uhugeint)::bigint as h2 from mh",
        "bloom_positions": f"with m as (select 'key' || lpad(range::varchar, 6, '0') as key from range(10000)), mh as (select {_FNV.format(k='key')} as h from m) select distinct 100000::bigint as bits, {_POS.format(m=100000)} as pos from mh, range(7) r(i)",
        "bloom_false_positives": _maybe_sql(100_000, "absent", "count(*) as maybe"),
        "bloom_no_false_negatives": _maybe_sql(10_000, "key", "10000 - count(*) as missed"),
        "bloom_skip_tables": f"""with {_SST}, e as (select gen, 'user:' || lpad(k::varchar, 8, '0') as key from sst), z as (select gen, (ceil(greatest(count(*), 1) * 10 / 8) * 8)::bigint as m from e group by gen),
eh as (select gen, m, {_FNV.format(k="key")} as h from e join z using (gen)), bits as (select distinct gen, {_POS.format(m="m")} as pos from eh, range(7) r(i)),
p as (select 'missing-' || range::varchar as key from range(1000)), ph as (select key, gen, m, {_FNV.format(k="key")} as h from p, z), pp as (select distinct key, gen, {_POS.format(m="m")} as pos from ph, range(7) r(i)),
x as (select key, gen from pp left join bits using (gen, pos) group by key, gen having count(*) = count(bits.pos)) select key, count(*) as maybe_runs from x group by key""".replace("count(bits.pos)", "count(case when bits.pos is not null then 1 end)"),
        "encode_records": "select doc_id as seq, md5(unhex(lpad(hex(doc_id + 1755000000000000000), 16, '0') || '00000008' || lpad(hex(strlen(text)), 8, '0') || lpad(hex(doc_id), 16, '0')) || encode(text)) as body_md5, (28 + strlen(text))::bigint as bytes from documents",
        "decode_records": f"with {_KV} select seq, 'ok' as status, ts, key, value, tombstone from kv",
        "bit_flip_detection": "select * from (values ('timestamp', 'corrupt'), ('key_length', 'corrupt'), ('value_length', 'short'), ('key', 'corrupt'), ('value', 'corrupt')) t(region, status)",
        "torn_tail_recovery": "select file, ((select count(*) from events) - lost)::bigint as records, ends, 3::bigint as files, junk_bytes from (values ('whole', 0, 'end', 0::bigint), ('cut', 3, 'short', 0::bigint), ('junk', 0, 'short', 33::bigint)) t(file, lost, ends, junk_bytes)",
        "btree_shape": "select *, round(log2(n), 1) as log2_n from (values (1000::bigint, 2::bigint, 9::bigint, 992::bigint, 33.6::double), (10000, 2, 13, 9992, 33.4), (100000, 2, 16, 99990, 33.3)) v(n, t, height, nodes, fill_percent)",
        "log_merge": f"with {_KV_LAST} select key, value, ts, tombstone from last where not tombstone",
        "wal_append": f"with {_KV_LAST} select key, value, (select sum(12 + body) from kv)::bigint as wal_bytes, 0::bigint as after_reset from last where not tombstone",
        "sst_get": f"with {_KV_LAST} select key, gen, value, tombstone from last where key < 'user:00000200'",
        "store_compaction": f"with {_KV_LAST} select key, value, seq, tombstone, 1::bigint as tables from last where not tombstone",
        "store_maybe_compact": f"with {_KV_LAST} select key, value, seq, 2::bigint as tables from last where not tombstone",
        "log_files": f"with {_KV_LAST} select key, value, ts from last where not tombstone",
        "sst_import": f"with {_KV} select gen, key, value, tombstone from kv qualify row_number() over (partition by gen, key order by seq desc) = 1",
        "wal_replay": kv_live,
        "lsm_open": kv_live,
        "run_store": kv_live,
        "stream_upsert": kv_live,
        "stream_runs": kv_live,
    }
