"""Semantics of keyed state on small inputs: against a plain dict, and byte by byte."""

import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from stratalog import model
from stratalog.functions import bloom, codec
from stratalog.operators import metrics, ordered, runs, state
from stratalog.plans.store import Conflict, Manifest, RunStore, TooLate
from stratalog.sources import binary, files
from stratalog.streaming import upsert

LOG = "seq long, ts long, key binary, value binary, tombstone boolean"


def mutations(spark, rows):
    return spark.createDataFrame([(i, 1000 + i, k.encode(), None if v is None else v.encode(), v is None) for i, (k, v) in enumerate(rows)], LOG)


def random_rows(n, keys, seed):
    rng = random.Random(seed)
    return [(f"key{rng.randrange(keys):03d}", None if rng.random() < 0.2 else f"v{i}") for i in range(n)]


def as_dict(rows):
    out = {}
    for k, v in rows:
        if v is None:
            out.pop(k, None)
        else:
            out[k] = v
    return out


def found(df):
    return {bytes(r.key).decode(): bytes(r.value).decode() for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_newest_per_key_is_a_dict(spark, seed):
    rows = random_rows(2000, 150, seed)
    log = mutations(spark, rows)
    assert found(state.live(log, ["key"], "seq", "tombstone")) == as_dict(rows)
    assert found(state.newest_narrow(log, ["key"], "seq").where("not tombstone")) == as_dict(rows)


def test_outcomes_of_deletes(spark):
    log = mutations(spark, [("a", None), ("a", "1"), ("a", None), ("a", None), ("b", "2")])
    got = [(r.seq, r.outcome) for r in state.delete_outcomes(log, "key", "seq", "tombstone").orderBy("seq").collect()]
    assert got == [(0, "not_found"), (2, "ok"), (3, "not_found")]
    assert [r.seq for r in state.accepted(log, "key", "seq", "tombstone").orderBy("seq").collect()] == [1, 2, 4]


def test_status_and_empty_log(spark):
    log = mutations(spark, [("a", "1"), ("b", "1"), ("b", None)])
    probes = spark.createDataFrame([(b"a",), (b"b",), (b"c",), (None,)], "key binary")
    got = {r.key and bytes(r.key): r.status for r in state.status(probes, log, "key", "seq", "tombstone").collect()}
    assert got == {b"a": "live", b"b": "deleted", b"c": "absent", None: "absent"}
    assert {r.status for r in state.status(probes, log.limit(0), "key", "seq", "tombstone").collect()} == {"absent"}


def test_verdicts_at_the_limits(spark):
    sizes = [(0, 1), (1, 0), (65_536, 1), (65_537, 1), (1, (16 << 20)), (1, (16 << 20) + 1)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(sizes)], "i int, k int, v int").select("i", F.repeat(F.lit("x"), F.col("k")).cast("binary").alias("key"), F.repeat(F.lit("x"), F.col("v")).cast("binary").alias("value"))
    got = [r.v for r in df.select("i", model.verdict(F.col("key"), F.col("value")).alias("v")).orderBy("i").collect()]
    assert got == ["empty_key", "ok", "ok", "key_too_large", "ok", "value_too_large"]


CASES = [(b"k", b"v"), (b"k", b""), (b"\x00\xff", b"\x00" * 9), (b"x" * 65_536, b"v"), (b"gone", None), ("clé".encode(), b"1" * 100_000)]


def test_column_codec_equals_bytes(spark):
    df = spark.createDataFrame([(i, 1_755_000_000_000_000_000 + i, k, v, v is None) for i, (k, v) in enumerate(CASES)], LOG)
    log, table = codec.encode_log(F.col("ts"), F.col("key"), F.col("value"), F.col("tombstone")), codec.encode_table(F.col("key"), F.col("value"), F.col("tombstone"))
    for r in df.select("*", log.alias("log"), table.alias("table"), codec.decode(log).alias("back")).collect():
        k, v = CASES[r.seq]
        record = binary.Record(k, v, v is None, r.ts)
        assert bytes(r.log) == binary.encode(record, model.LOG_HEAD)
        assert bytes(r.table) == binary.encode(record, model.TABLE_HEAD)
        assert (r.back.status, bytes(r.back.key), r.back.value and bytes(r.back.value), r.back.tombstone) == ("ok", k, v if v else (None if v is None else r.back.value), v is None)
        assert binary.decode(bytes(r.log), 0, model.LOG_HEAD)[1] == record


def test_damage_is_told(spark):
    good = binary.encode(binary.Record(b"hello", b"world", False, 5), model.LOG_HEAD)
    flipped = [good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :] for i in (4, 12, 19, 20, 27)]
    bomb = good[:12] + struct.pack(">I", 0xFFFFFFF0) + good[16:]
    df = spark.createDataFrame([(x,) for x in [*flipped, bomb, good[:-1], good[:3], b""]], "d binary")
    got = [r[0] for r in df.select(codec.decode(F.col("d"))["status"]).collect()]
    assert got == [binary.decode(x, 0, model.LOG_HEAD)[0] for x in [*flipped, bomb, good[:-1], good[:3], b""]]
    assert "ok" not in got and got[-3:] == ["short"] * 3


def test_torn_tails():
    log = b"".join(binary.encode(binary.Record(b"k%d" % i, b"v" * 20, False, i), model.LOG_HEAD) for i in range(100))
    assert binary.recovered(log[:-7], model.LOG_HEAD)[0] == 99
    assert binary.recovered(log + b"junkjunk123", model.LOG_HEAD)[:2] == (100, len(log))


@pytest.mark.parametrize("piece", [1, 37, 1 << 20])
def test_streamed_logs_are_as_whole_ones(piece):
    rng = random.Random(piece)
    for head in (model.LOG_HEAD, model.TABLE_HEAD):
        log = b"".join(binary.encode(binary.Record(b"k%d" % i, rng.randbytes(rng.randrange(200)), i % 7 == 0, i), head) for i in range(60))
        flipped = log[:2000] + bytes([log[2000] ^ 4]) + log[2001:]
        for data in (b"", log, log[:-5], log + bytes(11), log + b"junkjunkjunkjunkjunk1", flipped):
            reader = binary.Reader(io.BytesIO(data).read, head, piece)
            assert list(reader) == list(binary.walk(data, head))
            assert (reader.records, reader.valid, reader.ends) == binary.recovered(data, head)


def test_large_log_files_are_streamed(spark, tmp_path):
    log = mutations(spark, random_rows(300, 40, 8))
    files.write_log(log, str(tmp_path / "log"), 3)
    files.write_wal(log, str(tmp_path / "wal"), 2)
    sizes = [f.stat().st_size for f in (tmp_path / "log").glob("*.log")]
    for read, folder in ((files.read_log, "log"), (files.read_wal, "wal"), (files.recovery_report, "log")):
        want = sorted(map(repr, read(spark, str(tmp_path / folder)).collect()))
        for whole in (0, min(sizes)):
            assert want and sorted(map(repr, read(spark, str(tmp_path / folder), whole=whole).collect())) == want


def test_table_files():
    entries = [binary.Record(b"a", b"1"), binary.Record(b"b", None, True), binary.Record(b"c", b""), binary.Record(b"d", b"x" * 5000)]
    data = binary.write_table(entries)
    assert binary.read_table(data) == entries
    with pytest.raises(ValueError, match="ascend"):
        binary.write_table(entries[::-1])
    with pytest.raises(binary.NotATable):
        binary.read_table(b"garbage" * 40)
    for at in (13, len(data) - 60, len(data) - 20):
        broken = bytearray(data)
        broken[at] ^= 4
        if at == len(data) - 60:
            continue  # the filter has no checksum; entries are still whole
        with pytest.raises(binary.CorruptTable):
            binary.read_table(bytes(broken))
    many = [binary.Record(b"k%06d" % i, b"x" * 100) for i in range(500)]
    assert len(binary.write_table(many)) == 69_666


def test_bloom_columns_equal_bytes(spark):
    keys = ["", "a", "key000001", "ü"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    h = bloom.fnv1a(F.encode("k", "utf-8"))
    for r in df.select("k", h["h1"].alias("h1"), h["h2"].alias("h2")).collect():
        want = binary.FNV_START
        for b in r.k.encode():
            want = (want ^ b) * binary.FNV_PRIME % 2**64
        assert (r.h1, r.h2) == (want & 0xFFFFFFFF, want >> 32)
    members = [b"key%06d" % i for i in range(1000)]
    section = binary.bloom(members, len(members))
    assert all(binary.bloom_says_maybe(section, k) for k in members)
    bits = bloom.build(spark.createDataFrame([(bytearray(k),) for k in members], "k binary"), "k")
    packed = bytearray(len(section) - 5)
    for r in bloom.packed(bits).collect():
        packed[r.byte] = r.value
    assert bytes(packed) == section[5:]


def test_bloom_asks_every_filter(spark):
    members = {i: [b"member%d" % j for j in range(i, i + 1 + i % 3)] for i in range(10_300)}
    asked = [b"member3", b"member10200", b"missing", b"member10301"]
    keys = spark.createDataFrame([(i, bytearray(k)) for i, own in members.items() for k in own], "run int, k binary")
    probes = spark.createDataFrame([(bytearray(k),) for k in asked], "key binary")
    got = {(bytes(r.key), r.run) for r in bloom.may_contain(probes, "key", bloom.build(keys, "k", "run")).collect()}
    sections = {i: binary.bloom(own, len(own)) for i, own in members.items()}
    assert got == {(k, i) for k in asked for i, s in sections.items() if binary.bloom_says_maybe(s, k)}


def test_files_round_trip(spark, tmp_path):
    rows = random_rows(400, 40, 3)
    log = mutations(spark, rows)
    files.write_log(log, str(tmp_path / "log"), 3)
    assert files.read_log(spark, str(tmp_path / "log")).count() == 400
    data = (tmp_path / "log" / "000000000-000000-000000.log").read_bytes()
    (tmp_path / "log" / "000000000-000000-000000.log").write_bytes(data[:-3])
    report = {r.file[-27:]: r for r in files.recovery_report(spark, str(tmp_path / "log")).collect()}
    assert report["000000000-000000-000000.log"].ends == "short" and report["000000000-000000-000000.log"].lost_bytes > 0 and report["000000000-000001-000000.log"].ends == "end"
    gens = log.withColumn("gen", F.floor(F.col("seq") / 100).cast("int"))
    files.write_tables(runs.flush(gens.where("gen < 3"), "key"), str(tmp_path / "store"))
    (tmp_path / "store" / "notes.txt").write_text("x")
    files.write_wal(log.where("seq >= 300"), str(tmp_path / "store"))
    opened = files.open_store(spark, str(tmp_path / "store")).withColumn("o", F.struct("gen", "at"))
    assert found(state.live(opened, ["key"], "o", "tombstone")) == as_dict(rows)


def test_tombstones_stay_in_partial_merges(spark):
    rows = spark.createDataFrame([(0, b"k", b"old", False), (1, b"k", None, True), (1, b"j", b"1", False)], "gen int, key binary, value binary, tombstone boolean")
    assert [bytes(r.key) for r in runs.resurrected(rows, 1, "key", "gen", "tombstone").collect()] == [b"k"]
    assert runs.merge(rows.where("gen = 1"), False, "key", "gen", "tombstone").count() == 2
    assert found(runs.merge(rows, True, "key", "gen", "tombstone")) == {"j": "1"}


def test_flush_by_bytes_is_the_sequential_rule(spark):
    rows = random_rows(500, 20, 5)
    log = mutations(spark, rows).withColumn("store", F.lit("s"))
    got = [r.gen for r in runs.flush_by_bytes(log, 60, "store").orderBy("seq").collect()]
    held, gen, want = {}, 0, []
    for k, v in rows:
        held[k] = len(k) + len(v or "")
        want.append(gen)
        if sum(held.values()) >= 60:
            held, gen = {}, gen + 1
    assert got == want


def test_run_store(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s", buckets=2)
    rows = random_rows(600, 50, 9)
    log = mutations(spark, rows)
    assert store.get(b"key001") == ("absent", None) and store.live().count() == 0 and not store.compact()
    for i in range(3):
        assert store.flush(log.where(f"seq >= {200 * i} and seq < {200 * (i + 1)}"), i)
    assert not store.flush(log, 2) and not store.flush(log.limit(0))
    assert store.tables() == 3 and found(store.live()) == as_dict(rows)
    gone = next(k for k in dict(rows) if k not in as_dict(rows))
    assert store.get(gone.encode()) == ("deleted", None)
    assert [bytes(r.key) for r in store.scan(b"key010", b"key020").collect()] == sorted(k.encode() for k in as_dict(rows) if "key010" <= k <= "key020")
    # a run that was written before a crash, and not published, doesn't exist
    store._write_run(log)
    assert found(store.live()) == as_dict(rows)
    size = store.size()
    assert store.maybe_compact(3, settled=599) and store.tables() == 1 and not store.maybe_compact(3)
    assert 0 < store.size() < size and store.runs().where("tombstone").count() == 0
    assert len(store.sweep()) >= 4 and found(store.live()) == as_dict(rows)
    with pytest.raises(Conflict):
        store._publish(Manifest(store.manifest().version, ()))
    with pytest.raises(TooLate):
        store.flush(log.limit(5))
    assert store.set(600, b"late", b"x") and store.get(b"late") == ("live", b"x")
    assert store.delete(601, b"late") and store.get(b"late") == ("deleted", None) and found(store.live()) == as_dict(rows)
    assert store.get(gone.encode()) == ("absent", None)
    store.close()
    with pytest.raises(ValueError, match="closed"):
        store.live()


def test_run_store_orders_by_seq(spark, tmp_path):
    rows = random_rows(400, 25, 12)
    log = mutations(spark, rows)
    store = RunStore(spark, f"file://{tmp_path}/s", buckets=1)
    late = as_dict(rows)
    for i, part in enumerate((4, 2, 0, 3, 1)):
        store.flush(log.where(f"seq % 5 = {part}"), i)
        if i in (1, 3):
            assert store.compact() and store.tables() == 1
    assert found(store.live()) == late and [bytes(r.key).decode() for r in store.scan().collect()] == sorted(late)
    for k in {k for k, _ in rows}:
        assert store.get(k.encode()) == (("live", late[k].encode()) if k in late else ("deleted", None))
    assert store.compact(settled=399) and store.runs().count() == len(late)


def test_published_batches_are_remembered(tmp_path):
    m = Manifest(0, ())
    for i in [*range(2000), 5000, 5002, 5001]:
        m = m.after((), i)
    assert m.batches == ((0, 1999), (5000, 5002)) and m.has(0) and m.has(1999) and not m.has(2000) and m.gens == 2003


def test_streams(spark, tmp_path):
    rows = random_rows(300, 30, 11)
    for i in range(3):
        mutations(spark, rows).where(f"seq % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(model.MUTATION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert.newest_to_table(stream(), "key", "seq", str(tmp_path / "c1"), str(tmp_path / "rows")).awaitTermination()
    assert found(state.live(spark.read.schema(model.MUTATION).parquet(str(tmp_path / "rows")), ["key"], "seq", "tombstone")) == as_dict(rows)
    store = RunStore(spark, f"file://{tmp_path}/s", 1)
    upsert.to_runs(stream(), store, str(tmp_path / "c2")).awaitTermination()
    assert store.tables() == 3
    assert found(store.live()) == as_dict(rows)


@pytest.mark.parametrize("block", [1, 7, 100, 10_000])
def test_outcomes_do_not_depend_on_blocks(spark, block):
    rows = random_rows(300, 6, 13)
    want, live_keys = [], set()
    for i, (k, v) in enumerate(rows):
        if v is None:
            want.append((i, "ok" if k in live_keys else "not_found"))
            live_keys.discard(k)
        else:
            live_keys.add(k)
    log = mutations(spark, rows)
    assert sorted((r.seq, r.outcome) for r in state.delete_outcomes(log, "key", "seq", "tombstone", block).collect()) == want
    kept = {r.seq for r in state.accepted(log, "key", "seq", "tombstone", block).collect()}
    assert kept == set(range(300)) - {i for i, x in want if x == "not_found"}


def test_log_and_wal_grow(spark, tmp_path):
    rows = random_rows(300, 40, 14)
    log, folder = mutations(spark, rows), f"file://{tmp_path}/log"
    assert len(files.write_log(log.where("seq < 100"), folder, 2, 500)) > 4
    files.append_log(spark, log.where("seq between 100 and 199"), folder, 2)
    files.append_log(spark, log.where("seq >= 200"), folder)
    back = [bytes(r.key) for r in files.read_log(spark, folder).orderBy("file", "offset").collect()]
    assert back == [k.encode() for k, _ in rows]
    files.merge_log(spark, folder, f"file:{tmp_path}/merged", 2)
    merged = files.read_log(spark, str(tmp_path / "merged"))
    assert found(merged) == as_dict(rows) and {r.ts - 1000 for r in merged.collect()} == {max(i for i, (x, _) in enumerate(rows) if x == k) for k in as_dict(rows)}
    store = str(tmp_path / "store")
    for i in range(3):
        files.append_wal(spark, log.where(f"seq div 100 = {i}"), store)
    size = files.wal_size(spark, store)
    assert [bytes(r.key) for r in files.read_wal(spark, store).orderBy("file", "offset").collect()] == [k.encode() for k, _ in rows]
    assert files.reset_wal(spark, store) == size > 0 == files.wal_size(spark, store)


def test_lookup_in_tables(spark, tmp_path):
    rows = random_rows(400, 60, 15)
    log = mutations(spark, rows).withColumn("gen", F.floor(F.col("seq") / 100).cast("int"))
    files.write_tables(runs.flush(log, "key"), str(tmp_path))
    keys = [b"key%03d" % i for i in range(70)]
    got = {bytes(r.key).decode(): None if r.tombstone else bytes(r.value).decode() for r in files.get_from_tables(spark, str(tmp_path), keys).collect()}
    assert got == dict(rows)


@pytest.mark.parametrize("t", [2, 3, 8])
def test_tree_against_a_set(t):
    rng = random.Random(t)
    tree, model_ = ordered.Tree(t), set()
    for _ in range(2000):
        k = rng.randrange(700)
        assert tree.insert(k) == (k not in model_)
        model_.add(k)
    tree.validate()
    assert tree.keys() == sorted(model_) and 5 in tree or 5 not in model_


def test_shape_of_ascending_inserts():
    assert ordered.tree_shape(range(1000), 2) | {"fill": 0} == {"size": 1000, "height": 9, "nodes": 992, "fill": 0}
    with pytest.raises(ValueError):
        ordered.Tree(1)


def test_ordered_set(spark):
    df = spark.createDataFrame([(10, 0), (20, 1), (5, 2), (10, 3)], "k long, i int")
    assert [r.k for r in ordered.sorted_keys(df, "k").collect()] == [5, 10, 20]
    assert [r.inserted for r in ordered.insert_outcomes(df, "k", "i").orderBy("i").collect()] == [True, True, True, False]
    assert ordered.search(spark.createDataFrame([(0,), (10,), (-3,)], "k long"), df, "k").count() == 1
    assert [r.k for r in ordered.range_keys(df, "k", 6, 20).collect()] == [10, 20]


def test_space(spark):
    log = mutations(spark, [("a", "11"), ("a", "22"), ("b", "3"), ("b", None), ("zz", None)])
    r = metrics.space(log).first()
    assert (r.log_bytes, r.merged_bytes) == (23 + 23 + 22 + 21, 23)
    assert metrics.space(log.limit(0)).first().amplification is None
