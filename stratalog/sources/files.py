"""DataFrames over files of the binary formats.

Files are read through Spark's binaryFile source, so any storage that Spark reaches
will do; a file is one task, as where a record starts is known only from those before it. A
log is a folder of such files, and writers bound what goes to one. Logs that others wrote may have
files too large for one value: tasks open those themselves and hold a record at a time. Tasks open and write files through
pyarrow's file systems, which a URI names; without a scheme it is a mounted path."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.model import LOG_HEAD, TABLE_HEAD
from stratalog.operators.state import live
from stratalog.sources import binary

_ENTRY = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("ts", pa.int64()), ("key", pa.binary()), ("value", pa.binary()), ("tombstone", pa.bool_())])
_ENTRY_DDL = "file string, offset long, ts long, key binary, value binary, tombstone boolean"
#: Rows of a batch, and bytes of its keys and values, at most.
_ROWS, _BYTES = 2048, 32 << 20
#: Bytes from which a log file is closed and another begun: far below what one binary value can hold.
FILE_BYTES = 128 << 20
#: Bytes beyond which a log file is streamed: one binary value holds less than 2 GiB.
WHOLE_BYTES = 1 << 30


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _entries(files: DataFrame, parse: Callable[[bytes], Iterator[tuple[int, binary.Record]]]) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for at, r in parse(content):
                    rows.append((path, at, r.ts, r.key, r.value, r.tombstone))
                    if len(rows) == _ROWS:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return files.mapInArrow(read, _ENTRY_DDL)


def _streams(spark: SparkSession, path: str, pattern: str, read: Callable[[str, int, pa.NativeFile], Iterator[pa.RecordBatch]], ddl: str, whole: int) -> DataFrame:
    """What read(path, bytes, stream) yields of each file. Files of up to `whole` bytes come with their
    content; of larger ones only the names do, as the scan doesn't read a column that isn't asked for."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, size, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                with _opened(p) if not content.is_valid else pa.BufferReader(content.as_buffer()) as stream:
                    yield from read(p, size, stream)

    with_content = found.where(F.col("length") <= whole).select("path", "length", "content")
    names = found.where(F.col("length") > whole).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return with_content.mapInArrow(over, ddl).unionByName(names.mapInArrow(over, ddl))


def _log_entries(head: int) -> Callable[[str, int, pa.NativeFile], Iterator[pa.RecordBatch]]:
    def read(path: str, size: int, stream: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for at, r in binary.Reader(stream.read, head):
            rows.append((path, at, r.ts, r.key, r.value, r.tombstone))
            held += len(r.key) + len(r.value or b"")
            if len(rows) == _ROWS or held >= _BYTES:
                yield _batch(rows)
                rows, held = [], 0
        yield _batch(rows)

    return read


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ENTRY)], schema=_ENTRY)


def read_log(spark: SparkSession, path: str, pattern: str = "*.log", whole: int = WHOLE_BYTES) -> DataFrame:
    """Records of log files up to the first torn or damaged one of each: file, offset, ts, key,
    value, tombstone. (file, offset) is the order of the log."""
    return _streams(spark, path, pattern, _log_entries(LOG_HEAD), _ENTRY_DDL, whole)


def read_wal(spark: SparkSession, path: str, pattern: str = "wal*.log", whole: int = WHOLE_BYTES) -> DataFrame:
    """Records of the write-ahead log's files, likewise; ts is null."""
    return _streams(spark, path, pattern, _log_entries(TABLE_HEAD), _ENTRY_DDL, whole)


def _tables(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, "*.sst").where(F.col("path").rlike(r"/\d{6,}\.sst$"))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gen", F.regexp_extract("file", r"(\d+)\.sst$", 1).cast("int"))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Entries of `%06d.sst` files with `gen`, their number; other names are ignored. A file that
    is no table, or a damaged one, fails with NotATable or CorruptTable."""
    return _numbered(_entries(_tables(spark, path), lambda data: enumerate(binary.read_table(data))))


def get_from_tables(spark: SparkSession, path: str, keys: list[bytes]) -> DataFrame:
    """The newest table's entry of each of a list of keys, tombstones included: file, offset, key,
    value, tombstone, gen. In each file the Bloom filter is asked first, then the index, and
    only the record found there is decoded."""
    wanted = sorted(set(keys))
    found = _numbered(_entries(_tables(spark, path), lambda data: binary.lookup(data, wanted)))
    return found.groupBy("key").agg(F.max_by(F.struct("file", "offset", "value", "tombstone", "gen"), "gen").alias("_x")).select("key", "_x.*")


def recovery_report(spark: SparkSession, path: str, pattern: str = "*.log", head: int = LOG_HEAD, whole: int = WHOLE_BYTES) -> DataFrame:
    """Per file: records, valid_bytes, lost_bytes and ends (end, short or corrupt). Nothing is cut off."""

    def report(name: str, size: int, stream: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        log = binary.Reader(stream.read, head)
        for _ in log:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([log.records]), pa.array([log.valid]), pa.array([size - log.valid]), pa.array([log.ends])], ["file", "records", "valid_bytes", "lost_bytes", "ends"])

    return _streams(spark, path, pattern, report, "file string, records long, valid_bytes long, lost_bytes long, ends string", whole)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """A table directory as one log: entries of all runs with gen, and the write-ahead log as the newest.

    `at` orders entries of one gen: by file and place in it."""
    tables = read_tables(spark, path).select("gen", F.struct("file", "offset").alias("at"), "key", "value", "tombstone")
    top = F.lit((1 << 31) - 1)
    return tables.unionByName(read_wal(spark, path).select(top.alias("gen"), F.struct("file", "offset").alias("at"), "key", "value", "tombstone"))


def _uri(folder: str) -> str:
    """file:/x and file:///x as file:///x; others as they are."""
    return "file:///" + folder[5:].lstrip("/") if folder.startswith("file:") else folder


def _opened(path: str) -> pa.NativeFile:
    store, base = pafs.FileSystem.from_uri(_uri(path))
    return store.open_input_stream(base)


def _place(folder: str, name: str, data: bytes) -> None:
    """Written beside and renamed: a reader sees the whole file or none. A retried task replaces
    its file by an equal one."""
    store, base = pafs.FileSystem.from_uri(_uri(folder))
    store.create_dir(base, recursive=True)
    beside = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as out:
        out.write(data)
    store.move(beside, f"{base}/{name}")


def place(files: DataFrame, folder: str) -> list:
    """Write rows (file, content) as files of these names; a row each: file, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _place(folder, name, content)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)])], ["file", "bytes"])

    return files.select("file", "content").mapInArrow(write, "file string, bytes long").collect()


def _write(df: DataFrame, folder: str, prefix: str, head: int, most: int) -> list:
    """Files of up to about `most` bytes of each partition, named by it and in its order, and a row
    about each: file, records, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, part = [], 0, 0, 0

        def done() -> pa.RecordBatch:
            name = f"{prefix}{part:06d}-{number:06d}.log"
            _place(folder, name, b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)]), pa.array([size])], ["file", "records", "bytes"])

        for batch in batches:
            for part, ts, k, v, dead in zip(*(batch.column(i).to_pylist() for i in range(5))):
                held.append(binary.encode(binary.Record(k, v, dead, ts), head))
                size += len(held[-1])
                if size >= most:
                    yield done()
                    held, size, number = [], 0, number + 1
        if held:
            yield done()

    rows = df.select(F.spark_partition_id().alias("_p"), "ts", "key", "value", "tombstone")
    return rows.mapInArrow(write, "file string, records long, bytes long").collect()


def write_log(mutations: DataFrame, folder: str, files: int = 1, most: int = FILE_BYTES) -> list:
    """Log files of mutations (seq, ts, key, value, tombstone) in seq order: `files` ranges of seq,
    each in files of about `most` bytes. Names ascend with seq."""
    return _write(mutations.repartitionByRange(files, "seq").sortWithinPartitions("seq"), folder, f"{0:09d}-", LOG_HEAD, most)


def append_log(spark: SparkSession, mutations: DataFrame, folder: str, files: int = 1, most: int = FILE_BYTES) -> list:
    """Add mutations behind what is in the folder: storage that Spark reaches can't append to a
    file, so a batch is files whose names follow the last."""
    return _write(mutations.repartitionByRange(files, "seq").sortWithinPartitions("seq"), folder, f"{_next(spark, folder, '*.log', ''):09d}-", LOG_HEAD, most)


def write_wal(mutations: DataFrame, folder: str, files: int = 1, most: int = FILE_BYTES) -> list:
    """The first files of a write-ahead log; append_wal() adds to them."""
    return _write(mutations.repartitionByRange(files, "seq").sortWithinPartitions("seq"), folder, f"wal-{0:09d}-", TABLE_HEAD, most)


def append_wal(spark: SparkSession, mutations: DataFrame, folder: str, files: int = 1, most: int = FILE_BYTES) -> list:
    """Add a batch of mutations to the write-ahead log; it is there when this returns."""
    number = _next(spark, folder, "wal*.log", "wal-")
    return _write(mutations.repartitionByRange(files, "seq").sortWithinPartitions("seq"), folder, f"wal-{number:09d}-", TABLE_HEAD, most)


def wal_size(spark: SparkSession, folder: str) -> int:
    """Bytes of the write-ahead log."""
    return sum(s.getLen() for _, s in _listed(spark, folder, "wal*.log"))


def reset_wal(spark: SparkSession, folder: str) -> int:
    """Empty the write-ahead log, once its mutations are in a table; the bytes that went."""
    gone = 0
    for fs, s in _listed(spark, folder, "wal*.log"):
        gone += s.getLen()
        fs.delete(s.getPath(), False)
    return gone


def _listed(spark: SparkSession, folder: str, pattern: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(fs, s) for s in fs.globStatus(path) or []]


def _next(spark: SparkSession, folder: str, pattern: str, prefix: str) -> int:
    """One more than the highest batch number among the files; 0 for none."""
    names = [s.getPath().getName().removeprefix(prefix) for _, s in _listed(spark, folder, pattern)]
    return max((int(n[:9]) for n in names if n[:9].isdigit()), default=-1) + 1


def merge_log(spark: SparkSession, folder: str, merged: str, files: int = 1) -> list:
    """Rewrite a log's live records, with their timestamps and in their order, to another folder:
    what superseded and deleted records took is free once the old one is removed."""
    log = read_log(spark, folder).withColumn("seq", F.struct("file", "offset"))
    return write_log(live(log, ["key"], "seq", "tombstone"), merged, files)


def write_tables(entries: DataFrame, folder: str, first: int = 1) -> list:
    """A table file per `gen` of entries (gen, key, value, tombstone), each sorted by key. A table
    is one value with its index and filter, so it is built in one task's memory; runs bound it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            data = binary.write_table(rows)
            _place(folder, f"{first + now:06d}.sst", data)
            return pa.RecordBatch.from_arrays([pa.array([f"{first + now:06d}.sst"]), pa.array([len(rows)]), pa.array([len(data)])], ["file", "records", "bytes"])

        for batch in batches:
            for g, k, v, dead in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if g != now and rows:
                    yield done()
                    rows = []
                now = g
                rows.append(binary.Record(k, v, dead))
        if rows:
            yield done()

    ordered = entries.select(F.col("gen").cast("long"), "key", "value", "tombstone").repartition("gen").sortWithinPartitions("gen", "key")
    return ordered.mapInArrow(write, "file string, records long, bytes long").collect()
