"""Substring dedup with super-k-mers.

A window is `span` consecutive words. Its minimiser is the smallest hash of the m-grams in
it, so equal windows share it, and consecutive windows that share one travel as a single
packed string to the minimiser's bucket. There the windows of all strings are sorted by
hash, equal ones are compared byte by byte, and all but the first are reported.

Hot groups: a task sends equal packed strings once, with their first place, and marks the
others itself, as they start later. Minimisers fall into cells; cells with far more strings
than the mean (counted over the whole corpus; by counting there are at most CELLS / HOT of
them) are dealt out window by window, by the window's own hash, so that passages which a
third of the documents share spread over many buckets."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, released, stored, table
from .words import Words, grams, mix, pieces, split

SPAN, M = 20, 3
#: Of the frames' compression: these are most of what is shuffled.
ZSTD_LEVEL = 6
#: Cells of minimisers for counting, and from how many times the mean a cell is hot.
CELLS, HOT = 1 << 16, 16
#: Input bytes for each bucket of windows.
BUCKET_BYTES = 1 << 20
#: Packed bytes that a task holds before it sends them on.
HOLD_BYTES = 24 << 20
_U = np.uint64
NO_ID = -(1 << 63)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+size[0]-1, start[1] .. and so on."""
    at = np.cumsum(size) - size
    return np.repeat(start - at, size) + np.arange(int(size.sum()))


def super_kmers(words: Words, span: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, windows, text) of each run of windows that share a minimiser."""
    h = words.hashes()
    n_windows = np.maximum(np.diff(words.first) - span + 1, 0)
    if not n_windows.sum():
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    g = h[: len(h) - m + 1].copy()
    for j in range(1, m):
        g = g * _U(0xD1342543DE82EF97) + h[j : len(h) - m + 1 + j]
    least = _sliding_min(mix(g), span - m + 1)  # of the window that starts at each word
    at = _ranges(words.first[:-1], n_windows)
    text = np.repeat(np.arange(words.texts), n_windows)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    return value[begin], at[begin], np.diff(np.append(begin, len(at))), text[begin]


def _cell(minimiser: np.ndarray) -> np.ndarray:
    return (mix(minimiser) >> _U(48)).astype(np.int64) & (CELLS - 1)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))


def hot_cells(docs: DataFrame, span: int, m: int) -> list[int]:
    """The cells whose count of packed strings is over HOT times the mean: fewer than CELLS / HOT."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                total += np.bincount(_cell(super_kmers(split(piece.column(0)), span, m)[0]), minlength=CELLS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    cells = stored(docs.select("text").mapInArrow(lambda it: released(count(it)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    mean = (cells.agg(F.sum("n")).first()[0] or 0) / CELLS
    return sorted(r[0] for r in cells.where(F.col("n") > max(HOT * mean, 64)).select("cell").collect())


# One string in a frame: id, text's print, first word, windows, bytes.
_HEAD = struct.Struct("<qqqqi")
_HEAD_TYPE = np.dtype([("id", "<i8"), ("print", "<i8"), ("at", "<i8"), ("windows", "<i8"), ("bytes", "<i4")])


def _merged(rows: np.ndarray) -> np.ndarray:
    """Rows (id, print, first word, windows) with runs that follow each other in a text made one."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    cut = np.ones(len(rows), bool)
    cut[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1) | (rows[1:, 2] > rows[:-1, 2] + rows[:-1, 3])
    begin = np.flatnonzero(cut)
    out = rows[begin]
    out[:, 3] = np.maximum.reduceat(rows[:, 2] + rows[:, 3], begin) - out[:, 2]
    return out


class _Sender:
    """Packs strings into compressed frames by bucket, each distinct one once.

    Only where other texts of the same id have it at the same word too, it goes once for each of these."""

    def __init__(self, buckets: int, hot: list[int], span: int, m: int):
        self.buckets, self.span, self.m = buckets, span, m
        self.hot = np.zeros(CELLS, bool)
        self.hot[hot] = True
        self.seen: dict[bytes, tuple[int, int, int, int, int]] = {}
        self.twins: dict[bytes, set[int]] = {}  # prints of these other texts
        self.held = 0
        self.repeats: list[np.ndarray] = []

    def add(self, ids: np.ndarray, prints: np.ndarray, words: Words) -> None:
        value, first, windows, text = super_kmers(words, self.span, self.m)
        hot = self.hot[_cell(value)]
        key = mix(value)
        if hot.any():
            # each window of a hot cell alone, dealt by its own words
            w_at, w_text = _ranges(first[hot], windows[hot]), np.repeat(text[hot], windows[hot])
            whole, g_at = grams(words.hashes(), words.first, self.span)
            w_key = whole[g_at[w_text] + w_at - words.first[w_text]]
            cold = ~hot
            key, first, text = np.concatenate([key[cold], w_key]), np.concatenate([first[cold], w_at]), np.concatenate([text[cold], w_text])
            windows = np.concatenate([windows[cold], np.ones(len(w_at), np.int64)])
        packed, start, end = words.packed()
        raw = packed.tobytes()
        bucket = (key % _U(self.buckets)).astype(np.int64)
        own_at = first - words.first[text]
        rows = zip(start[first].tolist(), end[first + windows + self.span - 2].tolist(), ids[text].tolist(), prints[text].tolist(), own_at.tolist(), windows.tolist(), bucket.tolist())
        seen, late, size = self.seen, [], 0
        for s, e, i, p, a, n, b in rows:
            string = raw[s:e]
            had = seen.get(string)
            if had is None:
                seen[string] = (i, a, p, n, b)
                size += e - s + 150
            elif (had[0], had[1]) <= (i, a):
                if (had[0], had[1]) < (i, a):
                    late.append((i, p, a, n))
                elif p != had[2] and p not in self.twins.setdefault(string, set()):
                    self.twins[string].add(p)
                    size += e - s + 150
            else:
                seen[string] = (i, a, p, n, b)
                late += [(had[0], q, had[1], had[3]) for q in (had[2], *self.twins.pop(string, ()))]
        self.held += size
        if late:
            self.repeats.append(np.array(late, np.int64))

    def send(self) -> Iterator[pa.RecordBatch]:
        frames: dict[int, list[bytes]] = {}
        for string, (i, a, p, n, b) in self.seen.items():
            for q in (p, *self.twins.get(string, ())):
                frames.setdefault(b, []).append(_HEAD.pack(i, q, a, n, len(string)))
                frames[b].append(string)
        self.seen, self.twins, self.held = {}, {}, 0
        squeeze = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
        buckets, blobs, size = [], [], 0
        for b, parts in frames.items():
            head = np.frombuffer(b"".join(parts[::2]), _HEAD_TYPE)
            columns = b"".join(np.ascontiguousarray(head[f]).tobytes() for f in _HEAD_TYPE.names)  # alike bytes together
            buckets.append(b)
            blobs.append(squeeze.compress(struct.pack("<q", len(head)) + columns + b"".join(parts[1::2])))
            size += len(blobs[-1])
            if size > 4 << 20:
                yield self._batch(buckets, blobs)
                buckets, blobs, size = [], [], 0
        if self.repeats:
            # what this task already knows to be repeats: bucket -1 doesn't exist, so any will do
            known = _merged(np.concatenate(self.repeats))
            self.repeats = []
            buckets.append(-1 - int(known[0, 0]) % self.buckets)
            blobs.append(squeeze.compress(known.tobytes()))
        if buckets:
            yield self._batch(buckets, blobs)

    @staticmethod
    def _batch(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "frame"])


def _byte_equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[a:a+size] == buf[b:b+size], of each."""
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), 4096):
        s = size[lo : lo + 4096]
        same = buf[_ranges(a[lo : lo + 4096], s)] == buf[_ranges(b[lo : lo + 4096], s)]
        out[lo : lo + 4096] = np.logical_and.reduceat(same, np.cumsum(s) - s)
    return out


def _repeats(frames: list[bytes], span: int) -> np.ndarray:
    """Rows (id, print, first word, windows) of the runs of windows in a bucket that start earlier elsewhere."""
    open_ = zstandard.ZstdDecompressor()
    heads, strings = [], []
    for frame in frames:
        raw = open_.decompress(frame)
        n = struct.unpack_from("<q", raw)[0]
        head, at = np.zeros(n, _HEAD_TYPE), 8
        for f in _HEAD_TYPE.names:
            head[f] = np.frombuffer(raw, _HEAD_TYPE[f], n, at)
            at += n * _HEAD_TYPE[f].itemsize
        heads.append(head)
        strings.append(np.frombuffer(raw, np.uint8, offset=at))
    head, buf = np.concatenate(heads), np.concatenate(strings)
    at = np.zeros(len(head) + 1, np.int64)
    np.cumsum(head["bytes"], out=at[1:])
    texts = pa.Array.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(at), pa.py_buffer(buf)])
    words = split(texts)
    g, g_at = grams(words.hashes(), words.first, span)
    owner = np.repeat(np.arange(len(head)), np.diff(g_at))
    word = _ranges(words.first[:-1], np.diff(g_at))
    ids, prints = head["id"][owner], head["print"][owner]
    places = head["at"][owner] + word - words.first[owner]
    order = np.argsort(g, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = g[order[1:]] == g[order[:-1]]
    member = same.copy()
    member[:-1] |= same[1:]
    if not member.any():
        return np.zeros((0, 4), np.int64)
    # groups of equal hash, each sorted by place
    rows = order[member]
    rows = rows[np.lexsort((places[rows], ids[rows], g[rows]))]
    found = []
    while len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = g[rows[1:]] != g[rows[:-1]]
        lead = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rest = ~new
        a, b = rows[rest], lead[rest]
        size = words.end[word[a] + span - 1] - words.start[word[a]]
        fits = size == words.end[word[b] + span - 1] - words.start[word[b]]
        fits[fits] = _byte_equal(buf, words.start[word[a[fits]]], words.start[word[b[fits]]], size[fits])
        later = fits & ((ids[a] > ids[b]) | (places[a] > places[b]))
        found.append(a[later])
        rows = a[~fits]  # equal hashes of unequal windows, if ever, are grouped anew
    dup = np.sort(np.concatenate(found))
    if not len(dup):
        return np.zeros((0, 4), np.int64)
    cut = np.ones(len(dup), bool)
    cut[1:] = (np.diff(dup) != 1) | (owner[dup[1:]] != owner[dup[:-1]])
    begin = np.flatnonzero(cut)
    lead = dup[begin]
    return _merged(np.stack([ids[lead], prints[lead], places[lead], np.diff(np.append(begin, len(dup)))], 1))


def _runs(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(4)], ["id", "print", "at", "windows"])


def repeated_windows(docs: DataFrame, span: int = SPAN, m: int = M, text_bytes: int | None = None) -> DataFrame:
    """Rows id, print, at, windows: runs of windows of (id, print, text) whose words also start earlier."""
    if text_bytes is None:
        text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, int(text_bytes) // BUCKET_BYTES)
    hot = hot_cells(docs, span, m)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets, hot, span, m)
        for batch in batches:
            for piece in pieces(batch):
                sender.add(piece.column(1).to_numpy(), piece.column(2).to_numpy(), split(piece.column(0)))
                if sender.held > HOLD_BYTES:
                    yield from sender.send()
        yield from sender.send()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, frames = None, []
        for batch in batches:
            for b, frame in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b < 0:
                    yield _runs(np.frombuffer(zstandard.ZstdDecompressor().decompress(frame.as_py()), np.int64).reshape(-1, 4))
                    continue
                if b != bucket and frames:
                    yield _runs(_repeats(frames, span))
                    frames = []
                bucket = b
                frames.append(frame.as_py())
        if frames:
            yield _runs(_repeats(frames, span))

    sent = docs.select("text", "id", "print").mapInArrow(lambda it: released(send(it)), "bucket long, frame binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 64)
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: released(count(it)), "id long, print long, at long, windows long")


def _kept(batches: Iterable[pa.RecordBatch], span: int, want_text: bool) -> Iterator[pa.RecordBatch]:
    """Of rows (text, id, spans): the words that no span covers. spans: first word and windows, in turn."""
    for batch in batches:
        for piece in pieces(batch):
            words = split(piece.column(0))
            n = np.diff(words.first)
            diff = np.zeros(len(words.start) + 1, np.int64)
            spans = piece.column(2)
            sizes = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten().to_numpy()
            if len(flat):
                base = np.repeat(words.first[:-1], np.where(spans.is_valid().to_numpy(zero_copy_only=False), sizes, 0) // 2)
                np.add.at(diff, base + flat[::2], 1)
                np.add.at(diff, base + flat[::2] + flat[1::2] + span - 1, -1)
            keep = np.cumsum(diff[:-1]) == 0
            count = np.concatenate([[0], np.cumsum(keep)])
            n_kept = count[words.first[1:]] - count[words.first[:-1]]
            packed, start, end = words.packed()
            left = packed[_ranges(start[keep], end[keep] - start[keep] + 1)] if len(keep) else packed
            ends = np.concatenate([[0], np.cumsum(end[keep] - start[keep] + 1)]).astype(np.int64)
            raw, hashes, texts = left.tobytes(), [], []
            for a, b in zip(ends[count[words.first[:-1]]].tolist(), ends[count[words.first[1:]]].tolist()):
                text = raw[a : max(a, b - 1)]
                (texts if want_text else hashes).append(text.decode() if want_text else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column(1), pa.array(n, pa.int64()), pa.array(n - n_kept, pa.int64()), pa.array(texts if want_text else hashes, pa.string())], ["id", "n_words", "n_removed", "kept"])


def _with_spans(own: DataFrame, span: int, m: int) -> DataFrame:
    runs = repeated_windows(own, span, m)
    spans = runs.groupBy("id", "print").agg(F.flatten(F.collect_set(F.array("at", "windows"))).alias("spans"))
    return own.join(spans, ["id", "print"], "left")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, m: int = M) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window over it has the words of a window that starts earlier (smaller id,
    or same id and earlier start; null ids come first). Texts with fewer than `span` words
    keep all; null and empty texts have none and the digest of the empty string. Rows with
    equal ids count as one document: at equal starts neither is earlier. An empty table gives
    an empty result; other columns don't matter."""
    bounded_batches(docs.sparkSession)
    own = _documents(docs, id_col, text_col)
    rows = _with_spans(own, span, m).select("text", "id", "spans")
    out = rows.mapInArrow(lambda b: released(_kept(b, span, False)), "id long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def _kept_text(span: int) -> Callable[[Column, Column], Column]:
    @F.arrow_udf("string")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in released(batches):
            batch = pa.RecordBatch.from_arrays([texts, pa.nulls(len(texts), pa.int64()), spans], ["text", "id", "spans"])
            parts = [b.column(3) for b in _kept([batch], span, True)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return kept


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, m: int = M) -> DataFrame:
    """docs with the same columns and rows, texts without their repeated words.

    The kept words of a text that loses some are joined by single spaces; other texts and
    nulls stay as they are. What is repeated is as in digest()."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = _documents(docs, id_col, text_col)
    key, print_, gone = fresh(docs, "id", "print", "spans")
    found = repeated_windows(own, span, m).groupBy("id", "print").agg(F.flatten(F.collect_set(F.array("at", "windows"))).alias(gone))
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), print_: F.xxhash64(text)})
    joined = keyed.join(found.withColumnsRenamed({"id": key, "print": print_}), [key, print_], "left")
    new = F.when(F.col(gone).isNotNull(), _kept_text(span)(text, F.coalesce(gone, F.array().cast("array<bigint>")))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, new).select(*docs.columns)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from {docs}),
x as (select doc_id, unnest(range(1, len(w) - 18)) as i, w from w),
g as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as s from x),
r as (select doc_id, i from g qualify row_number() over (partition by s order by doc_id, i) > 1),
c as (select distinct doc_id, i + unnest(range(20)) as i from r),
n as (select doc_id, count(*) as n_removed, list(i) as gone from c group by doc_id),
k as (
  select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, w.w as all_words, gone
  from w left join n on w.doc_id = n.doc_id)
select doc_id, n_words, n_removed,
  sha256(case when gone is null then array_to_string(all_words, ' ')
    else array_to_string(list_filter(all_words, lambda x, i: not list_contains(gone, i)), ' ') end) as kept_sha256
from k
"""
