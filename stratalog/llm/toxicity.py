"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on ordinary text, one on toxic
text (the pieces of words that toxic documents have far more often, ahead of the same
ordinary words, so that both know the prose equally well). Every window of a text is
compressed with both; how much shorter the toxic one makes it is its distance. Thresholds
on the distances are calibrated with a logistic fit on labelled texts that the dictionaries
haven't seen. The labelled sample is bounded; every text is scored whole."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, released, table
from .words import pieces, split

#: Labelled texts to learn from, at most, and the longest of them in bytes: at most 150 MB reach the driver.
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_BYTES = 3000, 6000, 16_384
#: Words of a window, and the score from which a text counts as toxic.
WINDOW, CUT = 6, 0.3
#: Bytes of a piece of a word; how many times more often, and in what share, toxic texts have it.
PIECE, RATIO, SHARE = 5, 40, 0.012
LEVEL = 12


def _words(text: str) -> set[bytes]:
    return {b" " + w.strip(b".,;:!?\"'()") + b" " for w in text.lower().encode().split()}


def _parts(word: bytes) -> list[bytes]:
    return [word[i : i + PIECE] for i in range(len(word) - PIECE + 1)]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the (ordinary, toxic) dictionaries; the nearest to the end are the cheapest to refer to."""
    vocabularies = [[_words(t) for t in texts] for texts in (ordinary, toxic)]
    seen = []
    for texts in vocabularies:
        count: Counter[bytes] = Counter()
        for words in texts:
            count.update({p for w in words for p in _parts(w)})
        seen.append(count)
    n0, n1 = max(1, len(ordinary)), max(1, len(toxic))
    telling = {p for p, c in seen[1].items() if c >= max(3, SHARE * n1) and c / n1 > RATIO * (seen[0][p] + 1) / max(n0, RATIO * 3)}
    spans: Counter[bytes] = Counter()
    for words in vocabularies[1]:
        for w in words:
            hit = [i for i, p in enumerate(_parts(w)) if p in telling]
            if hit:
                spans[w[hit[0] : hit[-1] + PIECE]] += 1
    common: Counter[bytes] = Counter(w for words in vocabularies[0] for w in words)
    best = lambda count, n: [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:n]]
    base = b"".join(reversed(best(common, 800)))
    return base, b"".join(reversed(best(spans, 300))) + base


@functools.lru_cache(8)
def _compressor(content: bytes) -> Callable[[bytes], bytes]:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress


def features(texts: pa.Array, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Per text: the largest and second largest distance of its windows, and the logarithms of
    how many windows have 2 bytes and 4 bytes, and of how many there are."""
    a, b = _compressor(ordinary), _compressor(toxic)
    words = split(texts, lower=True)
    n = -(-np.diff(words.first) // WINDOW)
    out = np.zeros((words.texts, 5))
    full = np.flatnonzero(n)
    if not len(full):
        return out
    packed, start, end = words.packed()
    raw = b" " + packed.tobytes()
    owner = np.repeat(full, n[full])
    at = np.cumsum(n[full]) - n[full]
    first = words.first[owner] + (np.arange(len(owner)) - np.repeat(at, n[full])) * WINDOW
    last = np.minimum(first + WINDOW, words.first[owner + 1]) - 1
    far = np.array([len(a(w)) - len(b(w)) for w in (raw[s : e + 2] for s, e in zip(start[first].tolist(), end[last].tolist()))], np.float64)
    top = np.maximum.reduceat(far, at)
    rest = far.copy()
    position = np.arange(len(far))
    is_top = far == np.repeat(top, n[full])
    rest[np.minimum.reduceat(np.where(is_top, position, len(far)), at)] = 0
    out[full, 0] = np.clip(top, 0, 10)
    out[full, 1] = np.clip(np.maximum.reduceat(rest, at), 0, 10)
    out[full, 2] = np.log1p(np.add.reduceat((far >= 2).astype(float), at))
    out[full, 3] = np.log1p(np.add.reduceat((far >= 4).astype(float), at))
    out[full, 4] = np.log1p(n[full])
    return out


@dataclass(frozen=True)
class Model:
    """Dictionaries and a calibrated logistic; without toxic or ordinary labels all score 0."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(texts))
        x = features(texts, self.ordinary, self.toxic)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[1:]) + self.weights[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def in_fold(doc_id: Column) -> Column:
    """Whether a row is held out: crc32 of the id as text, modulo 4, is 2. Null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from at most TOXIC_SAMPLE + ORDINARY_SAMPLE labelled rows that aren't held out,
    those with the least hashes of the id among texts of up to SAMPLE_BYTES bytes."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").dropDuplicates(["_id"])
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t"))
    short = texts.where(~in_fold(F.col("_id")) & (F.octet_length("_t") <= SAMPLE_BYTES) & (F.octet_length("_t") > 0))
    joined = short.join(known, "_id")
    rows, totals = [[], []], [0, 0]
    for y, most in ((0, ORDINARY_SAMPLE), (1, TOXIC_SAMPLE)):
        ids = known.where((F.col("_y") == y) & ~in_fold(F.col("_id")))
        totals[y] = ids.count()
        # the bound holds before texts are read: hashes are even, so a share of them has about `most` rows
        share = min(1.0, 1.2 * most / max(1, totals[y]))
        part = joined.where((F.col("_y") == y) & (F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))))
        rows[y] = [r["_t"] for r in part.select("_t", F.xxhash64("_id").alias("_h")).orderBy("_h", "_t").limit(most).collect()]
    if min(map(len, rows)) < 4:
        return Model(b"", b"", ())
    ordinary, toxic = train_dictionaries(rows[1][::2], rows[0][::2])
    kept = pa.RecordBatch.from_arrays([pa.array(rows[0][1::2] + rows[1][1::2], pa.string())], ["t"])
    x = np.concatenate([features(p.column(0), ordinary, toxic) for p in pieces(kept)])
    y = np.repeat([0.0, 1.0], [len(rows[0][1::2]), len(rows[1][1::2])])
    w = _logistic(x, y)
    # the sample has another share of toxic rows than the labels
    w[0] += np.log(totals[1] / totals[0]) - np.log(len(rows[1]) / len(rows[0]))
    return Model(ordinary, toxic, tuple(w.tolist()))


def scores(model: Model, text: Column) -> Column:
    """A column of scores from 0 to 1; null texts count as empty."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(batches):
            parts = [model.score(p.column(0)) for p in pieces(pa.RecordBatch.from_arrays([texts], ["t"]))]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(F.coalesce(text.cast("string"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = CUT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from `cut` on).

    A score depends on the text alone; equal texts score alike, null and empty ones as a text
    without windows. Labels of unknown ids or with other values than 0 and 1 are not used;
    without labels of both kinds all score 0. An empty table gives an empty result; other
    columns don't matter."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, label_col)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), scores(model, F.col(text_col)).alias("score"))
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
