"""A quality classifier from weak labels.

Heuristic labellers vote on every document: good, bad or nothing. What they agree on shows
how accurate each is: expectation-maximisation fits their accuracies and the share of good
documents to the counts of all vote patterns of the corpus (there are at most 3 ** labellers,
however many documents). The posterior of a pattern is a soft label; a linear scorer over
hashed words and measures of the text learns from a bounded sample of these and scores
every whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .words import Words, grams, pieces, split

#: Texts in the sample that the scorer learns from, at most, and the longest of them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 8_000, 8_192
#: Buckets of the hashed words, and the score from which a text is kept.
BUCKETS, CUT = 1 << 16, 0.5
LABELLERS = ("length", "word_length", "symbols", "repeats", "diversity", "stops", "digits", "separators")
USUAL = 50

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def measures(words: Words, h: np.ndarray) -> np.ndarray:
    """Per text: words, mean word bytes, shares of symbols and digits in the words, of repeated
    5-grams, of distinct words, of words of up to 3 bytes, of the most frequent word, of words
    without any letter, and of words over 20 bytes. Shares of words count a text of fewer than
    USUAL words as if ordinary ones filled it up: a short text shows little."""
    n = np.diff(words.first).astype(float)
    some, lack = np.maximum(n, 1), np.maximum(USUAL - n, 0)
    size = (words.end - words.start).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    n_bytes = np.maximum(total[words.first[1:]] - total[words.first[:-1]], 1)
    count = lambda per_word: np.diff(np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])[words.first])

    def in_words(table: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(table[words.buf], dtype=np.int64)])
        return upto[words.end] - upto[words.start]

    symbols, digits = in_words(_PUNCT), in_words(_DIGIT)
    doc = words.doc()
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    distinct = np.bincount(doc[order[new]], minlength=words.texts)
    run = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(words.texts)
    np.maximum.at(top, doc[order[new]], run)
    g, at = grams(h, words.first, 5)
    g_doc = np.repeat(np.arange(words.texts), np.diff(at))
    g_order = np.lexsort((g, g_doc))
    g_new = np.ones(len(g), bool)
    g_new[1:] = (g[g_order[1:]] != g[g_order[:-1]]) | (g_doc[g_order[1:]] != g_doc[g_order[:-1]])
    n_grams = np.maximum(np.diff(at), 1)
    repeated = 1 - np.bincount(g_doc[g_order[g_new]], minlength=words.texts) / n_grams
    return np.stack(
        [n, n_bytes / some * (n > 0), count(symbols) / n_bytes, count(digits) / n_bytes, np.where(np.diff(at) > 0, repeated, 0), (distinct + lack) / (n + lack), (count(size <= 3) + 0.4 * lack) / (n + lack), top / (n + lack), count(symbols + digits >= size) / (n + lack), count(size > 20) / (n + lack)], 1
    )


def votes(m: np.ndarray) -> np.ndarray:
    """Per text and labeller 2 for good, 1 for bad, 0 for no vote."""
    n, length, symbols, digits, repeats, distinct, short, top, bare, long_ = m.T
    good_bad = [
        ((n >= 60), (n < 1)),
        ((length >= 3.5) & (length <= 8), (n >= 10) & ((length < 2.8) | (length > 10))),
        ((symbols < 0.01), (symbols > 0.05)),
        ((repeats < 0.02) & (n >= 25), (repeats > 0.15) & (n >= 25)),
        ((distinct > 0.35) & (top < 0.12) & (n >= 25), (distinct < 0.25) & (n < 4000) | (top > 0.2)),
        ((short > 0.15) & (short < 0.6), (short < 0.08) | (short > 0.75)),
        ((digits < 0.01), (digits > 0.06)),
        ((bare < 0.005) & (long_ < 0.02), (bare > 0.05) | (long_ > 0.1)),
    ]
    out = np.zeros((len(m), len(LABELLERS)), np.int64)
    for j, (good, bad) in enumerate(good_bad):
        out[:, j] = np.where(bad, 1, np.where(good, 2, 0))
    return out


_PLACE = 3 ** np.arange(len(LABELLERS))


@dataclass(frozen=True)
class LabelModel:
    """The share of good documents, and per labeller the chances of each vote, where it votes, on bad and good ones."""

    good: float
    chances: np.ndarray  # labellers x (bad, good) x (unused, bad, good)

    @staticmethod
    def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
        """Expectation-maximisation from labellers that see 9 good ones in 10 and 6 bad ones."""
        v = patterns[:, None] // _PLACE % 3
        total = counts.sum()
        chances = np.tile(np.array([[0, 0.6, 0.4], [0, 0.1, 0.9]]), (len(LABELLERS), 1, 1))
        model = LabelModel(0.8, chances)
        for _ in range(rounds):
            p = model.posterior(patterns)
            w = np.stack([counts * (1 - p), counts * p])
            good = (w[1].sum() + 4) / (total + 5)
            cast = [[(w[c][:, None] * (v == x)).sum(0) + 0.5 for x in (1, 2)] for c in (0, 1)]
            new = np.stack([np.stack([0 * b, b / (b + g), g / (b + g)], 1) for b, g in cast], 1)
            if abs(good - model.good) < 1e-9 and np.abs(new - model.chances).max() < 1e-9:
                break
            model = LabelModel(float(good), new)
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance that a document with these votes is good."""
        v = patterns[:, None] // _PLACE % 3
        j = np.arange(len(LABELLERS))
        # no vote says nothing either way
        ratio = np.log(self.chances[j, 1, v] + 1e-12) - np.log(self.chances[j, 0, v] + 1e-12)
        odds = np.log(self.good / (1 - self.good)) + np.where(v > 0, ratio, 0).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _patterns(texts: pa.Array) -> np.ndarray:
    words = split(texts, lower=True)
    return votes(measures(words, words.hashes())) @ _PLACE


def vote_counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The vote patterns of all texts and how many have each: at most 3 ** labellers rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for piece in pieces(batch):
                total += np.bincount(_patterns(piece.column(0)), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["pattern", "n"])

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _scaled(m: np.ndarray) -> np.ndarray:
    x = m.copy()
    x[:, 0] = np.log1p(x[:, 0]) / 3
    x[:, 1] = x[:, 1] / 10
    x[:, 2:4] = np.minimum(x[:, 2:4] * 10, 3)
    x[:, 4:] = np.minimum(x[:, 4:] * 2, 3)
    return np.concatenate([x, x * x], 1)


@dataclass(frozen=True)
class Scorer:
    """A logistic over measures and, averaged per text, weights of hashed words."""

    bias: float
    dense: np.ndarray
    hashed: np.ndarray

    def raw(self, texts: pa.Array) -> np.ndarray:
        words = split(texts, lower=True)
        h = words.hashes()
        x = _scaled(measures(words, h))
        upto = np.concatenate([[0], np.cumsum(self.hashed[(h % np.uint64(BUCKETS)).astype(np.int64)], dtype=np.float64)])
        n = np.maximum(np.diff(words.first), 1)
        return self.bias + x @ self.dense + (upto[words.first[1:]] - upto[words.first[:-1]]) / n

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts), -30, 30)))

    @staticmethod
    def fit(texts: list[str], target: np.ndarray, epochs: int = 12, seed: int = 3) -> Scorer:
        """Adaptive gradient steps on soft targets, in mini-batches, with decay."""
        x, bucket, counts = [], [], []
        for piece in pieces(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])):  # bounds the memory
            words = split(piece.column(0), lower=True)
            h = words.hashes()
            x.append(_scaled(measures(words, h)))
            bucket.append((h % np.uint64(BUCKETS)).astype(np.int32))
            counts.append(np.diff(words.first))
        x, bucket, n_words = np.concatenate(x), np.concatenate(bucket), np.concatenate(counts)
        first, n = np.concatenate([[0], np.cumsum(n_words)]), np.maximum(n_words, 1)
        rng = np.random.default_rng(seed)
        bias, dense, hashed = 0.0, np.zeros(x.shape[1]), np.zeros(BUCKETS)
        g_dense, g_hashed, g_bias = np.full(x.shape[1], 1e-3), np.full(BUCKETS, 1e-6), 1e-3
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 64)):
                at = [np.arange(first[r], first[r + 1]) for r in rows]
                own = np.concatenate(at) if at else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(rows)), [len(a) for a in at])
                b = bucket[own]
                z = bias + x[rows] @ dense + np.bincount(doc, hashed[b], len(rows)) / n[rows]
                err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[rows]
                gb, gd = err.mean(), x[rows].T @ err / len(rows) + 1e-5 * dense
                used, where = np.unique(b, return_inverse=True)
                gh = np.bincount(where, (err / n[rows])[doc], len(used)) / len(rows) + 1e-6 * hashed[used]
                g_bias, g_dense = g_bias + gb * gb, g_dense + gd * gd
                g_hashed[used] += gh * gh
                bias -= 0.2 * gb / np.sqrt(g_bias)
                dense -= 0.2 * gd / np.sqrt(g_dense)
                hashed[used] -= 0.2 * gh / np.sqrt(g_hashed[used])
        return Scorer(float(bias), dense, hashed)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, Scorer] | None:
    """The label model of all texts and a scorer from SAMPLE_ROWS of them, by least hash of the
    text among those of up to SAMPLE_BYTES bytes; None without any text."""
    patterns, counts = vote_counts(docs, text_col)
    if not counts.sum():
        return None
    model = LabelModel.fit(patterns, counts)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    share = min(1.0, 1.5 * SAMPLE_ROWS / counts.sum())
    some = docs.select(text.alias("t"), F.xxhash64(text).alias("h")).where((F.octet_length("t") <= SAMPLE_BYTES) & (F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000) + 1))
    texts = [r[0] for r in some.orderBy("h", "t").limit(SAMPLE_ROWS).collect()]
    if not texts:
        texts = [""]
    target = np.concatenate([model.posterior(_patterns(p.column(0))) for p in pieces(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"]))])
    return model, Scorer.fit(texts, target)


def scores(scorer: Scorer, text: Column) -> Column:
    held = SparkSession.active().sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [held.value.score(p.column(0)) for p in pieces(pa.RecordBatch.from_arrays([texts], ["t"]))]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(F.coalesce(text.cast("string"), F.lit("")))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher is better), keep (1 from `cut` on).

    No labels are read. Equal texts score alike; null and empty ones as a text without words.
    An empty table gives an empty result; other columns don't matter."""
    bounded_batches(docs.sparkSession)
    fitted = fit(docs, id_col, text_col)
    if fitted is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("keep"))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), scores(fitted[1], F.col(text_col)).alias("score"))
    return out.select("doc_id", "score", (F.col("score") >= cut).cast("int").alias("keep"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
