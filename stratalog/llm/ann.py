"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Vectors are lifted to unit length (which makes the largest inner product the smallest
angle) and coded by the signs of two rotations learned on a bounded sample. Blocks of the
index split each code into substrings and keep a table of each. A query probes the buckets
within radius // substrings of its own substring, which by the pigeonhole principle reaches
every code within the radius, and what it reaches is reranked on the original vectors.
Vectors are dealt to blocks by a random number, queries are sent to every block behind its
vectors, and a task builds a block's tables once and answers its queries as they stream by,
each with its nearest few, as arrays; those are merged."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import released, stored, table

#: Vectors that rotations and radius are learned from, at most, and queries among them that set the radius.
SAMPLE, PROBES = 20_000, 200
#: Share of the true neighbours in the sample within the radius.
TARGET = 0.98
#: Bits of a substring, and rotations, each of which gives a bit per dimension.
CHUNK, ROTATIONS = 16, 2
#: Vectors in a block of the index, about, and in one of a small table, which has up to 8 blocks.
INDEX_BLOCK, SMALL_BLOCK = 65_536, 4096
_ANSWER = "query long, query_id long, itself double, ids array<long>, scores array<double>"


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of vectors that take part: not null or zero, all components finite."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class Coder:
    """Rotations that turn a vector into packed sign bits, and the radius to search."""

    def __init__(self, sample: np.ndarray, top: float, k: int, rotations: int = ROTATIONS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.top = top
        x = self._lift(sample)
        self.mean = x.mean(0)
        x = x - self.mean
        dim = x.shape[1]
        _, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(dim))
        self.axes = []
        for _ in range(rotations):
            r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            p = x @ axes
            for _ in range(15):  # iterative quantisation: codes for the rotation, then the rotation for the codes
                u, _, vt = np.linalg.svd(np.sign(p @ r).T @ p)
                r = (u @ vt).T
            self.axes.append(axes @ r)
        self.bits = -(-dim * rotations // CHUNK) * CHUNK
        self.radius = self._radius(sample, k, rng)

    def _lift(self, v: np.ndarray) -> np.ndarray:
        v = v / self.top
        return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]], 1)

    def encode(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Rows of 16-bit substrings. A query has no component in the added dimension."""
        if query:
            x = np.concatenate([v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None], np.zeros((len(v), 1))], 1) - self.mean
        else:
            x = self._lift(v) - self.mean
        signs = np.concatenate([x @ a > 0 for a in self.axes], 1)
        padded = np.zeros((len(v), self.bits), bool)
        padded[:, : signs.shape[1]] = signs
        return np.packbits(padded, axis=1).view(np.uint16)

    def _radius(self, sample: np.ndarray, k: int, rng: np.random.Generator) -> int:
        """The least radius that holds TARGET of the sampled queries' k nearest."""
        if len(sample) <= k + 1:
            return self.bits
        q = rng.choice(len(sample), min(PROBES, len(sample)), replace=False)
        score = sample[q] @ sample.T
        score[np.arange(len(q)), q] = -np.inf
        near = np.argpartition(-score, k, 1)[:, :k]
        a, b = self.encode(sample[q], True), self.encode(sample)
        far = np.bitwise_count(a[:, None, :] ^ b[near]).sum(2)
        return int(np.quantile(far, TARGET, method="higher"))


class Index:
    """Codes of a block, with a table of buckets for each substring."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder):
        self.ids, self.vectors, self.coder = ids, vectors, coder
        self.codes = coder.encode(vectors)
        self.tables = []
        for j in range(self.codes.shape[1]):
            order = np.argsort(self.codes[:, j], kind="stable")
            values, first = np.unique(self.codes[order, j], return_index=True)
            self.tables.append((order, values, np.append(first, len(order))))

    def within(self, code: np.ndarray) -> np.ndarray:
        """The rows whose code is within the radius: one substring must be within its share."""
        m = self.codes.shape[1]
        share, spare = divmod(self.coder.radius, m)
        reached = np.zeros(len(self.ids), bool)
        for j, (order, values, first) in enumerate(self.tables):
            # with `spare` more, that many substrings plus one get the whole share, the others one less
            hit = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= (share if j <= spare else share - 1))
            size = first[hit + 1] - first[hit]
            reached[order[np.repeat(first[hit] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]] = True
        rows = np.flatnonzero(reached)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= self.coder.radius]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the k nearest rows of this block, the query's own among them."""
        codes = self.coder.encode(queries, True)
        for i, q, code in zip(ids.tolist(), queries, codes):
            rows = self.within(code)
            if len(rows) < k:  # too few so near: the whole block
                rows = np.arange(len(self.ids))
            score = self.vectors[rows] @ q
            if len(rows) > k:
                # all that tie with the k-th stay for the order by id
                least = -np.partition(-score, k - 1)[k - 1]
                some = np.flatnonzero(score >= least - 1e-9 * self.coder.top * np.linalg.norm(q))
                rows, score = rows[some], score[some]
            score = (self.vectors[rows] * q).sum(1)
            best = np.lexsort((self.ids[rows], -score))[:k]
            yield i, self.ids[rows[best]], score[best]


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20) -> DataFrame:
    """Rows query_id, rank (from 1), vec_id, score: each query's k nearest by inner product.

    Candidates are all vectors but the query's own row: of those with its id and score with
    itself, one. Nearest first, ties to the smaller id; fewer than k if there are no more. All rows
    are indexed; recall depends on TARGET. Vectors that are null, empty or zero, or hold null or
    non-finite components, and null ids, take no part on either side. An inner product needs equal
    lengths: vectors of each length are an index of their own, for queries of that length. Rows that
    repeat an id are separate candidates, and separate queries with an answer each. Empty tables
    give an empty result; other columns don't matter."""
    spark = vectors.sparkSession
    base = stored(valid_vectors(vectors, id_col, vec_col).where("id is not null"), "ann-base")
    asked = valid_vectors(queries, id_col, vec_col).where("id is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    asked = stored(asked.withColumn("query", F.monotonically_increasing_id()), "ann-queries")
    shapes = base.join(F.broadcast(asked.select(F.size("v").alias("dim")).distinct()), F.size("v") == F.col("dim")).groupBy("dim").agg(F.count("*").alias("rows"), F.max(norm).alias("top")).orderBy("dim").collect()  # a row per length
    found = [_search(base.where(F.size("v") == s["dim"]), asked.where(F.size("v") == s["dim"]), s["rows"], s["top"], k) for s in shapes]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hits = reduce(DataFrame.union, found)
    own = F.col("vec_id") == F.col("query_id")
    each = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "is_own")
    place = hits.withColumn("is_own", own & (F.col("score") == F.col("itself"))).withColumn("_place", F.row_number().over(each))
    first = F.min(F.when(F.col("is_own"), F.col("_place"))).over(W.partitionBy("query"))
    ranked = place.withColumn("_own", first).where("_own is null or _place != _own").withColumn("rank", (F.col("_place") - F.when(F.col("_place") > F.col("_own"), 1).otherwise(0)).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sample(base: DataFrame, rows: int) -> pa.Array:
    """At most SAMPLE vectors of base (id, v), those with the least hashes of the id. A share of the
    rows by hash, a little more than that, is all that is sorted."""
    share = min(1.0, 1.2 * SAMPLE / rows)
    some = base.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    found = some.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0)
    if not len(found):  # only where nearly all rows are copies of a few
        found = base.limit(SAMPLE).select("v").toArrow().column(0)
    return found.combine_chunks()


def _search(base: DataFrame, asked: DataFrame, rows: int, top: float, k: int) -> DataFrame:
    """(query, query_id, itself, vec_id, score): of each query (id, v, query) the k + 1 nearest of
    each block of base (id, v), `itself` being the query's score with itself."""
    spark = base.sparkSession
    sample = _sample(base, rows)
    model = spark.sparkContext.broadcast(Coder(_matrix(sample), float(top) * (1 + 1e-9), k))
    parts = max(-(-rows // INDEX_BLOCK), min(8, -(-rows // SMALL_BLOCK)))
    # by a random number, not the id: many rows may share one
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    indexed = stored(base.select(part.alias("part"), F.lit(None).cast("long").alias("query"), "id", "v"), "ann-index")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = indexed.unionByName(asked.select(every.alias("part"), "query", "id", "v")).repartitionById(parts, "part")
    # nulls come first: a block's vectors are all there before its first query
    hits = dealt.sortWithinPartitions("part", "query").mapInArrow(lambda it: released(_answers(it, model.value, k + 1)), _ANSWER)
    return hits.select("query", "query_id", "itself", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("h")).select("query", "query_id", "itself", "h.vec_id", "h.score")


def _answers(batches: Iterator[pa.RecordBatch], coder: Coder, k: int) -> Iterator[pa.RecordBatch]:
    """Answers to the queries among rows (part, query, id, v), which come by part, the part's vectors first."""
    part, ids, vectors, index = None, [], [], None
    for batch in batches:
        at = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows = batch.slice(lo, hi - lo)
            if at[lo] != part:
                part, ids, vectors, index = at[lo], [], [], None
            own = rows.column(1).null_count
            if own:
                ids.append(rows.column(2).slice(0, own).to_numpy())
                vectors.append(_matrix(rows.column(3).slice(0, own)))
            if own == len(at[lo:hi]) or not ids:
                continue
            index = index or Index(np.concatenate(ids), np.concatenate(vectors), coder)
            asked = rows.slice(own)
            queries = _matrix(asked.column(3))
            hits = list(index.search(asked.column(2).to_numpy(), queries, k))
            found = [pa.array([h[1] for h in hits], pa.list_(pa.int64())), pa.array([h[2] for h in hits], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([asked.column(1), asked.column(2), pa.array((queries * queries).sum(1)), *found], ["query", "query_id", "itself", "ids", "scores"])


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)
