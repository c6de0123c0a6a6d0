"""Benchmark decontamination: size-partitioned MinHash containment search.

Items of a few shingles are looked up by so many of them that a text which contains the item
has one at least. Other items fall into classes by size, a power of two. For a class of size s a document is a row
of windows of 2s shingles, s apart, so that a passage of an item lies whole in some window
of about its size, however long the document: there containment becomes a resemblance that
a signature finds. An item and a window that share any of the signature's minima are a
candidate, which the exact share of the item's shingles in the whole document decides.
A benchmark of one block of items is broadcast, and documents are neither joined nor moved. Of a
larger one block after block is broadcast to a pass of its own, which stores what it finds, so
that no executor holds more than a block; what was found is joined to the documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, fresh, released, stored, table
from .words import Words, grams, pieces, shingle_sets, split

#: Words of a shingle and the share of an item's shingles that counts as contained.
K, CONTAINED = 5, 0.8
#: Minima of a signature. An item of more than half its class's size of which 0.8 is in a window
#: resembles it by at least 0.19, so it goes unseen with probability 0.81 ** 64, about one in a million.
MINIMA = 64
#: Items and bytes of their texts that are broadcast at once, about.
ITEM_BLOCK, ITEM_BYTES = 20_000, 1 << 25
#: The smallest size class; items of up to half of that are looked up exactly.
LEAST = 8
#: Parts to which the rows of a text are dealt in a join that isn't a broadcast.
SALTS = 32
_U = np.uint64
_A = np.random.default_rng(5).integers(1, 2**62, MINIMA, dtype=np.uint64) * _U(2) + _U(1)
#: Words are runs of ASCII letters and digits, in lower case, and of what is beyond ASCII.
NO_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


class Items:
    """Shingle sets of a block of items, and their minima by size class."""

    def __init__(self, ids: list[int], texts: list[str], k: int, contained: float = CONTAINED):
        words = split(pa.array(texts, pa.string()), NO_WORD, lower=True)
        self.k, self.ids = k, ids
        sets, at = shingle_sets(words, k)
        count = np.diff(words.first)
        self.sets = [sets[a:b] for a, b in zip(at[:-1], at[1:])]
        self.short: dict[int, dict[int, list[int]]] = {}
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_size: dict[int, list[int]] = {}
        few: list[int] = []
        for i, n in enumerate(count.tolist()):
            if 0 < n < k:
                one = Words(words.buf, words.start[words.first[i] : words.first[i + 1]], words.end[words.first[i] : words.first[i + 1]], np.array([0, n]))
                self.short.setdefault(n, {}).setdefault(int(grams(one.hashes(), one.first, n)[0][0]), []).append(i)
            elif n and len(self.sets[i]) * 2 <= LEAST:
                few.append(i)
            elif n:
                by_size.setdefault(1 << (len(self.sets[i]) - 1).bit_length(), []).append(i)
        self.keys, self.key_rows = self._keys(few, contained)
        for size, rows in by_size.items():
            minima = np.array([[(self.sets[i] * a).min() for a in _A] for i in rows], np.uint64)
            rows_ = np.array(rows)
            self.classes[size] = [(minima[o, j], rows_[o]) for j in range(MINIMA) for o in [np.argsort(minima[:, j], kind="stable")]]

    def _keys(self, few: list[int], contained: float) -> tuple[np.ndarray, np.ndarray]:
        """Shingles to look these items up by, sorted, and their items.

        Of n shingles of which m must be found any n - m + 1 will do: those that fewest items have."""
        if not few:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        seen, counts = np.unique(np.concatenate([self.sets[i] for i in few]), return_counts=True)
        keys, rows = [], []
        for i in few:
            own, n = self.sets[i], len(self.sets[i])
            need = next((m for m in range(1, n) if m / n >= contained), n)
            keys.append(own[np.argsort(counts[np.searchsorted(seen, own)], kind="stable")[: n - need + 1]])
            rows += [i] * (n - need + 1)
        all_keys = np.concatenate(keys)
        order = np.argsort(all_keys, kind="stable")
        return all_keys[order], np.array(rows)[order]

    def found(self, words: Words, contained: float) -> list[list[tuple[int, float]]]:
        """Of each text the items it contains, with the share of their shingles, by item id."""
        h = words.hashes()
        g, at = grams(h, words.first, self.k)
        pairs: set[tuple[int, int]] = set()
        n = np.diff(at)
        for size, by_minimum in self.classes.items():
            blocks = -(-n // size)
            first = np.cumsum(blocks) - blocks
            owner = np.repeat(np.arange(words.texts), blocks)
            begin = at[:-1][owner] + (np.arange(int(blocks.sum())) - first[owner]) * size
            if not len(begin):
                continue
            joined = np.flatnonzero(owner[1:] == owner[:-1])
            for j, (minima, rows) in enumerate(by_minimum):
                low = np.minimum.reduceat(g * _A[j], begin)
                window = low.copy()
                window[joined] = np.minimum(low[joined], low[joined + 1])
                lo, hi = np.searchsorted(minima, window, "left"), np.searchsorted(minima, window, "right")
                for w in np.flatnonzero(hi > lo).tolist():
                    pairs.update((int(owner[w]), int(r)) for r in rows[lo[w] : hi[w]])
        if len(self.keys):
            lo = np.searchsorted(self.keys, g, "left")
            hit = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == g)
            hi = np.searchsorted(self.keys, g[hit], "right")
            for w, d, b in zip(hit.tolist(), (np.searchsorted(at, hit, "right") - 1).tolist(), hi.tolist()):
                pairs.update((d, int(r)) for r in self.key_rows[lo[w] : b])
        out: list[dict[int, float]] = [{} for _ in range(words.texts)]
        own, own_set = -1, None
        for d, i in sorted(pairs):
            if d != own:
                own, own_set = d, np.sort(g[at[d] : at[d + 1]])
            item = self.sets[i]
            where = np.minimum(np.searchsorted(own_set, item), len(own_set) - 1)
            share = float(np.count_nonzero(own_set[where] == item)) / len(item)
            if share >= contained:
                out[d][i] = share
        for size, items in self.short.items():
            s, s_at = grams(h, words.first, size)
            hit = np.flatnonzero(np.isin(s, np.fromiter(items, np.uint64, len(items))))
            for w, d in zip(hit.tolist(), (np.searchsorted(s_at, hit, "right") - 1).tolist()):
                out[d].update(dict.fromkeys(items[int(s[w])], 1.0))
        return [sorted((self.ids[i], share) for i, share in x.items()) for x in out]


_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())]))


def _finder(known: Broadcast, contained: float) -> Callable[[Column], Column]:
    @F.arrow_udf("array<struct<item_id:bigint,share:double>>")
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(batches):
            found = []
            for piece in pieces(pa.RecordBatch.from_arrays([texts], ["t"])):
                found += known.value.found(split(piece.column(0), NO_WORD, lower=True), contained)
            yield pa.array([[{"item_id": i, "share": s} for i, s in x] for x in found], _HITS)

    return hits


def with_hits(docs: DataFrame, name: str, benchmark: DataFrame, text_col: str = "text", k: int = K, contained: float = CONTAINED) -> DataFrame:
    """docs with a column `name`, array<struct<item_id, share>>: the items that the row's text contains.

    Texts of passes are told apart by two 64-bit hashes, of the text and of its reverse."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // ITEM_BLOCK), -(-size // ITEM_BYTES))

    def block(b: int) -> Broadcast:
        part = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        return spark.sparkContext.broadcast(Items(part.column(0).to_pylist(), part.column(1).to_pylist(), k, contained))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if blocks == 1:
        return docs.withColumn(name, _finder(block(0), contained)(text))
    key = fresh(docs.select("*", F.lit(0).alias(name)), "print", "reverse", "salt")
    keyed = docs.withColumns({key[0]: F.xxhash64(text), key[1]: F.xxhash64(F.reverse(text))})
    passes = []
    for b in range(blocks):
        known = block(b)
        passes.append(stored(keyed.select(*key[:2], F.explode(_finder(known, contained)(text)).alias(name)).distinct(), "benchmark-hits"))
        known.unpersist()
    found = reduce(DataFrame.union, passes)
    hits = found.groupBy(*key[:2]).agg(F.collect_list(name).alias(name))
    if found.count() <= BROADCAST_ROWS:
        out = keyed.join(F.broadcast(hits), key[:2], "left")
    else:  # a text may have any number of copies
        salted = keyed.withColumn(key[2], F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        out = salted.join(hits.withColumn(key[2], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), key, "left")
    return out.select(*docs.columns, F.coalesce(name, F.array().cast("array<struct<item_id:bigint,share:double>>")).alias(name))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, contained: float = CONTAINED) -> DataFrame:
    """One row per row of docs: doc_id, n_items, item_ids (ascending), share (largest), contaminated.

    An item is contained if at least `contained` of its distinct k-word shingles are in the
    document; one of fewer than k words if these stand in a row. Null and empty texts contain
    nothing (share 0); items that are null, without id or without words match nothing. An
    empty benchmark marks nothing, an empty table gives no rows; other columns don't matter."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hits = with_hits(own, "h", benchmark, k=k, contained=contained)
    share = F.coalesce(F.array_max(F.col("h.share")), F.lit(0.0))
    return hits.select("doc_id", F.size("h").cast("long").alias("n_items"), F.array_sort(F.col("h.item_id")).alias("item_ids"), share.alias("share"), (F.size("h") > 0).alias("contaminated"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


OP7_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
k as (select item_id, w, least(5, len(w)) as k from b where len(w) > 0),
i as (select distinct item_id, k, array_to_string(w[j : j + k - 1], ' ') as g from (select *, unnest(range(1, len(w) - k + 2)) as j from k)),
n as (select item_id, count(*) as n from i group by item_id),
g as (select distinct r, k, array_to_string(w[j : j + k - 1], ' ') as g from (select r, w, k, unnest(range(1, len(w) - k + 2)) as j from d, (select distinct k from i))),
c as (select r, item_id, count(*)::double / any_value(n) as share from g join i using (k, g) join n using (item_id) group by r, item_id),
h as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id) as item_ids, max(share) as share from c where share >= 0.8 group by r)
select doc_id, coalesce(n_items, 0)::bigint as n_items, coalesce(item_ids, '') as item_ids, coalesce(share, 0)::double as share, n_items is not null as contaminated from d left join h using (r)
"""
