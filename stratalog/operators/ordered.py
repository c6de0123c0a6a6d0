"""Ordered sets of integers: which inserts succeed, search, ordered keys, and tree shape."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_keys(inserts: DataFrame, key: str) -> DataFrame:
    """The set after all inserts; duplicates are refused, so the first of each stays."""
    return inserts.select(key).distinct()


def insert_outcomes(inserts: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """inserts with `inserted`: true for the first of each key in the given order, which must tell
    rows of a key apart. The least order of each key, aggregated ahead of the shuffle, is all
    that is moved; no task holds a key's rows."""
    at = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    first = inserts.groupBy(F.col(key).alias("_key")).agg(F.min(at).alias("_first"))
    marked = inserts.withColumn("_at", at).join(first, F.col(key).eqNullSafe(F.col("_key")))
    return marked.withColumn("inserted", F.col("_at") == F.col("_first")).drop("_key", "_at", "_first")


def search(probes: DataFrame, inserts: DataFrame, key: str) -> DataFrame:
    """The probes that are in the set."""
    return probes.join(inserts.select(key), key, "left_semi")


def sorted_keys(inserts: DataFrame, key: str) -> DataFrame:
    """Distinct keys ascending, over range partitions."""
    return distinct_keys(inserts, key).orderBy(key)


def range_keys(inserts: DataFrame, key: str, low: int, high: int) -> DataFrame:
    return distinct_keys(inserts.where(F.col(key).between(low, high)), key).orderBy(key)


class Tree:
    """A tree of minimum degree t, kept only to measure how insertion order shapes it.

    Nodes hold up to 2t - 1 keys; a full node is split on the way down. This is a driver-side
    fold over an ordered, small input: shape depends on the order of every single insert."""

    def __init__(self, t: int):
        if t < 2:
            raise ValueError("the minimum degree is 2 at least")
        self.t, self.size = t, 0
        self.root: list = [[], []]  # keys, children

    def _split(self, node: list, i: int) -> None:
        full = node[1][i]
        t = self.t
        right = [full[0][t:], full[1][t:]]
        node[0].insert(i, full[0][t - 1])
        node[1].insert(i + 1, right)
        full[0], full[1] = full[0][: t - 1], full[1][:t]

    def __contains__(self, key: int) -> bool:
        node = self.root
        while True:
            i = bisect_left(node[0], key)
            if i < len(node[0]) and node[0][i] == key:
                return True
            if not node[1]:
                return False
            node = node[1][i]

    def insert(self, key: int) -> bool:
        if key in self:
            return False
        most = 2 * self.t - 1
        if len(self.root[0]) == most:
            self.root = [[], [self.root]]
            self._split(self.root, 0)
        node = self.root
        while node[1]:
            i = bisect_left(node[0], key)
            if len(node[1][i][0]) == most:
                self._split(node, i)
                i += key > node[0][i]
            node = node[1][i]
        node[0].insert(bisect_left(node[0], key), key)
        self.size += 1
        return True

    def _nodes(self) -> Iterable[tuple[list, int]]:
        todo = [(self.root, 1)]
        while todo:
            node, depth = todo.pop()
            yield node, depth
            todo += [(c, depth + 1) for c in node[1]]

    def shape(self) -> dict[str, float]:
        nodes = list(self._nodes())
        return {"size": self.size, "height": max(d for _, d in nodes), "nodes": len(nodes), "fill": self.size / (len(nodes) * (2 * self.t - 1))}

    def keys(self) -> list[int]:
        return sorted(k for node, _ in self._nodes() for k in node[0])

    def validate(self) -> None:
        """Sorted keys, node sizes within bounds, a child more than keys, leaves at one depth, keys between their separators."""
        leaves = {d for n, d in self._nodes() if not n[1]}
        if len(leaves) > 1:
            raise ValueError("leaves at several depths")
        todo = [(self.root, None, None)]
        while todo:
            node, low, high = todo.pop()
            keys = node[0]
            if keys != sorted(set(keys)) or len(keys) > 2 * self.t - 1 or (node is not self.root and len(keys) < self.t - 1):
                raise ValueError("keys out of order, or too many or few")
            if (low is not None and keys and keys[0] <= low) or (high is not None and keys and keys[-1] >= high):
                raise ValueError("keys beyond their separators")
            if node[1]:
                if len(node[1]) != len(keys) + 1:
                    raise ValueError("children don't fit keys")
                bounds = [low, *keys, high]
                todo += [(c, bounds[i], bounds[i + 1]) for i, c in enumerate(node[1])]


def tree_shape(keys: Iterable[int], t: int) -> dict[str, float]:
    tree = Tree(t)
    for k in keys:
        tree.insert(k)
    tree.validate()
    return tree.shape()


def check_runs(runs: DataFrame, run: str, key: str) -> DataFrame:
    """Per run: entries, distinct keys, bounds, and whether it overlaps the run before it by bounds."""
    stats = runs.groupBy(run).agg(F.count("*").alias("entries"), F.count_distinct(key).alias("keys"), F.min(key).alias("low"), F.max(key).alias("high"))
    before = F.max("high").over(W.orderBy("low", run).rowsBetween(W.unboundedPreceding, -1))
    return stats.withColumn("unique", F.col("entries") == F.col("keys")).withColumn("overlaps", F.coalesce(before >= F.col("low"), F.lit(False)))
