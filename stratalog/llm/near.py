"""MinHash near-dedup as a chosen-path similarity join.

Texts with equal shingle sets are one class. Every class walks down independent trees: a
node chooses positions of the minwise signature, and a class goes to the child named by its
token there, so similar classes tend to meet. Classes that meet in a small node have their bit
sketches compared exhaustively; those that may be similar are a cluster, whose members are
compared on full shingle sets, exactly. What comes out is a spanning forest of verified links,
never pairs, and the components of all forests so far are the labels of the classes.

Trees are taken in batches, the first small. Members of a node that have one label need no
comparison there and a node of one label is done, so later trees look only for what earlier ones
missed, and a group of any size leaves the trees once it is connected. A node too large to be
compared exhaustively first compares its members with a few of them, its pivots. If all but a few
members then have one label, blocks of those are compared with the few others, which is complete;
else the node branches. After LEVELS levels a node is compared exhaustively, block by block.

A link at the threshold is missed by all R trees with probability (1 - s)**R if s is its
chance to meet in a small node of one tree: 0.8 where the root's children are small, about
0.5 where many levels are needed; that is below 2e-5 for 16 trees that share no tokens. Below the
roots trees draw from common tokens, which makes them less independent; on 10,000 documents
with groups of up to thousands no link was missed (tests/llm). The sketch loses a link at the
threshold with probability below 1e-5.

Of each round only clusters' members have their texts read again for their sets, once a class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, maybe_broadcast, released, stored, table
from .words import mix, pieces, shingle_sets, split

TREES, TOKENS, SKETCH = 16, 128, 128
#: Trees of each batch.
BATCHES = (4, 12)
#: Bits of each minimum in the sketch, and its bytes.
BITS, SKETCH_BYTES = 2, 32
#: Children of a class at a level, in turn. Their mean of 1.26 is above 1 / 0.8, so links at the
#: threshold don't die out from level to level, and below 1 / 0.75, so nodes of less similar texts do.
BRANCH = (2, 1, 1)
#: Members up to which a node is compared exhaustively; pivots of a larger one; levels that branch.
SMALL, PIVOTS, LEVELS = 4096, 4, 12
#: Members and shingles of a block of a cluster.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
_U = np.uint64
_ODD = _U(0x5555555555555555)
_A = np.random.default_rng(99).integers(1, 2**62, SKETCH, dtype=np.uint64) * _U(2) + _U(1)
#: Stands for a null id: larger than any that names a component.
NULL_ID = (1 << 63) - 1
_SIG = "id long, print long, n long, d1 long, d2 long, sketch binary, tokens binary"
_MEMBER = "node long, cls long, n long, sketch binary"
_CLUSTER = "cluster long, cls long, label long, n long, sketch binary"
_EDGE = "a long, b long"


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            g, at = shingle_sets(split(piece.column(0), lower=True), k)
            n = np.diff(at)
            full = np.flatnonzero(n)
            rows = len(n)
            low = np.zeros((rows, SKETCH), np.uint64)
            d = np.zeros((2, rows), np.uint64)
            if len(full):
                begin = at[full]
                for j in range(SKETCH):
                    low[full, j] = np.minimum.reduceat(g * _A[j], begin)
                d[0, full] = np.add.reduceat(mix(g + _U(1)), begin)
                d[1, full] = np.add.reduceat(mix(g ^ _U(0x5851F42D4C957F2D)), begin)
            low = mix(low)
            bits = np.stack([low >> _U(17) & _U(1), low >> _U(18) & _U(1)], 2).reshape(rows, -1).astype(np.uint8)
            sketch = np.packbits(bits, axis=1)
            tokens = (low[:, :TOKENS] >> _U(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [piece.column(1), piece.column(2), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in d), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array([x.tobytes() for x in tokens], pa.binary())],
                ["id", "print", "n", "d1", "d2", "sketch", "tokens"],
            )


def _fixed(column: pa.Array, dtype: type) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _placed(node: np.ndarray, batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
    """A row of each node of each row, with the columns from `first` on."""
    row = pa.array(np.repeat(np.arange(batch.num_rows), node.shape[1]))
    rest = batch.schema.names[first:]
    return pa.RecordBatch.from_arrays([pa.array(node.reshape(-1).view(np.int64)), *(batch.column(i).take(row) for i in range(first, batch.num_columns))], ["node", *rest])


def _roots(batches: Iterator[pa.RecordBatch], trees: range) -> Iterator[pa.RecordBatch]:
    """A row of each (tokens, cls, n, sketch) and tree: the node below the root."""
    where = np.array(trees) * (TOKENS // TREES)
    for batch in batches:
        if batch.num_rows:
            tokens = _fixed(batch.column(0), np.uint32)
            yield _placed(mix(mix(tokens[:, where].astype(np.uint64) + _U(1)) + mix(where.astype(np.uint64) + _U(77))), batch, 1)


def _children(batches: Iterator[pa.RecordBatch], branch: int) -> Iterator[pa.RecordBatch]:
    """`branch` rows of each (tokens, node, cls, n, sketch): the node chooses the positions."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = _fixed(batch.column(0), np.uint32)
        parent = batch.column(1).to_numpy().view(np.uint64)
        node = np.empty((len(parent), branch), np.uint64)
        for j in range(branch):
            at = (mix(parent + _U(1000 + j)) % _U(TOKENS)).astype(np.int64)
            node[:, j] = mix(parent * _U(3) + mix(tokens[np.arange(len(parent)), at].astype(np.uint64) + _U(1)) + mix(at.astype(np.uint64)))
        yield _placed(node, batch, 2)


def most_apart(percent: int) -> int:
    """Minima in which sketches of a link may differ: 4.5 deviations beyond the mean at the threshold."""
    p = (1 - percent / 100) * (1 - 0.5**BITS)
    return int(SKETCH * p + 4.5 * (SKETCH * p * (1 - p)) ** 0.5) + 1


def _maybe(n: np.ndarray, sketch: np.ndarray, i: slice, percent: int) -> np.ndarray:
    """Which pairs of rows i with all rows may be similar enough, by size and sketch."""
    apart = np.zeros((len(n[i]), len(n)), np.uint16)
    for w in range(sketch.shape[1]):
        x = sketch[i, w][:, None] ^ sketch[:, w]
        apart += np.bitwise_count((x | x >> _U(1)) & _ODD)
    small, large = np.minimum(n[i][:, None], n), np.maximum(n[i][:, None], n)
    return (apart <= most_apart(percent)) & (small * 100 >= large * percent)


class _Forest:
    """Union-find over rows 0..n-1 that remembers the edges that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))

    def stars(self, cls: np.ndarray, label: np.ndarray) -> tuple[list[int], list[int]]:
        """Edges that connect the labels within each tree, from its least class: from many nodes
        with the same members come the same edges."""
        least: dict[tuple[int, int], int] = {}
        for i, (c, x) in enumerate(zip(cls.tolist(), label.tolist())):
            key = (self.find(i), x)
            least[key] = min(least.get(key, c), c)
        center: dict[int, int] = {}
        for (root, _), c in least.items():
            center[root] = min(center.get(root, c), c)
        found = [(center[root], c) for (root, _), c in least.items() if c != center[root]]
        return [x for x, _ in found], [y for _, y in found]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each value of column 0, which come together, as one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        if held and held[0].column(0)[0].as_py() != int(key[0]):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)]).combine_chunks().to_batches()[0] if held else batch.slice(a, b - a)
            held = []
        held.append(batch.slice(cuts[-2]))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _edges_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _cluster_rows(cluster: np.ndarray, at: np.ndarray, group: pa.RecordBatch) -> pa.RecordBatch:
    """Rows `at` of (_, cls, n, sketch, label) in their clusters."""
    cls, n, sketch, label = (group.column(i).take(pa.array(at)) for i in (1, 2, 3, 4))
    return pa.RecordBatch.from_arrays([pa.array(cluster.view(np.int64)), cls, label, n, sketch], ["cluster", "cls", "label", "n", "sketch"])


def _clusters(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each task's rows (task, cls, n, sketch, label) those that may be similar to one of another
    label, as the connected clusters they make. Equal clusters of several nodes have equal names."""
    for group in _groups(batches):
        cls, n, label = (group.column(i).to_numpy() for i in (1, 2, 4))
        if len(cls) < 2 or (label == label[0]).all():
            continue
        sketch = _fixed(group.column(3), np.uint64)
        near = np.zeros((len(cls), len(cls)), bool)
        for lo in range(0, len(cls), 256):
            i = slice(lo, lo + 256)
            near[i] = _maybe(n, sketch, i, percent) & (label[i][:, None] != label)
        left = near.any(1)
        names, rows = [], []
        while left.any():
            seen = np.zeros(len(cls), bool)
            front = np.array([int(np.argmax(left))])
            while len(front):
                seen[front] = True
                front = np.flatnonzero(near[front].any(0) & ~seen)
            left &= ~seen
            at = np.flatnonzero(seen)
            name = mix(np.add.reduce(mix(cls[at].astype(np.uint64) + _U(5)), keepdims=True))
            names.append(np.repeat(name, len(at)))
            rows.append(at)
        if rows:
            yield _cluster_rows(np.concatenate(names), np.concatenate(rows), group)


def _stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Clusters of the members of large nodes that may be similar to a pivot of another label, from
    rows (node, cls, n, sketch, label, parts, pivots): a member goes to its nearest such pivot, a
    pivot to all; a pivot's members are dealt to as many clusters as the node has parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each = batch.column(6)
        row = np.repeat(np.arange(batch.num_rows), np.diff(each.offsets.to_numpy()))
        cls, n, label, parts = (batch.column(i).to_numpy() for i in (1, 2, 4, 5))
        p_cls, p_n, p_sketch, p_label = each.flatten().flatten()
        sketch = _fixed(batch.column(3), np.uint64)
        x = _fixed(p_sketch, np.uint64) ^ sketch[row]
        apart = np.bitwise_count((x | x >> _U(1)) & _ODD).sum(1)
        p, size = p_cls.to_numpy(), p_n.to_numpy()
        maybe = (apart <= most_apart(percent)) & (np.minimum(size, n[row]) * 100 >= np.maximum(size, n[row]) * percent) & (p_label.to_numpy() != label[row])
        is_pivot = np.zeros(batch.num_rows, bool)
        is_pivot[row[p == cls[row]]] = True
        found = np.flatnonzero(maybe)
        found = found[np.lexsort((p[found], apart[found], row[found]))]
        nearest = np.ones(len(found), bool)
        nearest[1:] = row[found][1:] != row[found][:-1]
        found = found[nearest | is_pivot[row[found]]]
        own = row[found]
        cluster = mix(mix(p[found].astype(np.uint64)) + mix(parts[own].astype(np.uint64)) * _U(3) + mix(cls[own].astype(np.uint64)) % parts[own].astype(np.uint64))
        yield _cluster_rows(cluster, own, batch)
        _, once = np.unique(cluster, return_index=True)
        at = pa.array(found[once])
        columns = [pa.array(cluster[once].view(np.int64)), *(c.take(at) for c in (p_cls, p_label, p_n, p_sketch))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "cls", "label", "n", "sketch"])


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each task's rows (task, cls, label, n, sketch, set) a spanning forest of the links that
    connect labels."""
    a, b = [], []
    for group in _groups(batches):
        if group.num_rows < 2:
            continue
        cls, label, n = (group.column(i).to_numpy() for i in (1, 2, 3))
        sketch = _fixed(group.column(4), np.uint64)
        forest = _linked(n, sketch, [np.frombuffer(x, np.uint64) for x in group.column(5).to_pylist()], percent, label)
        if forest.edges:
            more = forest.stars(cls, label)
            a += more[0]
            b += more[1]
        if len(a) > 10_000:
            yield _edges_batch(a, b)
            a, b = [], []
    yield _edges_batch(a, b)


def _linked(n: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> _Forest:
    """The links among sets of different labels, exactly: one by one where sketches leave few pairs,
    else by matrix products. Equal labels count as joined."""
    size = len(n)
    forest = _Forest(size)
    label = np.arange(size) if label is None else label
    first: dict[int, int] = {}
    for i, x in enumerate(label.tolist()):
        forest.join(first.setdefault(x, i), i)
    forest.edges = []
    maybe = np.zeros((size, size), bool)
    for lo in range(0, size, 256):
        i = slice(lo, lo + 256)
        maybe[i] = _maybe(n, sketch, i, percent) & (np.arange(size) > np.arange(size)[i][:, None]) & (label[i][:, None] != label)
    if int(maybe.sum()) <= 8 * size:
        rows, cols = np.nonzero(maybe)
        for x, y in zip(rows.tolist(), cols.tolist()):
            if forest.find(x) != forest.find(y):
                both = np.sort(np.concatenate([sets[x], sets[y]]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    forest.join(x, y)
        return forest
    owner = np.repeat(np.arange(size), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    shared = np.zeros(len(flat), bool)  # shingles of one set alone make no intersection
    shared[:-1] = ~new[1:]
    shared |= ~new
    column, owner = (np.cumsum(new) - 1)[shared], owner[shared]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    common = np.zeros((size, size), np.float32)
    width = 2048
    bounds = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for x, y in zip(bounds[:-1], bounds[1:]):
        if y > x:
            part = np.zeros((size, width), np.float32)
            part[owner[x:y], column[x:y] % width] = 1
            common += part @ part.T
    for lo in range(0, size, 256):
        i = slice(lo, lo + 256)
        c = np.rint(common[i]).astype(np.int64)
        maybe[i] &= 100 * c >= percent * (n[i][:, None] + n - c)
    maybe |= maybe.T
    left = maybe.any(1)
    while left.any():
        front = np.array([int(np.argmax(left))])
        left[front] = False
        while len(front):  # breadth first: each row is joined to one that reached it
            reached = np.flatnonzero(maybe[front].any(0) & left)
            for y, x in zip(reached.tolist(), front[np.argmax(maybe[front][:, reached], 0)].tolist() if len(reached) else []):
                forest.join(x, y)
            left[reached] = False
            front = reached
    return forest


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(cls, set) of (text, cls)."""
    for batch in batches:
        for piece in pieces(batch):
            g, at = shingle_sets(split(piece.column(0), lower=True), k)
            raw = g.tobytes()
            yield pa.RecordBatch.from_arrays([piece.column(1), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], ["cls", "set"])


def components(links: DataFrame) -> DataFrame:
    """(cls, label) of every class with a link: label is the smallest class of its component.

    Each round takes the least label among neighbours and then the label of that label, which
    halves distances; it stops when no label changes. State is a table each round."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("_near"))
        hooked = labels.join(near, "cls").select("cls", F.col("label").alias("_old"), F.least("label", "_near").alias("_hook"))
        jump = labels.select(F.col("cls").alias("_hook"), F.col("label").alias("_jump"))
        new = stored(hooked.join(jump, "_hook", "left").select("cls", "_old", F.least("_hook", "_jump").alias("label")), "labels")
        if not new.where("label != _old").limit(1).count():
            return new.select("cls", "label")
        labels = new.select("cls", "label")


class _Labels:
    """The label of every class, from the links found so far: the smallest class of its component.
    Classes without a link are their own label and not in the table."""

    def __init__(self) -> None:
        self.known: DataFrame | None = None
        self.rows = 0

    def grow(self, found: DataFrame) -> bool:
        """Take in links (a, b), stored. Their ends' labels are the nodes of a small graph."""
        if not found.limit(1).count():
            return False
        if self.known is None:
            self.known = components(found)
        else:
            of = maybe_broadcast(self.known.select(F.col("cls").alias("_end"), F.col("label").alias("_of")), self.rows)
            ends = found.join(of, F.col("a") == F.col("_end"), "left").select(F.coalesce("_of", "a").alias("a"), F.col("b").alias("_b"))
            ends = ends.join(of, F.col("_b") == F.col("_end"), "left").select("a", F.coalesce("_of", "_b").alias("b")).where("a != b").distinct()
            merged = components(stored(ends, "near-ends")).select(F.col("cls").alias("_was"), F.col("label").alias("_is"))
            moved = maybe_broadcast(merged, merged.count())
            old = self.known.join(moved, F.col("label") == F.col("_was"), "left").select("cls", F.coalesce("_is", "label").alias("label"))
            new = merged.join(self.known, F.col("_was") == F.col("cls"), "left_anti").select(F.col("_was").alias("cls"), F.col("_is").alias("label"))
            self.known = stored(old.unionByName(new), "near-labels")
        self.rows = self.known.count()
        return True

    def of(self, df: DataFrame) -> DataFrame:
        """df (with cls) with the label of each class."""
        if self.known is None:
            return df.withColumn("label", F.col("cls"))
        return df.drop("label").join(maybe_broadcast(self.known, self.rows), "cls", "left").withColumn("label", F.coalesce("label", "cls"))


class _Sets:
    """The shingle sets of classes, read from their texts when first asked for."""

    def __init__(self, own: DataFrame, classes: DataFrame, k: int):
        self.own, self.classes, self.k = own, classes, k
        self.held: DataFrame | None = None

    def of(self, wanted: DataFrame) -> DataFrame:
        """(cls, set) of at least the classes in wanted (cls)."""
        new = wanted.distinct() if self.held is None else wanted.distinct().join(self.held.select("cls"), "cls", "left_anti")
        new = stored(self.classes.select("cls", "id", "print").join(new, "cls", "left_semi"), "near-wanted")
        many = new.count()
        if many:
            texts = self.own.join(maybe_broadcast(new, many), ["id", "print"]).select("text", "cls")
            k = self.k
            sets = stored(texts.mapInArrow(lambda it: released(_sets(it, k)), "cls long, set binary"), "near-sets")
            if sets.count() != many:  # rows that repeat an id and its text come more than once
                sets = stored(sets.groupBy("cls").agg(F.first("set").alias("set")), "near-sets")
            self.held = sets if self.held is None else self.held.unionByName(sets)
        return self.held


def verified(clusters: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked within each cluster (cluster, cls, label, n, sketch).

    A cluster within the bounds of a block is one task. A larger one is cut to blocks by hash,
    and each two blocks, and each with itself, are a task. Only narrow rows are dealt to tasks;
    sets are joined to them after that."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    sizes = clusters.groupBy("cluster").agg(blocks.alias("_blocks"), F.count("*").alias("_rows"))
    rows = sizes.agg(F.sum(F.col("_blocks") * F.col("_rows"))).first()[0]
    own = F.pmod(F.xxhash64("cls"), F.col("_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    dealt = clusters.join(sizes, "cluster").withColumn("_own", own).withColumn("_other", other)
    task = F.xxhash64("cluster", F.least("_own", "_other"), F.greatest("_own", "_other"))
    dealt = dealt.select(task.alias("task"), "cls", "label", "n", "sketch")
    full = sets.of(clusters.select("cls")).join(maybe_broadcast(dealt, rows), "cls")
    tasks = full.select("task", "cls", "label", "n", "sketch", "set").repartition("task").sortWithinPartitions("task")
    return stored(tasks.mapInArrow(lambda it: released(_block_links(it, percent)), _EDGE), "near-links")


def link_labels(classes: DataFrame, sets: _Sets, percent: int) -> DataFrame | None:
    """(cls, label) of every class that has a link; label is the smallest class of its component.
    None if there is no link. classes: cls, n, sketch, tokens."""
    labels = _Labels()
    for i, trees in enumerate(BATCHES):
        first = sum(BATCHES[:i])
        _walk(classes, range(first, first + trees), labels, sets, percent)
    return labels.known


def _walk(classes: DataFrame, trees: range, labels: _Labels, sets: _Sets, percent: int) -> None:
    """Take all classes down the trees, level by level, and bring labels up to date with the links found."""
    member = ["node", "cls", "n", "sketch", "label"]
    members = labels.of(classes.select("tokens", "cls", "n", "sketch").mapInArrow(lambda it: _roots(it, trees), _MEMBER))
    for level in range(1, LEVELS + 1):
        members = members.select(*member)
        mixed = members.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo != _hi").select("node", "size")
        nodes = stored(members.join(mixed, "node"), "near-nodes")
        small = nodes.where(F.col("size") <= SMALL).select(F.col("node").alias("task"), "cls", "n", "sketch", "label")
        large = nodes.where(F.col("size") > SMALL)
        branches = False
        if large.limit(1).count():
            large = stored(_planned(large, level), "near-large")
            own, parts = F.pmod(F.xxhash64("cls"), F.col("parts")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
            few = F.col("others") <= SMALL
            dealt = large.where(few).withColumn("_part", F.explode(F.when(F.col("label") == F.col("top"), F.array(own)).otherwise(parts)))
            small = small.unionByName(dealt.select(F.xxhash64("node", "_part").alias("task"), *member[1:]))
            branching = large.where(~few)
            branches = bool(branching.limit(1).count())
            if level == LEVELS:
                dealt = branching.withColumn("_own", own).withColumn("_part", F.explode(parts))
                task = F.xxhash64("node", F.least("_own", "_part"), F.greatest("_own", "_part"))
                small = small.unionByName(dealt.select(task.alias("task"), *member[1:]))
        clusters = small.repartition("task").sortWithinPartitions("task").mapInArrow(lambda it: released(_clusters(it, percent)), _CLUSTER)
        if branches and level < LEVELS:
            clusters = clusters.unionByName(branching.select(*member, "parts", "pivots").mapInArrow(lambda it: released(_stars(it, percent)), _CLUSTER))
        clusters = stored(clusters.groupBy("cluster", "cls").agg(*[F.first(c).alias(c) for c in ("label", "n", "sketch")]), "near-clusters")
        if clusters.limit(1).count():
            labels.grow(verified(clusters, sets, percent))
        if not branches or level == LEVELS:
            return
        rest = labels.of(branching.select(*member))
        tops = _tops(rest).where("others > 0").select("node", (F.col("others") <= SMALL).alias("_stays"))
        rest = stored(rest.join(tops, "node"), "near-rest")
        if not rest.limit(1).count():
            return
        branch = BRANCH[(level - 1) % len(BRANCH)]
        below = rest.where("not _stays").select("node", "cls", "n", "sketch").join(classes.select("cls", "tokens"), "cls").select("tokens", "node", "cls", "n", "sketch")
        members = labels.of(below.mapInArrow(lambda it, branch=branch: _children(it, branch), _MEMBER)).select(*member).unionByName(rest.where("_stays").select(*member))


def _tops(members: DataFrame) -> DataFrame:
    """(node, top, others, parts) of each node: its commonest label, how many members have another,
    and the number of blocks it is cut to."""
    counts = members.groupBy("node", "label").agg(F.count("*").alias("_n"))
    tops = counts.groupBy("node").agg(F.max(F.struct("_n", "label")).alias("_top"), F.sum("_n").alias("_size"))
    return tops.select("node", F.col("_top.label").alias("top"), (F.col("_size") - F.col("_top._n")).alias("others"), F.ceil(F.col("_size") / SMALL).cast("long").alias("parts"))


def _planned(large: DataFrame, level: int) -> DataFrame:
    """Members of large nodes with _tops() and the pivots of their node, an array."""
    q = F.pmod(F.xxhash64("cls", F.lit(level)), F.lit(PIVOTS))
    one = F.min(F.struct(F.xxhash64("cls", F.lit(-level)).alias("_h"), F.struct("cls", "n", "sketch", "label").alias("_p"))).alias("_p")
    pivots = large.groupBy("node", q.alias("_q")).agg(one).groupBy("node").agg(F.collect_list("_p._p").alias("pivots"))
    return large.drop("size").join(_tops(large).join(pivots, "node"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts are linked where 100 * intersection >= percent * union of their sets of k-word
    shingles (A-Z in lower case). component_id is the smallest doc_id of those reachable by
    links, kept whether the row has it. A text of fewer than k words has its whole sequence
    as its one shingle; a null or empty text has none, is linked with nothing and kept. Rows
    with equal ids are separate texts with one id. Null ids are linked like others but name a
    component only among themselves. An empty table gives an empty result."""
    out = _components_of(docs, id_col, text_col, k, percent)
    plain = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(plain("id").alias("doc_id"), F.col("n").alias("n_shingles"), plain("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with their columns, that near_duplicates() keeps."""
    key, print_ = fresh(docs, "id", "print")
    gone = stored(_components_of(docs, id_col, text_col, k, percent).where("id != component").select(F.col("id").alias(key), F.col("print").alias(print_)).distinct(), "near-gone")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), print_: F.xxhash64(text)})
    return keyed.join(maybe_broadcast(gone, gone.count()), [key, print_], "left_anti").select(*docs.columns)


def _components_of(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, print of the text, shingles, component) of each row; NULL_ID stands for null."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("print"))
    rows = stored(own.mapInArrow(lambda it: released(_signatures(it, k)), _SIG), "near-rows")
    grouped = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.min_by("print", "id").alias("print"), F.first("sketch").alias("sketch"), F.first("tokens").alias("tokens"))
    classes = stored(grouped.withColumn("cls", F.monotonically_increasing_id()), "near-classes")
    label = link_labels(classes, _Sets(own, classes, k), percent)
    named = classes.select("d1", "d2", "n", "cls", "id")
    if label is None:
        named = named.withColumn("component", F.col("id"))
    else:
        named = named.join(label, "cls", "left")
        least = named.where("label is not null").groupBy("label").agg(F.min("id").alias("_least"))
        named = stored(named.join(least, "label", "left").select("d1", "d2", "n", F.coalesce("_least", "id").alias("component")), "near-labels")
    out = rows.select("id", "print", "n", "d1", "d2").join(named.select("d1", "d2", "n", "component"), ["d1", "d2", "n"], "left").withColumn("component", F.coalesce("component", "id"))
    return out.select("id", "print", "n", "component")


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


OP10_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
pairs as (select x, y from e union all select y, x from e),
reach as (select x, y from pairs union select r.x, b.y from reach r join pairs b on r.y = b.x),
lowest as (select x, min(y) as y from reach group by x)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(l.y, w.doc_id)) as component_id, w.doc_id <= coalesce(l.y, w.doc_id) as kept
from w left join n on n.doc_id = w.doc_id left join lowest l on l.x = w.doc_id
"""
