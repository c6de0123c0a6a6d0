"""A durable store of sorted runs: Parquet directories named by a manifest.

A manifest is a numbered JSON file with the list of runs, oldest first. It is written beside
and renamed, so a reader sees a whole one; the highest number is in force. Runs that no
manifest in force names don't exist, whatever a crash left, and are swept later. Storage is
reached through Hadoop's FileSystem, so executors and driver need share only that.

The newest mutation of a key is the one with the highest seq, whichever run it came in; of
equal ones that of the newer run. A batch may so arrive late. A tombstone can go only when
nothing older than it may still arrive, so compaction keeps tombstones but for those up to a
seq that its caller calls settled; mutations up to there are refused from then on."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.model import MUTATION
from stratalog.operators import runs as ops


@dataclass(frozen=True)
class Manifest:
    version: int
    runs: tuple[tuple[int, str], ...]  # (gen, directory), oldest first
    batches: tuple[tuple[int, int], ...] = ()  # published batches, as ranges (first, last)
    settled: int | None = None
    gens: int = 0  # runs ever published

    def has(self, batch: int) -> bool:
        return any(a <= batch <= b for a, b in self.batches)

    def after(self, runs: tuple[tuple[int, str], ...], batch: int | None = None, settled: int | None = None) -> Manifest:
        """The next manifest, with these runs and what else is new."""
        ranges: list[tuple[int, int]] = []
        for a, b in sorted([*self.batches, *([] if batch is None else [(batch, batch)])]):
            if ranges and a <= ranges[-1][1] + 1:
                ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
            else:
                ranges.append((a, b))
        return replace(self, version=self.version + 1, runs=runs, batches=tuple(ranges), settled=self.settled if settled is None else settled, gens=self.gens + 1)


class Conflict(RuntimeError):
    """Another writer has published a manifest of this number."""


class TooLate(ValueError):
    """A mutation at or below the settled seq: tombstones that it needs may be gone."""


class RunStore:
    """Mutations (seq, ts, key, value, tombstone) kept as runs with gen, newest last."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/manifest"))
        self.closed = False

    def _check_open(self) -> None:
        if self.closed:
            raise ValueError("the store is closed")

    def manifest(self) -> Manifest:
        found = [s.getPath() for s in self._fs.listStatus(self._Path(f"{self.path}/manifest")) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith(".")]
        if not found:
            return Manifest(0, ())
        last = max(found, key=lambda p: p.getName())
        stream = self._fs.open(last)
        try:
            raw = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        x = json.loads(raw)
        return Manifest(x["version"], tuple((g, d) for g, d in x["runs"]), tuple((a, b) for a, b in x["batches"]), x["settled"], x["gens"])

    def _publish(self, m: Manifest) -> None:
        folder = f"{self.path}/manifest"
        beside, name = self._Path(f"{folder}/.{uuid.uuid4().hex}"), self._Path(f"{folder}/{m.version:09d}.json")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps({"version": m.version, "runs": m.runs, "batches": m.batches, "settled": m.settled, "gens": m.gens}).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(beside, name):
            self._fs.delete(beside, False)
            raise Conflict(name.toString())

    def _write_run(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        sorted_ = rows.select("seq", "ts", "key", "value", "tombstone").repartitionByRange(self.buckets, "key").sortWithinPartitions("key")
        sorted_.write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{name}")
        return name

    def flush(self, mutations: DataFrame, batch: int | None = None) -> bool:
        """Publish a batch as the newest run: one entry per key, tombstones kept. An empty batch
        and one that is already published change nothing; one with a seq that is settled fails."""
        self._check_open()
        m = self.manifest()
        if batch is not None and m.has(batch) or mutations.isEmpty():
            return False
        if m.settled is not None and not mutations.where(F.col("seq") <= m.settled).isEmpty():
            raise TooLate(f"a mutation up to the settled seq {m.settled}")
        name = self._write_run(ops.newest(mutations, ["key"], "seq"))
        self._publish(m.after((*m.runs, (m.gens + 1, name)), batch))
        return True

    def set(self, seq: int, key: bytes, value: bytes, ts: int | None = None) -> bool:
        """Publish one mutation; many belong in one flush()."""
        return self._one(seq, key, value, False, ts)

    def delete(self, seq: int, key: bytes, ts: int | None = None) -> bool:
        """Publish a tombstone, whether or not the key is there."""
        return self._one(seq, key, None, True, ts)

    def _one(self, seq: int, key: bytes, value: bytes | None, tombstone: bool, ts: int | None) -> bool:
        if not key:
            raise ValueError("empty key")
        return self.flush(self.spark.createDataFrame([(seq, ts, bytearray(key), None if value is None else bytearray(value), tombstone)], MUTATION))

    def runs(self) -> DataFrame:
        """Entries of all runs with gen, and `at`, the order of a key's entries."""
        self._check_open()
        parts = [self.spark.read.schema(MUTATION).parquet(f"{self.path}/{d}").withColumn("gen", F.lit(g)) for g, d in self.manifest().runs]
        if not parts:
            parts = [self.spark.createDataFrame([], MUTATION).withColumn("gen", F.lit(0))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumn("at", F.struct("seq", "gen"))

    def live(self) -> DataFrame:
        return ops.merge(self.runs(), True, "key", "at", "tombstone")

    def get(self, key: bytes) -> tuple[str, bytes | None]:
        """(live, deleted or absent; value). The key is pushed to every run's row groups."""
        row = ops.read_path(self.runs().where(F.col("key") == F.lit(bytearray(key))), "key", "at").first()
        if row is None:
            return "absent", None
        return ("deleted", None) if row["tombstone"] else ("live", bytes(row["value"] or b""))

    def scan(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Live rows in key order, between bounds if given."""
        rows = self.runs()
        if low is not None:
            rows = rows.where(F.col("key") >= F.lit(bytearray(low)))
        if high is not None:
            rows = rows.where(F.col("key") <= F.lit(bytearray(high)))
        return ops.merge(rows, True, "key", "at", "tombstone").orderBy("key")

    def tables(self) -> int:
        return len(self.manifest().runs)

    def size(self) -> int:
        """Bytes of the files of all runs in force."""
        self._check_open()
        return sum(self._fs.getContentSummary(self._Path(f"{self.path}/{d}")).getLength() for _, d in self.manifest().runs)

    def compact(self, force: bool = False, settled: int | None = None) -> bool:
        """All runs to one: a key's newest mutation, without tombstones up to the seq `settled`,
        which says that no mutation up to there is still to come. With fewer than two runs
        nothing happens unless forced."""
        self._check_open()
        m = self.manifest()
        if not m.runs or (len(m.runs) < 2 and not force):
            return False
        settled = m.settled if settled is None else max(settled, settled if m.settled is None else m.settled)
        rows = ops.merge(self.runs(), False, "key", "at", "tombstone")
        if settled is not None:
            rows = rows.where(~F.col("tombstone") | (F.col("seq") > settled))
        self._publish(m.after(((m.gens + 1, self._write_run(rows)),), settled=settled))
        return True

    def maybe_compact(self, threshold: int, settled: int | None = None) -> bool:
        return self.tables() >= threshold and self.compact(settled=settled)

    def sweep(self) -> list[str]:
        """Delete runs that the manifest in force doesn't name, and older manifests. Only when no
        reader is on an older version."""
        self._check_open()
        m = self.manifest()
        keep = {d for _, d in m.runs}
        gone = [s.getPath() for s in self._fs.listStatus(self._Path(self.path)) if s.getPath().getName().startswith("run-") and s.getPath().getName() not in keep]
        gone += [s.getPath() for s in self._fs.listStatus(self._Path(f"{self.path}/manifest")) if s.getPath().getName() < f"{m.version:09d}.json"]
        for p in gone:
            self._fs.delete(p, True)
        return [p.getName() for p in gone]

    def close(self) -> None:
        """What is published is on storage already; later calls fail."""
        self.closed = True
