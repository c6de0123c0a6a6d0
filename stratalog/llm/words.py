"""Vectorised word splitting and hashing over Arrow string columns.

Whole batches are handled as one byte buffer: numpy finds the words of all texts at once
and hashes them with prefix sums of a polynomial modulo 2**64, so no Python code runs per
word. Batches are cut into pieces of a few megabytes first, which bounds the memory."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is a piece of its own.
PIECE_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = _U(0x9E3779B97F4A7C17 | 3)
_P_INV = _U(pow(int(_P), -1, 2**64))
_Q = _U(0xD1342543DE82EF97)
_Q_INV = _U(pow(int(_Q), -1, 2**64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * PIECE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """The words of a piece of a column: buf[start[i]:end[i]], those of text d being first[d]..first[d+1]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        n = len(self.buf)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * powers(_P, n), out=total[1:])
        own = (total[self.end] - total[self.start]) * powers(_P_INV, n)[self.start]
        return mix(own + (self.end - self.start).astype(np.uint64))

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A buffer of all words with one space after each, and where each starts and ends in it."""
        size = self.end - self.start
        start = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size + 1, out=start[1:])
        out = np.full(int(start[-1]), 32, np.uint8)
        keep = np.ones(len(out), bool)
        keep[start[1:] - 1] = False
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[self.start] = 1
        inside[self.end] -= 1
        out[keep] = self.buf[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        return out, start[:-1], start[1:] - 1


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_binary())
    elif not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split(texts: pa.Array, separator: np.ndarray = SPACE, lower: bool = False) -> Words:
    """The words of every text: maximal runs of bytes that are no separators. Nulls count as empty."""
    buf, at = _buffer(texts)
    if lower:
        buf = LOWER[buf]
    inside = ~separator[buf]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(inside):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = np.flatnonzero(np.diff(at))
        before[at[full]] = False
        after[at[full + 1] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(buf, start, end, np.searchsorted(start, at))


def pieces(batch: pa.RecordBatch, column: int = 0, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts have up to `most` bytes."""
    _, at = _buffer(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each k consecutive words of one text, in order, and the first gram of each text.

    A text of fewer than k words has none."""
    n = len(hashes)
    count = np.maximum(np.diff(first) - k + 1, 0)
    at = np.zeros(len(first), np.int64)
    np.cumsum(count, out=at[1:])
    if n < k:
        return np.zeros(0, np.uint64), at
    if k <= 8:
        rolled = hashes[: n - k + 1].copy()
        for j in range(1, k):
            rolled = rolled * _Q + hashes[j : n - k + 1 + j]
    else:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(_Q, n), out=total[1:])
        rolled = (total[k:] - total[:-k]) * powers(_Q_INV, n - k + 1)
    where = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    return mix(rolled[where]), at


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingle hashes, sorted, and where each text's begin.

    A text of 1 to k-1 words has one shingle, its whole sequence; one without words has none."""
    h = words.hashes()
    g, at = grams(h, words.first, k)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    owner = np.repeat(np.arange(words.texts), np.diff(at))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for n in range(1, k):
            rows = np.flatnonzero(counts[short] == n)
            if len(rows):
                x = h[words.first[short[rows]]].copy()
                for j in range(1, n):
                    x = x * _Q + h[words.first[short[rows]] + j]
                extra[rows] = mix(x + _U(n))
        g, owner = np.concatenate([g, extra]), np.concatenate([owner, short])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(words.texts + 1))
