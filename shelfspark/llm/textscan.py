"""Vectorised word scanning for Arrow batches, used inside Spark tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8
is the same as ``[^\\x20\\x09-\\x0D]+`` on characters. Words get 64-bit hashes;
nothing here looks at more than one batch at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * HASH_BYTES:
            _powers[base] = have
    return have[:n]


class Words:
    """Words of some texts: byte ranges, hashes, and each text's range of words."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray):
        self.data, self.starts, self.ends, self.offsets = data, starts, ends, offsets

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes, in windows of bounded size."""
        out, i, n = np.empty(len(self), dtype=np.uint64), 0, len(self)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + HASH_BYTES, "right")))
            lo, hi = int(self.starts[i]), int(self.ends[j - 1])
            part = np.empty(hi - lo + 1, dtype=np.uint64)
            part[0] = 0
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * _power(_BASE, hi - lo), out=part[1:])
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = (part[e] - part[s]) * _power(_INVERSE, hi - lo + 1)[s] + (e - s).astype(np.uint64)
            i = j
        return mix(out)


def scan(texts: pa.Array, lower: bool) -> Words:
    """Find the words of an Arrow string array; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a text ends its last word, whatever follows
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def ngrams(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie in one text, and each one's first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = len(hashes) - n + 1
    h = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9DDFEA08EB382D69) + hashes[k : k + total]
    owner = words.owner()
    first = np.flatnonzero(owner[:total] == owner[n - 1 :])
    return mix(h[first]), first


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker, which lives on for other stages, gives back the memory that it no longer uses."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark, rows: int = 2000, size: str = "8m") -> None:
    """Let Arrow batches hold at most so many rows and bytes; whole texts make wide rows, and JVM and worker hold a batch each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text in each part stays near ``limit`` bytes; a longer text is alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
