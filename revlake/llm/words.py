"""Vectorised words and shingles of Arrow text columns, shared by the operators.

A word is a run of characters other than space and U+0009 to U+000D. Words are found and hashed on
the UTF-8 bytes of a whole batch, without Python strings; a null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# One random 64-bit value per byte; a word is the sum of its bytes' values times powers of an odd number.
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHAIN = np.uint64(0xC2B2AE3D27D4EB4F)
SLICE_BYTES = 1 << 20
#: Arrow batches of text are cut at this size, so that long texts do not add up in a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes, not only by rows; one batch holds one text at least."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a batch: ``start``/``end`` as byte positions, ``per_row`` as their number by row."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, offsets = utf8(column)
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        solid = ~_SPACE[self.data]
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        cut = offsets[(offsets > 0) & (offsets < len(data))]  # a row's end also ends its last word
        begin[cut] = solid[cut]
        stop[cut - 1] = solid[cut - 1]
        self.solid = solid
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.per_row = np.diff(np.searchsorted(self.start, offsets))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, computed in slices of bounded size."""
        size = self.end - self.start
        total = np.cumsum(size)
        out = np.empty(len(size), np.uint64)
        lo = 0
        while lo < len(size):
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + SLICE_BYTES)))
            n = size[lo:hi]
            first = total[lo:hi] - n - before
            at = np.arange(total[hi - 1] - before) - np.repeat(first, n)
            power = np.multiply.accumulate(np.full(int(n.max()), _STEP))
            value = _VALUE[self.data[at + np.repeat(self.start[lo:hi], n)]] * power[at]
            out[lo:hi] = np.add.reduceat(value, first) + n.astype(np.uint64)
            lo = hi
        return mix(out)


def shingles(h: np.ndarray, per_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, row after row, and their number by row.

    A row with fewer words gives one hash of its whole sequence, a row without words none.
    """
    n = len(h)
    end = np.cumsum(per_row)
    start = end - per_row
    acc, short = h.copy(), {}
    for k in range(1, size):
        rows = np.flatnonzero(per_row == k)
        short[k] = (start[rows], acc[start[rows]])
        acc[: n - k] = acc[: n - k] * _CHAIN + h[k:]
    keep = np.repeat(end, per_row) - np.arange(n) >= size
    for k, (at, value) in short.items():
        acc[at] = value + np.uint64(k)
        keep[at] = True
    number = np.where(per_row >= size, per_row - size + 1, np.minimum(per_row, 1))
    return mix(acc[keep]), number


def rows_of(values: np.ndarray, number: np.ndarray) -> Iterator[np.ndarray]:
    """The values of each row."""
    at = 0
    for n in number:
        yield values[at : at + n]
        at += n
