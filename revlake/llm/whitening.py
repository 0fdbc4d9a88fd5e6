"""Embedding whitening by incremental eigendecomposition.

Every task turns its vectors into one spectrum by centred rank-one updates (``spectra``); equal vectors of a
batch are one weighted update. Spectra are combined in a tree of bounded groups, again by rank-one updates. The
basis found so is refined by one Rayleigh-Ritz step: all tasks project their centred vectors on it and
sum the products, and the small matrix that comes out, length x length, gives the components to
double precision. Only such small matrices reach the driver; no step holds vectors beyond its batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .spectra import Spectrum
from .vectors import scaled, usable
from .words import bounded_batches

FACTOR = 64
SHIFT = 1_000_000
BELOW = 2.0**30  # components of this size or more take no part
COMPONENTS = 32
FAN = 16  # spectra combined by one task
FLAT = 1e-10  # values under this share of the largest are no components
STATE = "node long, n long, sums binary, vals binary, vecs binary"
RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _spectra(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(length)
        for batch in batches:
            kinds, times = np.unique(scaled(batch.column(0), length, FACTOR), axis=0, return_counts=True)
            for x, k in zip(kinds + SHIFT, times):
                own.add(x, int(k))
        if own.n:
            yield pa.RecordBatch.from_pylist([{"node": TaskContext.get().partitionId(), **own.pack()}])

    return run


def _combine(key: tuple, table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda row: row["node"])
    own = Spectrum.unpack(rows[0])
    for row in rows[1:]:
        own.merge(Spectrum.unpack(row))
    return pa.Table.from_pylist([{"node": key[0].as_py(), **own.pack()}])


def incremental_spectrum(vectors: DataFrame, length: int) -> Spectrum:
    """The spectrum of one vector column, from the tasks' spectra in rounds of FAN."""
    states = materialize(vectors.mapInArrow(_spectra(length), STATE), "spectra")
    top = states.agg(F.max("node")).first()[0]
    if top is None:
        return Spectrum.empty(length)
    while top > 0:  # nodes are task numbers, so that a group has FAN members at most
        group = F.floor(F.col("node") / FAN).cast("long").alias("group")
        states = materialize(states.groupBy(group).applyInArrow(_combine, STATE), "spectra")
        top //= FAN
    return Spectrum.unpack(states.first())


def _centred(batch: pa.RecordBatch, at: int, length: int, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S: exact as long, or as Python integers where a long could overflow."""
    x = scaled(batch.column(at), length, FACTOR) + SHIFT
    if n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) >= 2**62 or abs(sums).max() >= 2**62:
        x = x.astype(object)
    return n * x - sums


def _gram(vectors: DataFrame, length: int, n: int, sums: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Sum over all vectors of p p' / n, for p the centred vector projected on the columns of ``onto``."""
    size = onto.shape[1]
    rows, cols = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            p = (_centred(batch, 0, length, n, sums) / n).astype(np.float64) @ onto
            total += p.T @ p
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(total[rows, cols])], names=["i", "j", "v"])

    sums_of = vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for i, j, v in sums_of.collect():  # size^2 / 2 rows
        out[i, j] = out[j, i] = v / n
    return out


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """RESULT for each row with a whole vector and each component, the whole table being the fit list.

    Components come by falling eigenvalue, from 1, with the sign that makes their largest entry positive; those
    with no variance are left out, so that one vector alone, equal vectors or an empty table give no rows. Rows
    with a null id or an id that repeats count and are returned like any other. ``usable`` says which vectors
    take no part. ``deviation`` is null where it does not fit a long. Extra columns are not read.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    kept, length = usable(rows.select("vec_id", vector), vector, BELOW)
    empty = spark.createDataFrame([], RESULT)
    if not length:
        return empty
    only = kept.select(vector)
    first = incremental_spectrum(only, length)
    n, sums, basis = first.n, first.sums, first.vectors
    small = _gram(only, length, n, sums, basis)
    values, turn = np.linalg.eigh(small)
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(np.trace(small))
    count = min(components, int((values > FLAT * max(values[0], 0)).sum()) if values[0] > 0 else 0)
    if not count:
        return empty
    axes = axes[:, :count] * np.sign(axes[np.abs(axes[:, :count]).argmax(axis=0), range(count)])
    onto = axes / np.sqrt(values[:count])
    # whitened vectors need no centring: the sum of n * x - S is exactly nothing
    error = float(np.abs(_gram(only, length, n, sums, onto) - np.eye(count)).max())
    explained = values[:count] / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = _centred(batch, 1, length, n, sums)
            far = np.square(off.astype(np.float64)).sum(axis=1) >= 2.0**62
            exact = off.astype(np.int64) if not far.any() else np.where(far[:, None], 0, off).astype(np.int64)
            deviation = pa.array(np.square(exact).sum(axis=1), pa.int64(), mask=far)
            white = (off / n).astype(np.float64) @ onto
            m = batch.num_rows
            each = np.repeat(np.arange(m), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * count, n)), deviation.take(pa.array(each)), pa.array(white.ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * count, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.mapInArrow(run, RESULT)
