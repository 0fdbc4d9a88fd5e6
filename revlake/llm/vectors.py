"""Vectors of one length without nulls, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector: str, below: float) -> tuple[DataFrame, int]:
    """Rows whose vector is whole, and the length of their vectors (0: no such row).

    Vectors that are null or empty, hold a null or a value that is not finite, or one of ``below`` or more
    in size (whose sums would leave the exact range), take no part. Where lengths differ, the most
    frequent one counts, the greater one on a tie.
    """
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < below))
    kept = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & whole)
    sizes = kept.groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("length")).first()
    return (kept.filter(F.size(vector) == most.length), most.length) if most else (kept, 0)


def scaled(column: pa.Array, length: int, factor: int) -> np.ndarray:
    """floor(factor * x) of every component as long, a row for each vector of a list column."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(factor * values).astype(np.int64).reshape(-1, length)
