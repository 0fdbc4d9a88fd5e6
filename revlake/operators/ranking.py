"""Latest row per key, top n per group, ordered limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows of each group.

    The filter on row_number makes Spark keep at most ``n`` rows per group and map task
    before the shuffle, so one hot group does not end up whole in a single task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def latest_by_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (newest first gives last-wins)."""
    return top_n_per_group(df, key, order, 1, "_rank").drop("_rank")
