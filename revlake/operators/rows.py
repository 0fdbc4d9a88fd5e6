"""Unfolding arrays into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def unfold(df: DataFrame, keep: Sequence[str], items: Column | str, name: str) -> DataFrame:
    """One row per array element.

    A plain explode makes the optimizer add ``size(items) > 0 AND items IS NOT NULL`` below
    it, which evaluates a computed array twice more. The outer form with a filter above it
    does not.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())
