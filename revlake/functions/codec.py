"""Token lists as JSON text, for sinks without array columns (JDBC, CSV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LIST_COLUMNS = ("tokens", "keywords")


def encode_list(col: Column) -> Column:
    return F.to_json(col)


def decode_list(col: Column) -> Column:
    """Null and empty text decode to an empty list."""
    return F.from_json(F.coalesce(F.nullif(col, F.lit("")), F.lit("[]")), "array<string>")


def _map_lists(df: DataFrame, fn) -> DataFrame:
    present = [c for c in LIST_COLUMNS if c in df.columns]
    return df.withColumns({c: fn(F.col(c)) for c in present})


def encode_lists(df: DataFrame) -> DataFrame:
    return _map_lists(df, encode_list)


def decode_lists(df: DataFrame) -> DataFrame:
    return _map_lists(df, decode_list)
