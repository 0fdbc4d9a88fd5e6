"""Joins that stay balanced when a key is very frequent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import materialize

# At most this many keys can each hold more than 1/HEAVY_KEYS of the rows.
HEAVY_KEYS = 10_000
# A table of short keys up to this many rows is counted and then broadcast whole.
BROADCAST_ROWS = 500_000


def fresh_reviews(fetched: DataFrame, stored: DataFrame, incremental: bool = True) -> DataFrame:
    """Fetched rows whose id is not stored yet for that product. Keeps duplicates in the batch."""
    if not incremental:
        return fetched
    key = ["platform", "product_id", "review_id"]
    # a small batch is broadcast against the large table; only the matches are joined back
    seen = stored.select(*key).join(fetched.select(*key), key, "left_semi")
    return fetched.join(seen, key, "left_anti").select(*fetched.columns)


def split_heavy_join(
    rows: DataFrame, dim: DataFrame, on: Sequence[str], weight: str, *, stored: bool = False
) -> DataFrame:
    """Inner join of ``rows`` with a table of unique keys that counts the rows per key.

    ``dim`` is a stored table, so it can be counted: a small one is broadcast. Beyond that,
    ``weight`` tells how many ``rows`` a key has. Keys above 1/HEAVY_KEYS of all rows are at
    most HEAVY_KEYS by arithmetic, so they are broadcast; what remains has no heavy key and
    is joined by shuffle. ``stored`` says that ``rows`` are a table, too.
    """
    if dim.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(dim), list(on))
    rows = rows if stored else materialize(rows, "rows")  # both parts below read them
    floor = dim.agg((F.sum(weight) / HEAVY_KEYS).alias("f")).scalar()
    heavy = dim.filter(F.col(weight) > floor)
    light = dim.filter(F.col(weight) <= floor)
    hot = rows.join(F.broadcast(heavy), list(on))
    rest = rows.join(F.broadcast(heavy.select(*on)), list(on), "left_anti").join(light, list(on))
    return hot.unionByName(rest)


def salted_join(
    rows: DataFrame, dim: DataFrame, on: Sequence[str], spread: Sequence[str],
    how: str = "left", salts: int = 8,
) -> DataFrame:
    """Join with a small-to-middling table of unique keys, each key served by ``salts`` tasks.

    ``spread`` names columns of ``rows`` that vary among rows of the same key.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
