"""Sharding by weighted rendezvous hashing.

A record's key and every shard give a number between 0 and 1, and the record goes to the shard whose
-weight / ln(number) is greatest. So a shard gets records in proportion to its weight, and what a shard scores does
not depend on the others: one more shard takes records only into itself, one less gives up only its own.

Inside a shard records are numbered without gaps, in order of their hash, hence mixed. Rows are dealt out
by ranges of (shard, hash, …, row), which split a shard, and even a key that repeats a million times, over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

DIGITS = 13  # hexadecimal ones of a digest: 52 bits


def unit_hash(text: Column) -> Column:
    """A number between 0 and 1, both excluded, from the digest of a string."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def _checked(weights: Sequence[float]) -> None:
    if not weights or min(weights) < 0 or not max(weights) > 0:
        raise ValueError("a shard with a weight above nothing is needed, and none below nothing")


def shard_scores(key: Column, weights: Sequence[float]) -> Column:
    """What every shard scores for a key; a null key counts as an empty string. A shard of weight 0 scores nothing."""
    shards = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)])
    name = F.coalesce(key.cast("string"), F.lit(""))
    return F.transform(shards, lambda s: F.struct((-s.w / F.ln(unit_hash(F.concat_ws(":", name, s.k)))).alias("score"), (-s.k).alias("back")))


def winner(scores: Column) -> Column:
    """The shard (from 0) with the greatest score, of equal ones the smallest."""
    return -F.array_max(scores)["back"]


def numbered(rows: DataFrame, shard: str, *order: str) -> DataFrame:
    """``rows`` with ``slot``: their number inside ``shard`` by ``order``, from 0 without gaps.

    Equal rows are told apart by their place in a written table, so that ranges can split them. A range is
    sorted where it lies, and every (range, shard) adds what the ranges before it hold, one row for each.
    """
    spark = rows.sparkSession
    row, at = "__row", "__at"
    stored = materialize(rows.withColumn(row, F.monotonically_increasing_id()), "sharded")
    keys = [F.col(c) for c in (shard, *order, row)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = stored.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = materialize(dealt.drop(row).withColumn(at, F.monotonically_increasing_id()), "dealt")
    part = F.shiftright(at, 33)
    sizes = dealt.groupBy(F.col(shard).alias("__own"), part.alias("__part")).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    before = F.expr("sum(n) OVER (PARTITION BY __own ORDER BY __part) - n")
    starts = sizes.select("__own", "__part", (before - F.col("first")).alias("__shift"))
    both = dealt.join(starts, (F.col(shard) == F.col("__own")) & (part == F.col("__part")))
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(at) + F.col("__shift")).alias("slot"))


def assign_shards(docs: DataFrame, weights: Sequence[float], added: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard, of weight ``added``) for each row.

    ``doc_id`` and the weights decide, so rows that share an id share a shard, null ids too. A null text counts
    as empty. Repeated rows each get a slot; extra columns are not read; an empty table gives no rows.
    """
    _checked(weights)
    text = F.coalesce("text", F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    slim = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), shard_scores(F.col("doc_id"), [*weights, added]).alias("scores"), unit_hash(name).alias("mixed"),
    )
    placed = slim.select(
        "doc_id", "size", "text_crc32", "law", "mixed",
        winner(F.slice("scores", 1, len(weights))).alias("shard"), winner(F.col("scores")).alias("grown_shard"),
    )
    slots = numbered(placed, "shard", "mixed", "doc_id", "text_crc32", "size")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str) -> None:
    """Write whole rows below ``path``, a folder ``shard=k`` for each shard, in order of their slots.

    Columns ``shard``, ``slot`` and ``mixed`` of ``docs`` are replaced. Large shards are several files, each a
    range of slots.
    """
    _checked(weights)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    own = docs.drop("shard", "slot", "mixed")
    placed = own.withColumn("shard", winner(shard_scores(F.col("doc_id"), weights))).withColumn("mixed", unit_hash(name))
    slots = numbered(placed, "shard", "mixed", "doc_id").drop("mixed")
    slots.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
