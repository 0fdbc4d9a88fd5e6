"""The operators as queries over the benchmark tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import repeated_spans
from .contamination import find_leaks
from .licenses import NOTICES, scan_licenses
from .near_duplicates import near_duplicates
from .negatives import hard_negatives
from .perplexity import quality_rules
from .pieces import encode_digests
from .quality import fit_quality, grade_documents
from .shards import assign_shards
from .templates import line_report
from .token_counts import count_tokens
from .urls import filter_urls
from .whitening import whiten

URL_RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
    ("com/fr/", "allow"), ("com/de/", "block"),
)

SHARDS = 40


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _rows(spark: SparkSession, values: tuple[tuple[str, str], ...], *names: str) -> DataFrame:
    """A table of given strings, without Python on the executors."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in values])
    return spark.range(1).select(F.inline(rows))


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return grade_documents(docs, fit_quality(docs, _table(spark, folder, "labels"))).drop("th")


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return encode_digests(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_table(spark, folder, "documents"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_spans(_table(spark, folder, "documents")).drop("th")


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), size=2).drop("th")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    licenses = _rows(spark, NOTICES, "license_id", "text")
    return scan_licenses(_table(spark, folder, "documents"), licenses)


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(_table(spark, folder, "documents"))


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = _rows(spark, URL_RULES, "rule", "verdict")
    return filter_urls(_table(spark, folder, "pages"), rules)


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(_table(spark, folder, "documents"), [1.0] * SHARDS)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, folder, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_decontamination": op7_decontamination,
    "op8_license_scans": op8_license_scans,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_sharding": op11_sharding,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}
