"""Which terms mark the praise and the complaints of a product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schemas import PRODUCT
from .ranking import top_n_per_group
from .rows import unfold

LISTS = ("strengths", "complaints", "top_positive_terms", "top_negative_terms")


def pole_counts(
    analyzed: DataFrame, by: Sequence[str] = PRODUCT, keywords: str = "keywords"
) -> DataFrame:
    """``(by..., term, pos, neg)``: both poles in one aggregation, neutral reviews left out."""
    polar = analyzed.filter(F.col("sentiment_label").isin("positive", "negative"))
    rows = unfold(polar, [*by, "sentiment_label"], keywords, "term")
    return rows.groupBy(*by, "term").agg(
        F.count_if(F.col("sentiment_label") == "positive").alias("pos"),
        F.count_if(F.col("sentiment_label") == "negative").alias("neg"),
    )


def complaints_and_strengths(
    analyzed: DataFrame, by: Sequence[str] = PRODUCT, *, top_n: int = 10, keywords: str = "keywords"
) -> DataFrame:
    """``(by..., list, rank, term, signal)`` for every group in one job; ties by term."""
    pos, neg = F.col("pos"), F.col("neg")
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("list"), signal.alias("signal"))
            for name, signal in zip(LISTS, (pos - neg, neg - pos, pos, neg))
        ]
    )
    rows = (
        pole_counts(analyzed, by, keywords)
        .select(*by, "term", F.inline(entries))
        .filter(F.col("signal") > 0)
    )
    best = top_n_per_group(rows, [*by, "list"], [F.desc("signal"), F.asc("term")], top_n)
    return best.select(*by, "list", "rank", "term", "signal")


def top_terms(
    analyzed: DataFrame, pole: str, by: Sequence[str] = PRODUCT, *, top_n: int = 10,
    keywords: str = "keywords",
) -> DataFrame:
    """Most frequent keywords of one pole."""
    rows = unfold(analyzed.filter(F.col("sentiment_label") == pole), by, keywords, "term")
    counts = rows.groupBy(*by, "term").agg(F.count("*").alias("n"))
    best = top_n_per_group(counts, by, [F.desc("n"), F.asc("term")], top_n)
    return best.select(*by, "rank", "term", "n")


def product_insights(
    analyzed: DataFrame, platform: str, product_id: str, *, top_n: int = 10,
    keywords: str = "keywords",
) -> DataFrame:
    """The four lists of one product; an unknown product gives an empty frame."""
    rows = analyzed.filter((F.col("platform") == platform) & (F.col("product_id") == product_id))
    return complaints_and_strengths(rows, top_n=top_n, keywords=keywords)
