"""Read-side queries over analyzed reviews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..schemas import KEY, PRODUCT
from .rows import unfold


def filter_reviews(
    analyzed: DataFrame, platform: str | None = None, product_id: str | None = None
) -> DataFrame:
    """Equality filters; null and ``''`` mean no filter."""
    if platform:
        analyzed = analyzed.filter(F.col("platform") == platform)
    if product_id:
        analyzed = analyzed.filter(F.col("product_id") == product_id)
    return analyzed


def list_reviews(
    analyzed: DataFrame, platform: str | None = None, product_id: str | None = None, limit: int = 50
) -> DataFrame:
    """First ``limit`` reviews by key; ``limit`` must lie in 1..500."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    return filter_reviews(analyzed, platform, product_id).orderBy(*KEY).limit(limit)


def review_lines(
    analyzed: DataFrame, platform: str | None = None, product_id: str | None = None, limit: int = 20
) -> DataFrame:
    """One printable ``line`` per review."""
    rows = filter_reviews(analyzed, platform, product_id).orderBy(*KEY).limit(limit)
    return rows.select(
        F.format_string(
            "[%s/%s/%s] %8s %+.2f | %s",
            "platform", "product_id", "review_id", "sentiment_label", "sentiment_score",
            F.substring("clean_text", 1, 80),
        ).alias("line")
    )


def sentiment_distribution(analyzed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = analyzed.groupBy(*by, "sentiment_label").agg(F.count("*").alias("count"))
    return counts.orderBy(*by, F.desc("count"), "sentiment_label")


def headline_metrics(analyzed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return analyzed.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("sentiment_label") == "positive").alias("positive"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative"),
    )


def token_frequencies(
    analyzed: DataFrame, top_n: int | None = None, tokens: str = "tokens"
) -> DataFrame:
    counts = unfold(analyzed, [], tokens, "term").groupBy("term").agg(F.count("*").alias("n"))
    if top_n is None:
        return counts
    return counts.orderBy(F.desc("n"), F.asc("term")).limit(top_n)


def rating_vs_sentiment(analyzed: DataFrame) -> DataFrame:
    return analyzed.filter(F.col("rating").isNotNull()).select(
        *KEY, "rating", "sentiment_score", "sentiment_label", "clean_text"
    )


def rating_correlation(analyzed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return analyzed.groupBy(*by).agg(
        F.count("rating").alias("rated"),
        F.corr("rating", "sentiment_score").alias("correlation"),
    )


def sentiment_by_rating(analyzed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rated = analyzed.filter(F.col("rating").isNotNull())
    return rated.groupBy(*by, "rating").agg(
        F.count("*").alias("reviews"), F.avg("sentiment_score").alias("mean_score")
    )


def run_summary(fetched: DataFrame, fresh: DataFrame, analyzed: DataFrame) -> DataFrame:
    """Fetched, fresh and newly analyzed counts per product of one run."""
    stages = {"fetched": fetched, "fresh": fresh, "analyzed": analyzed}
    counts = [
        df.groupBy(*PRODUCT).agg(F.count("*").alias("n")).withColumn("stage", F.lit(name))
        for name, df in stages.items()
    ]
    rows = reduce(DataFrame.unionByName, counts)
    return rows.groupBy(*PRODUCT).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("n"))), F.lit(0)).alias(s)
            for s in stages
        ]
    )
