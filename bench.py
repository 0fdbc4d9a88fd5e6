"""Headline queries on local cores; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1).
Each query is warmed up on the smallest tables, then the median of its runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from revlake.session import build_session
from revlake.workload.queries import QUERIES

HEADLINE = (
    "parse_jd_reviews",
    "clean_review_text",
    "tokenize",
    "tokenize_with_dictionary",
    "detect_language",
    "rule_sentiment",
    "textrank_keywords",
    "analyze_reviews_layer",
    "upsert_reviews",
    "fresh_reviews",
    "incremental_ingest",
    "analyzed_stream",
    "sentiment_distribution_by_product",
    "rating_correlation",
    "rolling_sentiment",
    "rolling_sentiment_overall",
    "token_frequencies",
    "complaints_and_strengths",
    "doc_frequency",
    "tfidf_keywords",
    "tfidf_by_product",
    "learn_dictionary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "revlake-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str, folder: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    warm = Path(sf_dir).parent / "sf0.001"
    seconds = {}
    for name in HEADLINE:
        if warm.exists():
            timed(name, str(warm))
        seconds[name] = round(statistics.median(timed(name, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
