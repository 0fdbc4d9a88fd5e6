"""The most frequent terms with exact counts, without a shuffle of the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .rows import unfold

TRACKED = 10_000  # counters a summary keeps at first
MAX_TRACKED = 200_000  # 1.6 MB of hashes sent to the tasks at most; beyond it all terms are counted by shuffle
# A frequent-items summary of k counters finds every term with more than 6/k of all rows: its error is
# below 3.5 / (k / 0.75) of them, and a term is listed if it has more than twice the error.
SLACK = 6


def frequent_terms(df: DataFrame, n: int, tokens: str = "tokens") -> DataFrame:
    """``(term, n)`` of the ``n`` most frequent terms of the array column ``tokens``, ties by term.

    Tasks keep mergeable summaries over hashes of terms; only these are shuffled. Every term above the
    summary's error is a candidate, and a second pass counts the candidates alone. The result is whole
    if the last of the ``n`` has more rows than the error, or if candidates hold all rows. If not, its count
    tells how many counters prove the result, which is then asked for once more; where that exceeds
    ``MAX_TRACKED`` (a flat vocabulary) all terms are counted. Null arrays and null tokens count nothing; an empty
    table gives no row. ``df`` is read twice or three times, so give a stored one if tokens are costly.
    """
    if n < 1:
        raise ValueError("n must be positive")
    rows = unfold(df, [], tokens, "term")
    tracked = max(TRACKED, 2 * n)
    while tracked <= MAX_TRACKED:
        found, total, least, covered = _candidates_counted(rows, n, tracked)
        if covered == total or (least is not None and least * tracked > SLACK * total):
            return found
        if least is None:  # fewer candidates than asked for
            break
        wanted = SLACK * total // least + 1
        if wanted <= tracked:
            break
        tracked = wanted
    counts = rows.groupBy("term").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("term")).limit(n)


def _candidates_counted(
    rows: DataFrame, n: int, tracked: int
) -> tuple[DataFrame, int, int | None, int]:
    """The best ``n`` candidates; number of rows; count of the n-th (null: fewer); rows of all candidates."""
    summary = materialize(
        rows.select(F.xxhash64("term").alias("h")).agg(
            F.count("*").alias("total"), F.expr(f"approx_top_k(h, {tracked}, {tracked})").alias("items")
        ),
        "summary",
    )
    hashes = summary.select(F.explode("items.item").alias("h"))  # ``tracked`` longs at most
    counts = materialize(
        rows.join(F.broadcast(hashes), F.xxhash64("term") == F.col("h"), "left_semi")
        .groupBy("term").agg(F.count("*").alias("n")),
        "candidates",
    )
    found = counts.orderBy(F.desc("n"), F.asc("term")).limit(n)
    total = summary.select("total").first()["total"]
    covered = counts.agg(F.sum("n")).first()[0] or 0
    size, least = found.agg(F.count("*"), F.min("n")).first()
    return found, total, least if size == n else None, covered
