"""Trailing mean whose window grows with the number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..schemas import PRODUCT
from ..session import materialize

# The window is at least 5 rows, else a twentieth of the rows.
MIN_WINDOW = 5
WINDOW_SHARE = 20


def rolling_sentiment(
    analyzed: DataFrame,
    by: Sequence[str] = PRODUCT,
    *,
    score: str = "sentiment_score",
    time: str = "created_at",
    row_key: str = "review_id",
) -> DataFrame:
    """``(by..., row key, time, rn, rolling_sentiment)``, rows without a time left out.

    The window holds max(5, n // 20) rows, so a frame cannot express it, and one group (or
    no group at all) may be too large for one task. Rows are therefore sorted by range over
    all tasks; each task's share of a group gets running sums, the shares get offsets from
    their totals (one row per share), and the trailing sum is a difference of two running
    sums joined on the row number. Sums are decimal, hence exact and independent of the
    order of additions.
    """
    by = list(by)
    rows = analyzed.filter(F.col(time).isNotNull()).select(
        *by, row_key, time, F.col(score).cast("decimal(28,18)").alias("_v")
    )
    order = [*by, time, row_key]
    placed = materialize(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id()),
        "rolling",
    ).withColumn("_chunk", F.shiftright("_pos", 33))

    share = [*by, "_chunk"]
    totals = placed.groupBy(*share).agg(
        F.count("*").alias("_n"), F.sum("_v").alias("_sum"), F.min("_pos").alias("_first")
    )
    group = Window.partitionBy(*by)
    before = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *share,
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_s0"),
        F.greatest(
            F.lit(MIN_WINDOW), F.floor(F.sum("_n").over(group) / WINDOW_SHARE)
        ).cast("long").alias("_w"),
    )
    inside = Window.partitionBy(*share).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    # stored, because both sides of the join below read it
    running = materialize(
        placed.withColumn("_run", F.sum("_v").over(inside))
        .join(offsets, share)
        .select(
            *by, row_key, time, "_w",
            (F.col("_n0") + F.col("_pos") - F.col("_first") + 1).alias("rn"),
            (F.col("_s0") + F.col("_run")).cast("decimal(38,18)").alias("_cs"),
        ),
        "running",
    )
    lagged = running.select(
        *by, (F.col("rn") + F.col("_w")).alias("rn"), F.col("_cs").alias("_left")
    )
    gap = F.col("_cs") - F.coalesce(F.col("_left"), F.lit(0))
    return running.join(lagged, [*by, "rn"], "left").select(
        *by, row_key, time, "rn",
        (gap.cast("double") / F.least(F.col("rn"), F.col("_w"))).alias("rolling_sentiment"),
    )
