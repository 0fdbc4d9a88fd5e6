"""Learn a word list from the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tokens import let
from ..session import materialize, widen
from .rows import unfold

HAN_RUNS = r"\p{IsHan}+"


def _grams(run: Column, max_length: int) -> Column:
    """All grams of 1..max_length characters with their left and right neighbour."""

    def cut(chars: Column) -> Column:
        def gram(k: Column, i: Column) -> Column:
            return F.struct(
                F.array_join(F.slice(chars, i + 1, k), "").alias("gram"),
                F.coalesce(F.get(chars, i - 1), F.lit("")).alias("left"),
                F.coalesce(F.get(chars, i + k), F.lit("")).alias("right"),
            )

        lengths = F.sequence(F.lit(1), F.least(F.lit(max_length), F.size(chars)))
        return F.flatten(
            F.transform(
                lengths,
                lambda k: F.transform(
                    F.sequence(F.lit(0), F.size(chars) - k), lambda i: gram(k, i)
                ),
            )
        )

    return let(F.split(run, ""), cut)


def _entropy(counts: DataFrame, side: str) -> DataFrame:
    per_neighbour = counts.groupBy("gram", side).agg(F.sum("n").alias("n"))
    n = F.col("n")
    return per_neighbour.groupBy("gram").agg(
        (F.ln(F.sum("n")) - F.sum(n * F.ln(n)) / F.sum("n")).alias(f"{side}_entropy")
    )


def learn_dictionary(
    docs: DataFrame,
    *,
    text: str = "clean_text",
    runs: str = HAN_RUNS,
    max_length: int = 4,
    min_count: int = 5,
    min_pmi: float = 1.0,
    min_entropy: float = 0.5,
) -> DataFrame:
    """Words as ``(term, n, pmi, left_entropy, right_entropy)``.

    A word is frequent, its parts stick together (the lowest pointwise mutual information
    over all splits) and its neighbours vary (entropy on both sides). Equal runs are counted
    before they are cut into grams.
    """
    found = unfold(docs, [], F.regexp_extract_all(F.col(text), F.lit(runs), F.lit(0)), "run")
    distinct_runs = found.groupBy("run").agg(F.count("*").alias("n"))
    grams = unfold(widen(distinct_runs, "run"), ["n"], _grams(F.col("run"), max_length), "g").select("n", "g.*")
    seen = materialize(
        grams.groupBy("gram", "left", "right").agg(F.sum("n").alias("n")), "grams"
    )
    counts = seen.groupBy("gram").agg(F.sum("n").alias("n"))
    total = counts.filter(F.char_length("gram") == 1).agg(F.sum("n")).scalar()

    words = counts.filter((F.char_length("gram") > 1) & (F.col("n") >= min_count))
    splits = words.select(
        "gram", "n", F.explode(F.sequence(F.lit(1), F.char_length("gram") - 1)).alias("cut")
    ).select(
        "gram", "n",
        F.substring("gram", F.lit(1), F.col("cut")).alias("head"),
        F.expr("substring(gram, cut + 1)").alias("tail"),
    )
    heads = counts.select(F.col("gram").alias("head"), F.col("n").alias("n_head"))
    tails = counts.select(F.col("gram").alias("tail"), F.col("n").alias("n_tail"))
    bound = (
        splits.join(heads, "head")
        .join(tails, "tail")
        .groupBy("gram", "n")
        .agg(
            F.min(
                F.ln(F.col("n") * total.cast("double") / (F.col("n_head") * F.col("n_tail")))
            ).alias("pmi")
        )
        .filter(F.col("pmi") >= min_pmi)
    )
    longer = seen.filter(F.char_length("gram") > 1)
    return (
        bound.join(_entropy(longer, "left"), "gram")
        .join(_entropy(longer, "right"), "gram")
        .filter(F.least("left_entropy", "right_entropy") >= min_entropy)
        .select(F.col("gram").alias("term"), "n", "pmi", "left_entropy", "right_entropy")
    )
