"""Lexicon sentiment as one column expression, and the contract of learned backends."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .coerce import WS

# The shipped lexicon.
POSITIVE_TERMS = (
    "好", "很好", "非常好", "不错", "棒", "赞", "满意", "喜欢", "推荐",
    "完美", "给力", "优秀", "物美价廉", "超值", "快", "便宜", "舒适",
    "精致", "漂亮", "惊喜", "值得", "划算", "耐用",
)
NEGATIVE_TERMS = (
    "差", "很差", "太差", "不好", "烂", "坑", "骗", "假", "慢", "贵",
    "失望", "后悔", "垃圾", "退货", "投诉", "问题", "破损", "难用",
    "难吃", "味道怪", "色差", "掉色", "异味", "虚标", "卡顿", "漏液",
)
NEGATION_TERMS = ("不", "没", "无", "未", "别")

# Damping under negation, code points per length unit, label cut.
NEGATION_FACTOR = 0.5
LENGTH_UNIT = 20
LABEL_CUT = 0.15

Backend = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Lexicon:
    positive: tuple[str, ...] = POSITIVE_TERMS
    negative: tuple[str, ...] = NEGATIVE_TERMS
    negation: tuple[str, ...] = NEGATION_TERMS


SHIPPED = Lexicon()


def _hits(text: Column, terms: Iterable[str]) -> Column:
    """Sum of non-overlapping occurrences of every term.

    Byte lengths are stored with the string, and an absent term costs one plain search. A
    fold over a literal array keeps the generated code small for any number of terms.
    """
    size = F.octet_length(text)
    return F.aggregate(
        F.array(*[F.lit(t) for t in terms]),
        F.lit(0).cast("long"),
        lambda n, term: F.when(
            F.contains(text, term),
            n
            + (
                (size - F.octet_length(F.replace(text, term, F.lit("")))) / F.octet_length(term)
            ).cast("long"),
        ).otherwise(n),
    )


def lexicon_hits(text: Column, lexicon: Lexicon = SHIPPED) -> Column:
    return _hits(text, lexicon.positive) - _hits(text, lexicon.negative)


def negation_factor(text: Column, lexicon: Lexicon = SHIPPED) -> Column:
    """Halves the score as soon as any negation term occurs anywhere."""
    found = F.lit(False)
    for term in lexicon.negation:
        found = found | F.contains(text, F.lit(term))
    return F.when(found, F.lit(NEGATION_FACTOR)).otherwise(F.lit(1.0))


def length_divisor(text: Column) -> Column:
    return F.greatest(F.char_length(text) / F.lit(LENGTH_UNIT), F.lit(1.0))


def rating_anchor(score: Column, rating: Column) -> Column:
    """Mean of the text score and the rating mapped to -1..1; no rating leaves the score."""
    return F.when(rating.isNull(), score).otherwise(
        score * 0.5 + (rating.cast("double") - 3) / 2 * 0.5
    )


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))


def label(score: Column) -> Column:
    return (
        F.when(score > LABEL_CUT, "positive").when(score < -LABEL_CUT, "negative").otherwise("neutral")
    )


def _result(name: Column, score: Column) -> Column:
    return F.struct(name.alias("label"), score.alias("score"))


def rule_score(text: Column, rating: Column, lexicon: Lexicon = SHIPPED) -> Column:
    text = F.coalesce(text, F.lit(""))
    score = lexicon_hits(text, lexicon) * negation_factor(text, lexicon) / length_divisor(text)
    return clamp(rating_anchor(score, rating))


def rule_sentiment(text: Column, rating: Column, lexicon: Lexicon = SHIPPED) -> Column:
    """``struct<label, score>`` from the lexicon and the rating."""
    from .tokens import let

    return let(rule_score(text, rating, lexicon), lambda s: _result(label(s), s))


def rule_backend(lexicon: Lexicon = SHIPPED) -> Backend:
    return lambda text, rating: rule_sentiment(text, rating, lexicon)


def map_model_output(text: Column, raw_label: Column, probability: Column) -> Column:
    """Read a classifier's answer: blank text and unknown labels are neutral with score 0."""
    name = F.lower(raw_label)
    blank = F.coalesce(text, F.lit("")).rlike(f"(?U)^{WS}*$")
    positive = F.contains(name, F.lit("pos")) | name.isin("1", "positive")
    negative = F.contains(name, F.lit("neg")) | name.isin("0", "negative")
    neutral = _result(F.lit("neutral"), F.lit(0.0))
    return (
        F.when(blank, neutral)
        .when(positive, _result(F.lit("positive"), probability))
        .when(negative, _result(F.lit("negative"), -probability))
        .otherwise(neutral)
    )
