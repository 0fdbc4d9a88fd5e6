"""Row schemas of the three review layers."""

from __future__ import annotations

from pyspark.sql import types as T

PLATFORMS = ("jd", "tmall", "other")
LABELS = ("positive", "negative", "neutral")
KEY = ["platform", "review_id"]
PRODUCT = ["platform", "product_id"]

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
_TS = T.TimestampNTZType()
_WORDS = T.ArrayType(T.StringType(), containsNull=False)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


RAW = _struct(
    ("platform", _S, False),
    ("review_id", _S, False),
    ("product_id", _S, False),
    ("rating", _I, True),
    ("text", _S, False),
    ("created_at", _TS, True),
    ("user_id", _S, True),
    ("user_level", _S, True),
    ("helpful_votes", _I, True),
    ("raw", _S, False),
    ("fetched_at", _TS, False),
)

PROCESSED = _struct(
    ("platform", _S, False),
    ("review_id", _S, False),
    ("product_id", _S, False),
    ("rating", _I, True),
    ("text", _S, False),
    ("clean_text", _S, False),
    ("tokens", _WORDS, False),
    ("language", _S, False),
    ("created_at", _TS, True),
    ("fetched_at", _TS, False),
)

ANALYZED = T.StructType(
    PROCESSED.fields
    + _struct(
        ("sentiment_label", _S, False),
        ("sentiment_score", _D, False),
        ("keywords", _WORDS, False),
    ).fields
)

LEXICON = _struct(("term", _S, False), ("polarity", _S, False))
STOPWORDS = _struct(("term", _S, False))

# What the pages of a landing folder were. ``review_id`` holds the key of a page (or of an item on it).
PAGE_INDEX = _struct(
    ("platform", _S, False), ("review_id", _S, False), ("product_id", _S, False),
    ("page", _I, False), ("n_items", _I, False), ("fetched_at", _TS, True),
)
#: What is known of a product's pages so far; ``review_id`` is the product.
PRODUCT_PAGES = _struct(
    ("platform", _S, False), ("review_id", _S, False), ("product_id", _S, False),
    ("first_empty", _I, True), ("last_page", _I, True),
)
QUARANTINED = _struct(
    ("platform", _S, False), ("review_id", _S, False), ("product_id", _S, True),
    ("page", _I, True), ("error", _S, False), ("payload", _S, True), ("fetched_at", _TS, True),
)
IDLESS = T.StructType(RAW.fields + _struct(("page", _I, False), ("seq", _I, False)).fields)

TABLES = {
    "raw_reviews": RAW, "processed_reviews": PROCESSED, "analyzed_reviews": ANALYZED,
    "page_index": PAGE_INDEX, "quarantined_pages": QUARANTINED, "idless_reviews": IDLESS,
    "product_pages": PRODUCT_PAGES,
}
