"""Scalar coercions used while parsing payload items.

Truthiness rules: an empty string counts as missing, just like null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode whitespace plus the four ASCII separator controls; needs the (?U) flag.
WS = r"[\s\x1c-\x1f]"
NON_WS = r"[^\s\x1c-\x1f]"

_SECONDS = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
_MINUTES = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$"


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def coerce_int(text: Column) -> Column:
    """Whole number in a string, else null (``'5.0'`` is not one)."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int"))


def parse_seconds_time(text: Column) -> Column:
    """``Y-m-d H:M:S`` only. The cast is zone-free, so any session time zone gives the same value."""
    return F.when(text.rlike(_SECONDS), text.try_cast("timestamp_ntz"))


def parse_minutes_time(text: Column) -> Column:
    """``Y-m-d H:M:S``, or the same without seconds."""
    whole = F.when(text.rlike(_MINUTES), F.concat(text, F.lit(":00"))).otherwise(text)
    return parse_seconds_time(whole)


def first_present(first: Column, second: Column) -> Column:
    """``first`` unless it is null or empty, then ``second`` as it is."""
    return F.coalesce(blank_to_null(first), second)


def review_key(primary: Column, fallback: Column) -> Column:
    """First non-empty of the two ids; rows without either share the key ``''``."""
    return F.coalesce(blank_to_null(primary), blank_to_null(fallback), F.lit(""))


def strip_text(text: Column) -> Column:
    """Null-safe strip of outer Unicode whitespace."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)^{WS}++|{WS}++$", "")
