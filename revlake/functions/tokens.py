"""Segmentation and token-list helpers as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from .coerce import NON_WS
from .lattice import Trie, longest

# Outside the dictionary: one Han character, a run of other letters and digits, or one mark.
_HAN = r"\p{IsHan}"
_RUN = r"[\p{L}\p{N}&&[^\p{IsHan}]]+"
_MARK = NON_WS
FALLBACK_PATTERN = rf"{_HAN}|{_RUN}|{_MARK}"

# More terms are looked up in a trie instead of tried by a pattern, with the same result.
INLINE_TERMS = 5000

Tokenizer = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A plain reuse of a column inside a lambda would be evaluated per element once the
    optimizer merges projections.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_pattern(terms: Iterable[str] = ()) -> str:
    """Longest dictionary term first, then the fallback.

    Terms are grouped by their first character, so that a position tries only the terms that
    can start there.
    """
    words = {t for t in terms if t}
    rests: dict[str, list[str]] = {}
    for term in sorted(words, key=lambda t: (-len(t), t)):
        rests.setdefault(term[0], []).append(re.escape(term[1:]))
    groups = [f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in sorted(rests.items())]
    return "|".join([*groups, FALLBACK_PATTERN])


def segment(text: Column, pattern: str | Column) -> Column:
    pattern = F.lit("(?U)" + pattern) if isinstance(pattern, str) else pattern
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), pattern, F.lit(0))


def segment_words(text: Column, terms: Iterable[str]) -> Column:
    """Longest dictionary term first, then the fallback, for any number of terms."""
    words = sorted({t for t in terms if t})
    if len(words) <= INLINE_TERMS:
        return segment(text, token_pattern(words))
    trie = Trie.build(words, [0] * len(words))

    def cut(texts: pa.Array) -> pa.Array:
        return pa.array(longest(texts.fill_null("").to_pylist(), trie), pa.list_(pa.string()))

    return F.arrow_udf(cut, "array<string>")(text)


def remove_stopwords(tokens: Column, stopwords: Iterable[str]) -> Column:
    """Keep order and duplicates. Up to a few hundred words ``IN`` is a hash-set probe."""
    words = sorted(set(stopwords))
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))


def tokenize(text: Column, *, terms: Iterable[str] = (), stopwords: Iterable[str] = ()) -> Column:
    """Dictionary longest match. Marks and single characters stay; case is kept."""
    return remove_stopwords(segment_words(text, terms), stopwords)


def tokenizer(*, terms: Iterable[str] = (), stopwords: Iterable[str] = ()) -> Tokenizer:
    terms, stopwords = tuple(terms), tuple(stopwords)
    return lambda text: tokenize(text, terms=terms, stopwords=stopwords)


def runs_of(items: Column, name: Callable[[Column], Column], make: Callable) -> Column:
    """Group a sorted array into runs of equal ``name`` without leaving the row."""

    def grouped(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(
            F.transform(
                ordered,
                lambda x, i: F.when(
                    (i == 0) | (name(F.get(ordered, i - 1)) != name(x)), i
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, k: make(
                    ordered, at, F.coalesce(F.get(s, k + 1), size) - at
                ),
            ),
        )

    return let(F.sort_array(items), grouped)


def coded_terms(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """List and term number of every element of an Arrow array of lists, and the terms, numbered in their order."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy(zero_copy_only=False)] = np.arange(len(order))
    term = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(lists)), counts), term, coded.dictionary.take(order)


def _count_terms(lists: pa.ListArray) -> pa.ListArray:
    at, term, terms = coded_terms(lists)
    many = max(len(terms), 1)
    runs, n = np.unique(at * many + term, return_counts=True)
    ends = np.concatenate([[0], np.cumsum(np.bincount(runs // many, minlength=len(lists)))])
    counted = pa.StructArray.from_arrays(
        [terms.take(pa.array(runs % many)).cast(pa.string()), pa.array(n, pa.int32())], ["term", "n"]
    )
    missing = lists.is_null().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), counted, mask=pa.array(missing))


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, n>>`` of one token list, sorted by term; numpy counts the lists of a batch together."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())]))

    def run(lists: pa.Array) -> pa.Array:
        return _count_terms(lists).cast(kind) if len(lists) else pa.array([], kind)

    return F.arrow_udf(run, "array<struct<term: string, n: int>>")(tokens)


def term_positions(tokens: Column) -> Column:
    """``array<struct<term, at>>``: each distinct item with the list of its indexes."""
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("i")))
    return runs_of(
        placed,
        lambda x: x["term"],
        lambda ordered, at, n: F.struct(
            F.get(ordered, at)["term"].alias("term"),
            F.transform(F.slice(ordered, at + 1, n), lambda x: x["i"]).alias("at"),
        ),
    )
