"""Per-review and corpus keywords: TextRank, document frequency, TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tokens import Tokenizer, coded_terms, term_counts, tokenize
from ..session import materialize
from .joins import split_heavy_join
from .ranking import top_n_per_group
from .rows import unfold

# Window, damping and rounds of TextRank; frequency bounds of the vocabulary.
SPAN = 5
DAMPING = 0.85
ROUNDS = 10
MIN_DF = 1
MAX_DF = 0.95
# Scores are compared in millionths: plain arithmetic, where round() would go through decimals.
SCORE_UNIT = 1_000_000
# Tokens whose graphs are iterated together in a task.
RANKED_TOKENS = 1 << 17


def _term_codes(tokens: pa.ListArray, stopwords: pa.Array, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Document and term number of every token, which tokens are candidates, and the terms, numbered in their order."""
    doc, term, terms = coded_terms(tokens)
    wanted = pc.and_(pc.greater_equal(pc.utf8_length(terms), min_length), pc.invert(pc.is_in(terms, value_set=stopwords)))
    wanted = pc.fill_null(wanted, False).to_numpy(zero_copy_only=False).astype(bool)
    return doc, term, wanted[term], terms


def _links(doc: np.ndarray, node: np.ndarray, wanted: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, times) of words less than ``SPAN`` tokens apart in one document, both ways."""
    found = []
    for k in range(1, SPAN):
        on = np.flatnonzero((doc[k:] == doc[:-k]) & wanted[k:] & wanted[:-k])
        a, b = node[on], node[on + k]
        found += [a * nodes + b, b * nodes + a]
    pairs, times = np.unique(np.concatenate(found), return_counts=True)
    return pairs // max(nodes, 1), pairs % max(nodes, 1), times


def _rank(tokens: pa.ListArray, stopwords: pa.Array, min_length: int, top_n: int) -> pa.Array:
    """The ranking of each token list of an Arrow array; all their graphs are iterated together."""
    doc, term, wanted, terms = _term_codes(tokens, stopwords, min_length)
    many = max(len(terms), 1)
    names, node = np.unique(doc * many + term, return_inverse=True)
    at, to, times = _links(doc, node, wanted, len(names))
    degree = np.bincount(at, times, len(names))
    linked = np.flatnonzero(degree > 0)  # others have no score
    home = names // many
    words = np.bincount(home[linked], minlength=len(tokens))
    score = np.zeros(len(names))
    score[linked] = 1.0 / words[home[linked]]
    share = np.zeros(len(names))
    share[linked] = 1.0 / degree[linked]
    for _ in range(ROUNDS):
        score = np.bincount(at, times * (score * share)[to], len(names)) * DAMPING + (1 - DAMPING)
    unit = np.floor(score[linked] * SCORE_UNIT + 0.5).astype(np.int64)
    order = np.lexsort((names[linked] % many, -unit, home[linked]))
    starts = np.cumsum(words) - words
    first = np.arange(len(order)) - starts[home[linked][order]] < top_n
    best = order[first]
    ends = np.concatenate([[0], np.cumsum(np.minimum(words, top_n))])
    ranked = pa.StructArray.from_arrays(
        [terms.take(pa.array(names[linked][best] % many)).cast(pa.string()), pa.array(unit[best] / SCORE_UNIT, pa.float64())],
        ["term", "score"],
    )
    missing = tokens.is_null().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ranked, mask=pa.array(missing))


def _slices(tokens: pa.ListArray) -> Iterator[pa.ListArray]:
    """Neighbouring token lists together up to ``RANKED_TOKENS`` tokens, or a single longer one."""
    counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > RANKED_TOKENS:
            yield tokens.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(tokens):
        yield tokens.slice(at)


def textrank(
    tokens: Column, *, top_n: int = 10, stopwords: Sequence[str] = (), min_length: int = 2
) -> Column:
    """Ranked ``array<struct<term, score>>`` of one review's full token list.

    The word graph of a review lives in its own row, so the whole ranking is one projection:
    no shuffle, and a long review costs only its own length; numpy iterates the graphs of some rows
    together. Candidates are words of at least ``min_length`` characters that are no stopwords; two
    candidates less than ``SPAN`` tokens apart share an edge. Scores equal to six digits are ties, term
    ascending, so the order does not depend on the order of floating-point additions.
    """
    stop = pa.array(sorted(set(stopwords)), pa.string())
    kind = pa.list_(pa.struct([("term", pa.string()), ("score", pa.float64())]))

    def run(lists: pa.Array) -> pa.Array:
        ranked = [_rank(part, stop, min_length, top_n).cast(kind) for part in _slices(lists)]
        return pa.concat_arrays(ranked) if ranked else pa.array([], kind)

    return F.arrow_udf(run, "array<struct<term: string, score: double>>")(tokens)


def textrank_keywords(
    docs: DataFrame,
    key: Sequence[str],
    *,
    text: str = "clean_text",
    top_n: int = 10,
    stopwords: Sequence[str] = (),
    tokenizer: Tokenizer = tokenize,
) -> DataFrame:
    """TextRank keywords as rows ``(key..., rank, term, score)``."""
    best = textrank(tokenizer(F.col(text)), top_n=top_n, stopwords=stopwords)
    ranked = docs.select(*key, F.posexplode_outer(best).alias("_at", "_kw"))
    return ranked.filter(F.col("_at").isNotNull()).select(
        *key, (F.col("_at") + 1).alias("rank"), F.col("_kw.term").alias("term"),
        F.col("_kw.score").alias("score"),
    )


def document_terms(
    docs: DataFrame, key: Sequence[str], by: Sequence[str] = (), tokens: str = "tokens"
) -> DataFrame:
    """``(by..., key..., term, tf)``; counted inside the row, so nothing is shuffled."""
    rows = unfold(docs, [*by, *key], term_counts(F.col(tokens)), "_t")
    return rows.select(
        *by, *key, F.col("_t.term").alias("term"), F.col("_t.n").cast("long").alias("tf")
    )


def doc_frequency(
    docs: DataFrame,
    key: Sequence[str],
    by: Sequence[str] = (),
    *,
    tokens: str = "tokens",
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    terms: DataFrame | None = None,
) -> DataFrame:
    """Vocabulary ``(by..., term, df, n_docs)`` inside the document-frequency bounds; ``terms`` are the document terms, if stored."""
    terms = document_terms(docs, key, by, tokens) if terms is None else terms
    df = terms.groupBy(*by, "term").agg(F.count("*").alias("df"))
    if by:
        sizes = docs.groupBy(*by).agg(F.count("*").alias("n_docs"))
        df = df.join(sizes, list(by))
    else:
        df = df.withColumn("n_docs", docs.agg(F.count("*")).scalar())
    return df.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))


def tfidf_keywords(
    docs: DataFrame,
    key: Sequence[str],
    by: Sequence[str] = (),
    *,
    tokens: str = "tokens",
    top_n: int = 20,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """Top terms by the sum of their L2-normalised tf-idf over the documents of a group.

    idf = ln((1 + N) / (1 + df)) + 1 with raw counts as tf. Scores are rounded to six digits
    before ranking, ties by term. ``frequencies`` is a vocabulary counted before, as
    ``DocumentFrequencies`` keeps it; without it the documents are counted here.
    """
    terms = materialize(document_terms(docs, key, by, tokens), "rows")  # texts are cut once, for counts and weights
    if frequencies is None:
        frequencies = doc_frequency(docs, key, by, tokens=tokens, terms=terms)
    idf = F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    vocabulary = materialize(
        frequencies.select(*by, "term", "df", idf.alias("idf")),
        "vocabulary",
    )
    weighted = split_heavy_join(terms, vocabulary, [*by, "term"], "df", stored=True).withColumn("w", F.col("tf") * F.col("idf"))
    per_doc = Window.partitionBy(*by, *key)
    unit = weighted.withColumn(
        "u", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_doc))
    )
    scores = unit.groupBy(*by, "term").agg(F.round(F.sum("u"), 6).alias("score"))
    best = top_n_per_group(scores, by, [F.desc("score"), F.asc("term")], top_n)
    return best.select(*by, "rank", "term", "score")
