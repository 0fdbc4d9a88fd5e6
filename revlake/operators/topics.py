"""Topics of a corpus by variational inference over tables.

Every (document, term) holds its share of each topic. A round sums the shares by document and by term and sets each
anew from these sums, its own part left out (collapsed variational updates of order zero).

Up to ``SENT`` sums by term, a round is one pass over the documents, without a shuffle of pairs: see ``functions.shares``.
Beyond, the sums by term are a table split by term, and pairs are joined with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.shares import LONE, RANGE, STATE, TOTALS, Rounds, Sums, Terms, added, term_hash
from ..functions.tokens import term_counts
from ..session import materialize, remove_path, scratch_path, scratch_scope
from .joins import split_heavy_join
from .keywords import MAX_DF, MIN_DF, doc_frequency
from .ranking import top_n_per_group
from .rows import unfold

SCHEMA = "topic int, rank int, term string, weight double"
#: The share of the topic that a pair starts with; the rest is even.
START = 0.9
HEX = 8
#: Sums by term (terms of several documents x topics) that are sent to the tasks: 160 MB.
SENT = 20_000_000
#: Terms whose sums of all rounds are sent along, so that their shares need not be stored.
FREQUENT = 1 << 17


def _first_topic(key: Sequence[str], k: int) -> Column:
    """A topic for each (document, term) that any engine can compute."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in (*key, "term")])
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HEX), 16, 10).cast("long") % k


def _sums(prefix: str, k: int) -> list[Column]:
    return [F.sum(F.col("tf") * F.col(f"p{j}")).alias(f"{prefix}{j}") for j in range(k)]


def _by_joins(terms: DataFrame, vocabulary: DataFrame, key: Sequence[str], k: int, max_iter: int, size: int) -> DataFrame:
    """(term, w0, w1...) after all rounds, pairs being joined with the sums by term."""
    spark = terms.sparkSession
    prior = 1.0 / k
    shares = [f"p{j}" for j in range(k)]
    path = scratch_path(spark, "pairs")
    with scratch_scope(spark):  # the copy of a join is needed no longer than its result is written
        terms = split_heavy_join(terms, vocabulary.withColumnRenamed("df", "n_docs"), ["term"], "n_docs")
        own = _first_topic(key, k)
        even = (1 - START) / k
        pairs = terms.select(*key, "term", "tf", own.alias("own"))
        pairs = pairs.select(*key, "term", "tf", *[F.when(F.col("own") == j, START + even).otherwise(even).alias(p) for j, p in enumerate(shares)])
        pairs = materialize(pairs, path=path)
    per_doc = Window.partitionBy(*key)
    for _ in range(max_iter):
        before, path = path, scratch_path(spark, "pairs")
        with scratch_scope(spark):
            by_term = materialize(pairs.groupBy("term").agg(*_sums("w", k), F.count("*").alias("n_docs")), "by_term")
            totals = by_term.agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(k)]).first()  # a number for each topic
            by_doc = pairs.select("*", *[F.sum(F.col("tf") * F.col(p)).over(per_doc).alias(f"d{j}") for j, p in enumerate(shares)])
            both = split_heavy_join(by_doc, by_term, ["term"], "n_docs")

            def weight(j: int) -> Column:
                p = F.col(f"p{j}")
                rest = F.lit(totals[f"w{j}"]) - p + size * prior
                return (F.col(f"d{j}") - p + prior) * (F.col(f"w{j}") - p + prior) / rest

            raised = both.select(*key, "term", "tf", *[weight(j).alias(f"u{j}") for j in range(k)])
            whole = sum((F.col(f"u{j}") for j in range(1, k)), F.col("u0"))
            pairs = materialize(raised.select(*key, "term", "tf", *[(F.col(f"u{j}") / whole).alias(p) for j, p in enumerate(shares)]), path=path)
        remove_path(spark, before)  # what a round wrote goes with it
    return pairs.groupBy("term").agg(*_sums("w", k))


def _hashed(counted: DataFrame) -> tuple[DataFrame, int]:
    """(term, df, inside, hash) without a null term, and a salt under which no two terms share a hash."""
    for salt in count():

        def run(batches: Iterator[pa.RecordBatch], salt=salt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = [int.from_bytes(term_hash(t.encode(), salt), "big", signed=True) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h, pa.int64())], names=[*batch.schema.names, "hash"])

        named = counted.filter("term IS NOT NULL").select("term", "df", "inside")
        coded = materialize(named.mapInArrow(run, "term string, df long, inside boolean, hash long"), "terms")
        if coded.count() == coded.select("hash").distinct().count():
            return coded, salt


def _numbered(coded: DataFrame, salt: int) -> Terms:
    """Terms of several documents, by falling frequency, and those outside the bounds; both were counted before."""
    several = coded.filter("inside AND df > 1").select("hash", "df").toArrow()
    left_out = coded.filter("NOT inside").select("hash").toArrow()
    h, df = (several.column(c).to_numpy() for c in ("hash", "df"))
    number = np.empty(len(h), np.int64)
    number[np.lexsort((h, -df))] = np.arange(len(h))
    order = np.argsort(h)
    return Terms(h[order], number[order], left_out.column("hash").to_numpy(), salt)


def _by_passes(rows: DataFrame, coded: DataFrame, salt: int, k: int, max_iter: int, size: int) -> DataFrame:
    """(term, w0, w1...) after all rounds, each of them one pass over the documents of ``rows`` (doc, name, terms)."""
    spark = rows.sparkSession
    context = spark.sparkContext
    terms = _numbered(coded, salt)
    shared, by_number = len(terms.hashes), terms.hashes[np.argsort(terms.number)]
    sent = context.broadcast(terms)
    step = lambda last: Rounds(k, START, size, shared, FREQUENT, last)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(not max_iter).coded(batches, sent.value)

    def ranges(state: DataFrame) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            part, w = added(table, k)
            return pa.table({"part": pa.array([part], pa.int32()), "w": pa.array([np.ascontiguousarray(w).tobytes()], pa.binary())})

        parts = state.filter(f"part >= {TOTALS}").select("part", "ids", "w")
        return parts.groupBy("part").applyInArrow(run, "part int, w binary")

    path = scratch_path(spark, "pairs")
    state = materialize(rows.repartition("doc").sortWithinPartitions("doc").mapInArrow(first, STATE), path=path)
    sums = Sums()
    for done in range(max_iter):
        table, total = np.zeros((k, shared + 1)), np.zeros(k)  # the last column is for terms of one document
        for part, w in ranges(state).collect():
            if part == TOTALS:
                total = np.frombuffer(w)
            else:
                at = part * RANGE
                end = min(at + RANGE, shared)
                table[:, at:end] = np.frombuffer(w).reshape(-1, k)[: end - at].T
        kept = min(FREQUENT, shared)
        frequent = np.concatenate([table[:, :kept], np.zeros((k, 1))], axis=1)
        sums = Sums((*sums.frequent, frequent), (*sums.totals, total), table)
        given = context.broadcast(sums)

        def again(batches: Iterator[pa.RecordBatch], given=given, last=done == max_iter - 1) -> Iterator[pa.RecordBatch]:
            yield from step(last).run(batches, given.value)

        before, path = path, scratch_path(spark, "pairs")
        documents = state.filter("part IS NULL")
        state = materialize(documents.mapInArrow(again, STATE), path=path)
        given.destroy()
        remove_path(spark, before)
    columns = [f"w{j}" for j in range(k)]
    names = context.broadcast(by_number)
    kind = f"hash long, {', '.join(f'{c} double' for c in columns)}"

    def table_of(h: np.ndarray, w: np.ndarray) -> dict:
        return {"hash": h, **{c: np.ascontiguousarray(w[:, j]) for j, c in enumerate(columns)}}

    def several(table: pa.Table) -> pa.Table:
        part, w = added(table, k)
        h = names.value[part * RANGE : (part + 1) * RANGE]
        return pa.table(table_of(h, w[: len(h)]))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict(table_of(np.frombuffer(h, np.int64), np.frombuffer(w).reshape(-1, k)))

    parts = state.filter("part >= 0").select("part", "ids", "w").groupBy("part").applyInArrow(several, kind)
    alone = state.filter(f"part = {LONE}").select("ids", "w").mapInArrow(single, kind)
    return coded.filter("inside").select("term", "hash").join(parts.unionByName(alone), "hash").drop("hash")


def lda_topics(
    docs: DataFrame,
    key: Sequence[str],
    *,
    tokens: str = "tokens",
    n_topics: int = 5,
    top_n: int = 8,
    max_iter: int = 10,
) -> DataFrame:
    """``(topic, rank, term, weight)``: the first terms of at most one topic per document.

    ``key`` tells documents apart. Weights are the topics' smoothed term shares, rounded to six digits
    before ranking, ties by term. Both priors are 1 / topics. Documents without a term of the vocabulary
    (document frequency bounds as elsewhere) play no part; without any the result is empty.
    """
    spark = docs.sparkSession
    n_docs = docs.count()
    k = min(n_topics, n_docs) or 1
    prior = 1.0 / k
    with scratch_scope(spark):
        path = scratch_path(spark, "rows")
        named = [F.col(c).cast("string") for c in key]
        doc, name = F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(named)])), F.concat_ws("|", *named, F.lit(""))
        rows = docs.select(*key, doc.alias("doc"), name.alias("name"), term_counts(F.col(tokens)).alias("terms"))
        rows = materialize(rows, path=path)  # texts are cut once
        terms = unfold(rows, key, "terms", "_t").select(*key, F.col("_t.term").alias("term"), F.col("_t.n").cast("long").alias("tf"))
        every = doc_frequency(docs, key, tokens=tokens, min_df=0, max_df=float("inf"), terms=terms)
        inside = F.col("df").between(MIN_DF, F.lit(MAX_DF) * n_docs)
        counted = materialize(every.select("term", "df", inside.alias("inside")), "counted")
        size, several = counted.agg(F.count_if("inside"), F.count_if(F.col("inside") & (F.col("df") > 1))).first()
        if not size:
            return spark.createDataFrame([], SCHEMA)
        if several * k <= SENT:
            coded, salt = _hashed(counted)
            found = _by_passes(rows.select("doc", "name", "terms"), coded, salt, k, max_iter, size)
        else:
            found = _by_joins(terms, counted.filter("inside").select("term", "df"), key, k, max_iter, size)
        by_term = materialize(found, "by_term")
        totals = by_term.agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(k)]).first()
        each = F.array(*[
            F.struct(F.lit(j).alias("topic"), ((F.col(f"w{j}") + prior) / (F.lit(totals[f"w{j}"]) + size * prior)).alias("weight"))
            for j in range(k)
        ])
        weights = by_term.select("term", F.inline(each)).withColumn("weight", F.round("weight", 6))
        best = top_n_per_group(weights, ["topic"], [F.desc("weight"), F.asc("term")], top_n)
        rows = best.select("topic", "rank", "term", "weight").collect()  # topics x top_n
    return spark.createDataFrame(rows, SCHEMA)
