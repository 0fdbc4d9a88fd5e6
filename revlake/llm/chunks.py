"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes; where it is smallest among its neighbours a chunk ends. Both
depend on a few bytes only, so that after an insertion the old boundaries return and equal passages
get equal chunks wherever they stand. Chunks are deduplicated by digest: the document of the smallest id
keeps a chunk, in other documents it is a repeat. Repeats that follow each other form a span; spans
of enough words are passages to cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .words import Words, bounded_batches, mix, utf8

WINDOW = 16  # bytes the gear hash looks back at
RADIUS = 16  # a chunk ends where the hash is the smallest so far around: every 33 bytes on average, never under 17
#: Words of the chunks that lie whole in a passage worth cutting: those of over 50 words have more.
MIN_CORE_WORDS = 30
_GEAR = np.random.default_rng(4711).integers(0, 2**32, 256, dtype=np.uint32)
_VALUE = np.random.default_rng(4712).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint32(1 << WINDOW)
PIECE = 1 << 20
#: Where no hash is the smallest for so many bytes, as in text that repeats itself, chunks also end where it is one of several.
LARGEST = 64


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: the sum of the last WINDOW bytes' values, each doubled once per step since."""
    h = np.zeros(len(data), np.uint32)
    value = _GEAR[data]
    for back in range(min(WINDOW, len(data))):
        h[back:] += value[: len(data) - back] << np.uint32(back)
    return h


def _filled(ends: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """``ends`` with some of ``ties`` inside chunks over LARGEST, RADIUS bytes apart at least.

    In periodic text ties stand at one place of each period, so that equal stretches get equal chunks wherever they begin.
    """
    starts = np.r_[0, ends[:-1]]
    more = []
    for at in np.flatnonzero(ends - starts > LARGEST):
        last = starts[at]
        for tie in ties[np.searchsorted(ties, starts[at]) : np.searchsorted(ties, ends[at])].tolist():
            if tie - last > RADIUS:
                more.append(tie)
                last = tie
    return np.union1d(ends, more).astype(np.int64) if more else ends


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text (the last is its length), in pieces of bounded size."""
    ends, ties = [], []
    for at in range(0, len(data), PIECE):
        lead = min(at, WINDOW + RADIUS)
        h = gear(data[at - lead : at + PIECE + RADIUS]) & np.uint32((1 << WINDOW) - 1)
        wide = np.r_[np.full(RADIUS, _TOP), h, np.full(RADIUS, _TOP)]
        done = 1
        while done < RADIUS:  # smallest of the next RADIUS values
            step = min(done, RADIUS - done)
            wide[:-step] = np.minimum(wide[:-step], wide[step:])
            done += step
        before, after = wide[: len(h)], wide[RADIUS + 1 : RADIUS + 1 + len(h)]
        for found, least in ((ends, (h < before) & (h <= after)), (ties, (h <= before) & (h <= after))):
            found.append(np.flatnonzero(least[lead : lead + PIECE]) + at + 1)
    found = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    found = found if len(found) and found[-1] == len(data) else np.append(found, len(data))
    return _filled(found, np.concatenate(ties)) if ties else found


def _digests(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of the chunks between ``ends``."""
    starts = np.r_[0, ends[:-1]]
    size = ends - starts
    at = np.arange(ends[-1]) - np.repeat(starts, size)
    power = np.multiply.accumulate(np.full(int(size.max()), _STEP))
    return mix(np.add.reduceat(_VALUE[data] * power[at], starts) + size.astype(np.uint64))


def text_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, th, start, size, words, digest) of every chunk of every whole text, in bytes.

    ``words`` counts the words that begin in the chunk. Null and empty texts have no chunk.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            begins = Words(batch.column(2)).start
            rows, starts, sizes, words, digests = [], [], [], [], []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                if not len(own):
                    continue
                ends = boundaries(own)
                start = np.r_[0, ends[:-1]]
                rows.append(np.full(len(ends), i))
                starts.append(start)
                sizes.append(ends - start)
                words.append(np.diff(np.searchsorted(begins, np.r_[0, ends] + offsets[i])))
                digests.append(_digests(own, ends).view(np.int64))
            if rows:
                at = pa.array(np.concatenate(rows))
                columns = [np.concatenate(c).astype(k) for c, k in ((starts, np.int32), (sizes, np.int32), (words, np.int32), (digests, np.int64))]
                yield pa.record_batch(
                    [batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, columns)],
                    ["doc_id", "th", "start", "size", "words", "digest"],
                )

    rows = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, start int, size int, words int, digest long")


def repeated_spans(docs: DataFrame, min_core_words: int = MIN_CORE_WORDS) -> DataFrame:
    """Passages that repeat across documents: doc_id, th, start, size (bytes of the chunks), words, first_doc_id.

    A row is a longest run of chunks, each of which a document with a smaller id holds too; first_doc_id
    is the smallest of these. A run needs ``min_core_words`` words: a passage of over 50 words holds runs
    of that size, as the chunks at its ends are lost. Texts of one id count as one document; null ids come after all
    others. Repeated rows give the same rows once. Extra columns are not read.

    Chunks are counted before anything is joined; a digest found in one document only goes no further.
    """
    chunks = text_chunks(docs)
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")
    owner = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    shared = materialize(owner.filter("first <> last").select("digest", F.col("first.doc_id").alias("first_doc_id")), "shared_chunks")
    repeats = chunks.join(shared, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("first_doc_id")))
    own = Window.partitionBy("doc_id", "th").orderBy("start")
    repeats = repeats.select("doc_id", "th", "start", "size", "words", "first_doc_id").distinct()
    follows = F.lag(F.col("start") + F.col("size")).over(own)
    runs = repeats.withColumn("new", F.when(F.col("start") == follows, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(own))
    spans = runs.groupBy("doc_id", "th", "run").agg(
        F.min("start").alias("start"), F.sum("size").alias("size"), F.sum("words").alias("words"), F.min("first_doc_id").alias("first_doc_id")
    )
    return spans.filter(F.col("words") >= min_core_words).drop("run")


def cut_repeats(docs: DataFrame, min_core_words: int = MIN_CORE_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; characters that a span holds in part stay. Other columns and all rows stay."""
    bounded_batches(docs.sparkSession)
    spans = repeated_spans(docs, min_core_words).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("spans"))
    spans = materialize(spans.select(F.col("doc_id").alias("cut_id"), F.col("th").alias("cut_th"), "spans"), "spans")
    names = [*docs.columns, "_spans"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("row_th"))
    same = F.col("row.doc_id").eqNullSafe(F.col("cut_id")) & (F.col("row_th") == F.col("cut_th"))
    both = rows.join(spans, same, "left").select(*[F.col(f"row.`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, found in enumerate(batch.column(len(names) - 1).to_pylist()):
                if found:
                    raw, left, done = texts[i].encode(), b"", 0
                    for span in found:
                        left, done = left + raw[done : span["start"]], span["start"] + span["size"]
                    texts[i] = (left + raw[done:]).decode(errors="ignore")
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names) - 1)]
            yield pa.record_batch(columns, names[:-1])

    return both.mapInArrow(run, docs.schema)
