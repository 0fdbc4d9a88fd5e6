"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

An item is contained in a document if at least a share of its five-word shingles occur there. A
sketch of an item is its smallest shingle hashes (a bottom-k MinHash). With k = (missing shingles that
the share allows) + 1, a document that contains the item holds at least one hash of the sketch, however
long the document is: sketches lose nothing. Items are partitioned by size, so that each
partition needs the sketch depth of its own upper size only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import Words, bounded_batches, rows_of, shingles

SIZE = 5
SHARE = 80  # per cent of an item's shingles
#: Up to so many bytes, counted before, the sketches are sent to the tasks; above, they are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def shingle_rows(texts: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """``key`` and the distinct shingle hashes of each row's whole text, sorted (array of long)."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1), lower=True)
            h, number = shingles(words.hashes(), words.per_row, size)
            own = [np.unique(r.view(np.int64)) for r in rows_of(h, number)]
            yield pa.record_batch([batch.column(0), _lists(own)], [key, "shingles"])

    rows = texts.select(key, "text")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, shingles array<long>")


def _lists(own: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, own)])
    flat = np.concatenate(own) if own else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def item_sketches(items: DataFrame, share: int = SHARE) -> DataFrame:
    """Partition, size and sketch of each item: (item_id, part, n, shingle) with one row per sketch hash.

    Partition p holds the items of 2^p to 2^(p+1) - 1 shingles; their sketch is deep enough for the
    largest of them: no more than floor((100 - share) * n / 100) shingles may be missing.
    """
    n = F.size("shingles")
    part = F.length(F.bin(n)) - 1
    upper = F.pow(F.lit(2), part + 1).cast("long") - 1
    depth = F.floor(F.lit(100 - share) * upper / 100).cast("int") + 1
    # hashes are uniform, so the smallest are a random choice of shingles
    return items.select(
        "item_id", part.alias("part"), n.alias("n"), F.explode(F.slice("shingles", 1, depth)).alias("shingle")
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs of a document and a benchmark item in it: doc_id, item_id, n_shingles, n_found (see ``leak_rows``)."""
    found = leak_rows(docs, benchmark, share, broadcast_bytes)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))


def leak_rows(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs of document and benchmark item that it contains: doc_id, th (hash of its text), item_id, n_shingles, n_found.

    Texts are compared by their lower-cased (A-Z) words; a text of fewer than five words is one
    shingle, so a shorter item is found only in a document of just these words. Null, empty and
    blank texts contain and match nothing; rows of null ids are found like others. Repeated rows give
    one pair. Items with one id and different texts are separate items. Extra columns are not read.

    Documents probe all sketches in one pass over their shingles. Documents with a hit are then read
    again and verified against all shingles of the items hit.
    """
    spark = docs.sparkSession
    named = benchmark.select("item_id", "text").filter("text IS NOT NULL").distinct()
    items = shingle_rows(named, "item_id").filter(F.size("shingles") > 0)
    # an item is told by its id and its shingles; the digest serves as its name
    items = items.select(F.struct("item_id", F.xxhash64("shingles").alias("h")).alias("item_id"), "shingles").distinct()
    items = materialize(items, "items")
    sketches = item_sketches(items, share)
    probe = sketches.select("shingle").distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").filter("text IS NOT NULL")
    sketch_count = probe.count()
    wanted = None
    if sketch_count * 8 <= broadcast_bytes:
        hashes = np.array([r[0] for r in probe.collect()], np.int64)
        wanted = spark.sparkContext.broadcast(np.sort(hashes))
    hits = _probe(rows, wanted)
    found = hits.join(sketches.select("item_id", "shingle"), "shingle").select("doc_id", "th", "item_id").distinct()
    found = materialize(found, "candidates")

    # exact: each candidate pair's shingles of the item against all of the document's
    suspects = found.select("doc_id", "th").distinct()
    same = rows["doc_id"].eqNullSafe(suspects["doc_id"]) & (rows["th"] == suspects["th"])
    again = rows.join(suspects, same, "left_semi").dropDuplicates(["doc_id", "th"])
    full = shingle_rows(again.select(F.struct("doc_id", "th").alias("row"), "text"), "row")
    full = full.select("row.doc_id", "row.th", F.col("shingles").alias("own"))
    pairs = found.join(items, "item_id").alias("p")
    both = pairs.join(full.alias("f"), F.expr("p.th = f.th AND p.doc_id <=> f.doc_id"))
    counted = both.select(
        F.col("p.doc_id").alias("doc_id"), F.col("p.th").alias("th"), F.col("item_id.item_id").alias("item_id"),
        F.size("shingles").cast("long").alias("n_shingles"),
        F.size(F.array_intersect("shingles", "own")).cast("long").alias("n_found"),
    )
    return counted.filter(F.col("n_found") * 100 >= F.col("n_shingles") * share)


def _probe(rows: DataFrame, wanted) -> DataFrame:
    """(doc_id, th, shingle) of the documents' shingles; only those in ``wanted``, if it is given."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value.view(np.uint64) if wanted is not None else None
        if table is not None:
            table = np.sort(table)
            bits = np.zeros(1 << 22, bool)  # by the top bits; most shingles end here
            bits[table >> np.uint64(42)] = True
        for batch in batches:
            words = Words(batch.column(2), lower=True)
            h, number = shingles(words.hashes(), words.per_row, SIZE)
            row = np.repeat(np.arange(len(number)), number)
            if table is not None:
                near = np.flatnonzero(bits[h >> np.uint64(42)])
                at = np.searchsorted(table, h[near])
                at[at == len(table)] = 0
                near = near[table[at] == h[near]] if len(table) else near[:0]
                h, row = h[near], row[near]
            keep = pa.array(row)
            yield pa.record_batch(
                [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(h.view(np.int64))],
                ["doc_id", "th", "shingle"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th long, shingle long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = SHARE) -> DataFrame:
    """``docs`` without those that contain a benchmark item. All columns, null and repeated rows stay."""
    leaks = leak_rows(docs, benchmark, share).select(F.col("doc_id").alias("leak_id"), "th").distinct()
    leaks = materialize(leaks, "leaks")
    same = docs["doc_id"].eqNullSafe(leaks["leak_id"]) & (F.xxhash64(docs["text"]) == leaks["th"])
    return docs.join(leaks, same, "left_anti")
