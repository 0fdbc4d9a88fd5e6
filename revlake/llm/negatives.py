"""Hard-negative mining by a secondary sort.

An anchor's scores are exact integer inner products with all rows. Scored pairs are packed into keys
(anchor, falling score, id), dealt out by anchor and sorted inside each partition by Spark. One pass streams
over the sorted pairs: a row with the anchor's label opens a window below its own score, any other row is
given to all open windows that it lies in and are not full. No anchor's pairs are ever held together.

Not every pair is worth a key. Rows and anchors are packed into blocks, a task scores one block of either, and
lets go what cannot be in the result: all but its best ``positives`` per anchor, and, once those are known for
all blocks, all but the best ``negatives`` per anchor and window. Neither loses a row of the result,
since the best of all rows are among the best of each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .vectors import scaled, usable
from .words import bounded_batches

FACTOR = 256
BELOW = 2.0**17  # components of this size or more take no part
BLOCK_ROWS = 8192
BLOCK_BYTES = 4 << 20
TILE = 1 << 20  # scores held at once
BROADCAST_BYTES = 32 << 20
NONE = np.iinfo(np.int64).min
BLOCK = "block long, ids binary, labels binary, vectors binary, scores binary"
PAIR = "anchor_id long, down long, kind int, id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Rules(NamedTuple):
    """A negative's score is between ``low`` and ``high`` per cent of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def _pack(rows: DataFrame, length: int, positives: int) -> DataFrame:
    """Blocks of rows, in order of their ids, as long as bytes and ``BLOCK_ROWS`` allow; scores pad to ``positives``."""
    most = max(64, min(BLOCK_ROWS, BLOCK_BYTES // (4 * length)))

    def block(number: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, scores: np.ndarray) -> dict:
        order = np.argsort(ids, kind="stable")
        out = {"ids": ids, "labels": labels, "vectors": vectors, "scores": scores}
        return {"block": number, **{k: v[order].tobytes() for k, v in out.items()}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            padded = np.full((batch.num_rows, positives), NONE)
            for at, own in enumerate(batch.column(3).to_pylist() if positives else ()):
                padded[at, : len(own)] = own
            held.append(
                (
                    batch.column(0).to_numpy(), batch.column(1).to_numpy(),
                    scaled(batch.column(2), length, FACTOR).astype(np.int32), padded,
                )
            )
            size += batch.num_rows
            while size >= most:
                whole = [np.concatenate(x) for x in zip(*held)]
                yield pa.RecordBatch.from_pylist([block(number, *(x[:most] for x in whole))])
                held, size, number = [tuple(x[most:] for x in whole)], size - most, number + 1
        if size:
            yield pa.RecordBatch.from_pylist([block(number, *(np.concatenate(x) for x in zip(*held)))])

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector", "scores").mapInArrow(run, BLOCK)


def _paired(blocks: DataFrame, anchors: DataFrame, parallel: int) -> DataFrame:
    """Every block of rows beside every block of anchors: anchors sent along if they are small, else both dealt by pair."""
    held = anchors.agg(F.count("*").alias("n"), F.sum(F.length("vectors")).alias("size")).first()
    order = anchors.select("block", F.row_number().over(Window.orderBy("block")).alias("at"))  # a row for each block
    right = anchors.join(order, "block").select("at", *[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    each = F.explode(F.sequence(F.lit(1), F.lit(max(1, held.n))))
    if (held.size or 0) <= BROADCAST_BYTES:
        return blocks.repartition(parallel).withColumn("at", each).join(F.broadcast(right), "at").drop("at")
    salts = max(1, parallel // held.n)
    left = blocks.withColumn("at", each).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.repartition(max(parallel, held.n), "at", "salt").join(right, ["at", "salt"]).drop("at", "salt")


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest entries of each row that are not NONE; of equal ones the first columns."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, [-k]]
        chosen = (scores >= least) & (scores != NONE)
        if (chosen.sum(axis=1) > k).any():
            above = chosen & (scores > least)
            tied = chosen & ~above
            chosen = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1)[:, None]))
    else:
        chosen = scores != NONE
    return np.nonzero(chosen)


def _scored(pairs: DataFrame, length: int, rules: Rules, windows: bool) -> DataFrame:
    """PAIR rows of every block pair: the best positives, or (``windows``) the best negatives of each window."""

    def blocks(row: dict, prefix: str) -> tuple[np.ndarray, ...]:
        vectors = np.frombuffer(row[f"{prefix}vectors"], np.int32).reshape(-1, length)
        return np.frombuffer(row[f"{prefix}ids"], np.int64), np.frombuffer(row[f"{prefix}labels"], np.int64), vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, vectors = blocks(row, "")
                anchors, own, centre = blocks(row, "a_")
                known = np.frombuffer(row["a_scores"], np.int64).reshape(len(anchors), -1)
                big = float(np.abs(vectors).max()) * float(np.abs(centre).max()) * length
                kind = np.float64 if big < 2.0**53 else np.int64  # either is exact
                across = vectors.T.astype(kind)
                step = max(1, TILE // len(ids))
                for lo in range(0, len(anchors), step):
                    at = slice(lo, lo + step)
                    scores = (centre[at].astype(kind) @ across).astype(np.int64)
                    same = own[at, None] == labels
                    if windows:
                        scores[same] = NONE
                        chosen = np.zeros(scores.shape, bool)
                        for w in range(known.shape[1]):
                            tops, there = known[at, w].tolist(), known[at, w] != NONE
                            least = np.array([-(-rules.low * s // 100) if s != NONE else 0 for s in tops])
                            most = np.array([rules.high * s // 100 if s != NONE else 0 for s in tops])
                            inside = (scores >= least[:, None]) & (scores <= most[:, None]) & there[:, None]
                            chosen[_best(np.where(inside, scores, NONE), rules.negatives)] = True
                        i, j = np.nonzero(chosen)
                    else:
                        scores[~same | (anchors[at, None] == ids)] = NONE
                        i, j = _best(scores, rules.positives)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchors[at][i]), pa.array(-scores[i, j]),
                            pa.array(np.full(len(i), int(windows), np.int32)), pa.array(ids[j]),
                        ],
                        names=["anchor_id", "down", "kind", "id"],
                    )

    return pairs.mapInArrow(run, PAIR)


def _stream(rules: Rules):
    """One pass over pairs sorted by (anchor, falling score, positives first, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out: list[tuple] = []
            for a, down, kind, other in zip(*(c.to_pylist() for c in batch.columns)):
                if a != anchor:
                    anchor, windows = a, []
                score = -down
                if kind == 0:
                    if len(windows) < rules.positives:
                        windows.append([other, score, 0])
                    continue
                for window in windows:
                    positive, top, given = window
                    if given < rules.negatives and rules.low * top <= 100 * score <= rules.high * top:
                        window[2] = given + 1
                        out.append((a, positive, given + 1, other, top, score))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)],
                    names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
                )

    return run


def hard_negatives(rows: DataFrame, anchor: Column, rules: Rules = Rules(), vector: str = "embedding") -> DataFrame:
    """RESULT for each row that ``anchor`` selects, from rows (vec_id, label, ``vector``).

    An anchor's positives are its first rows of the same label by falling score, then id, the anchor's own id
    left out; a positive's negatives the first rows of another label inside its window. Rows with a null id,
    label or vector take no part, nor do vectors that ``usable`` refuses. Repeated rows each take a place of
    their own; anchors that share an id count once, by their smallest label and vector. Extra columns are
    not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    named = rows.select("vec_id", "label", F.col(vector).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    kept, length = usable(named.filter("vec_id IS NOT NULL AND label IS NOT NULL"), "vector", BELOW)
    if not length:
        return spark.createDataFrame([], RESULT)
    none = F.expr("cast(array() AS array<long>)")
    blocks = materialize(_pack(kept.withColumn("scores", none), length, 0).drop("scores"), "blocks")
    chosen = kept.filter("is_anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    chosen = materialize(chosen.select("vec_id", "row.label", "row.vector"), "anchors")
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    groups = max(1, -(-chosen.count() // max(64, min(BLOCK_ROWS, BLOCK_BYTES // (4 * length)))))

    def anchor_blocks(frame: DataFrame, width: int, name: str) -> DataFrame:
        return materialize(_pack(frame.repartition(groups, "vec_id"), length, width), name)

    first = _scored(_paired(blocks, anchor_blocks(chosen.withColumn("scores", none), 0, "anchor_blocks"), parallel), length, rules, False)
    best = F.row_number().over(Window.partitionBy("anchor_id").orderBy("down", "id"))
    positives = materialize(first.withColumn("place", best).filter(F.col("place") <= rules.positives).drop("place"), "positives")
    known = positives.groupBy("anchor_id").agg(F.collect_list(-F.col("down")).alias("scores"))
    armed = chosen.join(known, chosen.vec_id == known.anchor_id).drop("anchor_id")
    second = _scored(_paired(blocks, anchor_blocks(armed, rules.positives, "windows"), parallel), length, rules, True)
    pairs = positives.unionByName(second).repartition(parallel, "anchor_id")
    return pairs.sortWithinPartitions("anchor_id", "down", "kind", "id").mapInArrow(_stream(rules), RESULT)
