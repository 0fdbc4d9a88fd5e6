"""Quality classifier: ordinal regression with cumulative links over hashed text features.

Ratings are grades 0 (toxic), 1 (poor) and 2 (good). All grades share one weight per hashed feature;
ordered thresholds cut the sum of a document's weights into grades: P(grade > k) = sigmoid(score - t_k).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import bounded_batches

BITS = 18
#: The model is fitted on so many rated documents at most (those of the smallest hash of their id); this bounds the driver's memory.
MAX_RATED = 8000
#: A feature counts if so many of the rated documents have it.
MIN_DOCUMENTS = 4
GRADES = 3
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_PLAIN = re.compile(r"[\w'’-]*+[.,;:?)\"]*+$").match  # possessive: linear in words of any length
_LETTERS = re.compile(r"[^\W\d_]+").findall
#: Beginnings of words that are features besides the whole words.
PREFIXES = (4, 6)
#: Letter runs longer than this, or in a script without spaces, also give all their character n-grams.
LONG_RUN, GRAMS = 40, (2, 4, 6)
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]").search
#: Words that are longer or have more features are not remembered.
KNOWN_LENGTH, KNOWN_PARTS = 200, 32
MEMORY = 200_000


def _shape(word: str) -> str:
    """Form of a word without its letters: case, digits and the marks around it."""
    kind = "A" if word.isupper() and len(word) > 1 else "a"
    marks = "".join(c for c in word if not c.isalnum())[:4]
    return f"{kind}{'9' if any(map(str.isdigit, word)) else ''}{marks}"


class Features:
    """Hashed features of texts: lower-cased letter runs, their beginnings and the n-grams of glued ones (once per text) and shares of word shapes, repeats and symbols."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[list[int], int]] = {}

    def word(self, word: str) -> tuple[list[int], int]:
        found = self.known.get(word)
        if found is None:
            runs = _LETTERS(word.lower())
            parts = {r[:k] for r in runs for k in PREFIXES}.union(runs)
            for r in runs:
                if len(r) > LONG_RUN or _UNSPACED(r):
                    parts.update(r[i : i + k] for k in GRAMS for i in range(len(r) - k + 1))
            found = [crc32(r.encode()) & ((1 << BITS) - 1) for r in parts], crc32(b"\0shape " + _shape(word).encode()) & ((1 << BITS) - 1)
            if len(word) > KNOWN_LENGTH or len(parts) > KNOWN_PARTS:
                return found
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word] = found
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers (ascending) and values."""
        words = _WORDS(text)
        n = len(words)
        own: set[int] = set()
        shapes: dict[int, int] = {}
        word, distinct = self.word, {}
        for w in words:
            distinct[w] = distinct.get(w, 0) + 1
        for w, k in distinct.items():
            runs, shape = word(w)
            own.update(runs)
            shapes[shape] = shapes.get(shape, 0) + k
        value = dict.fromkeys(own, 1.0)
        for s, k in shapes.items():
            value[s] = value.get(s, 0.0) + 4.0 * k / n
        marked = sum(k for w, k in distinct.items() if not _PLAIN(w))
        if n:
            value[_REPEATED] = 4.0 * (1 - len(distinct) / n)
            value[_MARKED] = 6.0 * marked / n
            value[_SHORT] = 4.0 * min(1.0, 20 / n)
        number = np.fromiter(value, np.int64, len(value))
        order = np.argsort(number)
        return number[order], np.fromiter(value.values(), np.float64, len(value))[order]


_REPEATED, _SHORT, _MARKED = (crc32(x) & ((1 << BITS) - 1) for x in (b"\0repeated", b"\0short", b"\0marked"))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, as columns."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def _fit(numbers: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, rounds: int = 150, decay: float = 2e-3) -> OrdinalModel:
    """Maximum likelihood by gradient steps with a running scale; thresholds stay ordered through positive gaps."""
    sizes = np.array([len(x) for x in numbers])
    col, val = np.concatenate(numbers), np.concatenate(values)
    often = np.bincount(col, minlength=1 << BITS) >= min(MIN_DOCUMENTS, max(1, len(grades) // 2))
    place = np.cumsum(often) - 1
    keep = often[col]
    row = np.repeat(np.arange(len(grades)), sizes)[keep]
    col, val = place[col[keep]], val[keep]
    n, dim = len(grades), int(often.sum())
    weight = n / (GRADES * np.maximum(1, np.bincount(grades, minlength=GRADES)))[grades]  # grades count alike
    weight = np.sqrt(weight)
    w, t = np.zeros(dim), np.array([-1.0, np.log(2.0)])  # t0 and the log of each gap
    first, second = np.zeros(dim + 2), np.zeros(dim + 2)
    for step in range(1, rounds + 1):
        score = np.bincount(row, weights=w[col] * val, minlength=n)
        cut = np.array([-np.inf, t[0], t[0] + np.exp(t[1]), np.inf])
        z_low, z_high = np.clip(cut[grades] - score, -30, 30), np.clip(cut[grades + 1] - score, -30, 30)
        low, high = 1 / (1 + np.exp(-z_low)), 1 / (1 + np.exp(-z_high))
        # d log(F(high) - F(low)) / d score = F(low) + F(high) - 1 for the logistic link
        pull = weight * (1 - low - high)
        grad_w = np.bincount(col, weights=pull[row] * val, minlength=dim) / n + decay * w
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = weight * high * (1 - high) / p, -weight * low * (1 - low) / p
        by_cut = [-(d_high[grades == k].sum() + d_low[grades == k + 1].sum()) / n for k in range(2)]
        grad = np.r_[grad_w, by_cut[0] + by_cut[1], by_cut[1] * np.exp(t[1])]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[:dim], t - move[dim:]
    full = np.zeros(1 << BITS)
    full[often] = w
    return OrdinalModel(full, np.array([t[0], t[0] + np.exp(t[1])]))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, grade): toxic is 0, else 1 + quality. Rows without an id, text or both ratings are left out."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min(grade).alias("grade"))
    return docs.select("doc_id", "text").filter("text IS NOT NULL").join(known, "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED) -> OrdinalModel:
    """Model of the ratings, fitted on ``max_rated`` rated documents at most, chosen by a hash of their ids.

    Of several texts (or ratings) of one id the text with the smallest hash counts. Without any rating the model
    gives every document the middle of the scale and keeps it.
    """
    known = labels.select("doc_id", "quality", "toxic").filter("doc_id IS NOT NULL").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    sample = rated(docs, chosen)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            pairs = [features.of(t) for t in batch.column(1).to_pylist()]
            packed = [pa.array([k.astype(kind).tobytes() for k in side], pa.binary()) for side, kind in ((([p[0] for p in pairs]), np.int32), ([p[1] for p in pairs], np.float32))]
            yield pa.record_batch([batch.column(0), *packed, batch.column(2)], ["doc_id", "numbers", "shares", "grade"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    first = F.min(F.struct(F.xxhash64("text"), "text", "grade")).alias("row")
    sample = sample.groupBy("doc_id").agg(first).select("doc_id", "row.text", "row.grade")
    rows = sample.mapInArrow(run, f"doc_id {kind}, numbers binary, shares binary, grade int")
    # bounded by max_rated documents; in order of ids, so that sums do not depend on the partitions
    got = sorted(rows.collect(), key=lambda r: r["doc_id"])
    if not got:
        return OrdinalModel(np.zeros(1 << BITS), np.array([-2.0, -1.0]))
    numbers = [np.frombuffer(r["numbers"], np.int32).astype(np.int64) for r in got]
    values = [np.frombuffer(r["shares"], np.float32).astype(np.float64) for r in got]
    return _fit(numbers, values, np.array([r["grade"] for r in got]))


def grade_documents(docs: DataFrame, model: OrdinalModel, tail: float = 0.5) -> DataFrame:
    """doc_id, th (hash of the text), expected_grade, p_toxic, p_good and kept (p_good >= ``tail``) for every row.

    Null and empty texts have no features: their score is 0 and they are never kept. Null ids and
    repeated rows stay as they are; other columns are not read. Scores are rounded to six digits.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(OrdinalModel(model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = shared.value, Features()
        for batch in batches:
            score = np.zeros(batch.num_rows)
            full = np.zeros(batch.num_rows, bool)
            for i, t in enumerate(batch.column(2).to_pylist()):
                number, value = features.of(t or "")
                full[i] = len(number) > 0
                score[i] = np.dot(own.weights[number].astype(np.float64), value)
            tails = own.tails(score)
            columns = [
                batch.column(0), batch.column(1), pa.array(np.round(tails.sum(axis=1), 6)),
                pa.array(np.round(1 - tails[:, 0], 6)), pa.array(np.round(tails[:, -1], 6)), pa.array(full & (tails[:, -1] >= tail)),
            ]
            yield pa.record_batch(columns, ["doc_id", "th", "expected_grade", "p_toxic", "p_good", "kept"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, expected_grade double, p_toxic double, p_good double, kept boolean")


def keep_good(docs: DataFrame, model: OrdinalModel, tail: float = 0.5) -> DataFrame:
    """``docs`` without the rejected ones. All columns and repeated rows stay."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(OrdinalModel(model.weights.astype(np.float32), model.thresholds))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = shared.value, Features()
        for batch in batches:
            keep = []
            for t in batch.column(names.index("text")).to_pylist():
                number, value = features.of(t or "")
                score = np.array([np.dot(own.weights[number].astype(np.float64), value)])
                keep.append(len(number) > 0 and own.tails(score)[0, -1] >= tail)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
