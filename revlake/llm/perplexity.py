"""Quality rules with an n-gram perplexity: a modified Kneser-Ney model of each language's text.

The model predicts the words of a text, with a space after each, byte by byte from the four bytes before, also across
words, so its n-grams are exact 64-bit keys and the order of words matters. Spark counts the n-grams of the whole corpus and computes
all probabilities; tasks that score look keys up in sorted arrays. A document's perplexity is per
byte. In each language, documents outside a band around the quartiles are rejected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .words import Words, bounded_batches, shingles

ORDER = 5
SYMBOLS = 256  # what a prediction can be
REPEAT_WORDS = 8
#: Bands reach so many interquartile ranges (of log perplexity, in thousandths, at least LEAST_RANGE) beyond the quartiles.
REACH, LEAST_RANGE = 3, 30
#: Tables with a row for each language are sent along up to so many rows.
FEW_LANGUAGES = 10_000
#: The model's arrays, counted before, are sent to the tasks up to so many bytes; above, n-grams are scored by a join.
BROADCAST_BYTES = 96 << 20
_FLUSH = 1 << 20
_SLICE = 1 << 20


def _grams(words: Words, chosen: np.ndarray, per_row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed n-grams that end at each byte of the chosen words or at the space after, with the number of their row.

    ``per_row`` has the number of words of each row. Slices of bounded size are packed one after another.
    """
    size = words.end[chosen] - words.start[chosen]
    lead = np.zeros(len(size), np.int64)
    first = np.cumsum(per_row) - per_row
    lead[first[per_row > 0]] = ORDER - 1  # spaces before a text
    begin = np.cumsum(lead + size + 1) - size - 1
    flat = np.full(int((lead + size + 1).sum()), 0x20, np.uint8)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat[inside + np.repeat(begin, size)] = words.data[inside + np.repeat(words.start[chosen], size)]
    row = np.repeat(np.repeat(np.arange(len(per_row), dtype=np.int32), per_row), lead + size + 1)
    made = np.ones(len(flat), bool)
    at = np.flatnonzero(lead)
    for k in range(1, ORDER):
        made[begin[at] - k] = False
    for lo in range(ORDER - 1, len(flat), _SLICE):
        hi = min(lo + _SLICE, len(flat))
        packed = np.zeros(hi - lo, np.int64)
        for k in range(ORDER):
            packed |= flat[lo - k : hi - k].astype(np.int64) << (8 * k)
        yield packed[made[lo:hi]], row[lo:hi][made[lo:hi]]


def _by_language(languages: list, per_row: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Language, its rows, and the positions of their words."""
    rows = defaultdict(list)
    for i, lang in enumerate(languages):
        rows[lang].append(i)
    end = np.cumsum(per_row)
    for lang, own in rows.items():
        own = np.array(own)
        n = per_row[own]
        yield lang, own, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(end[own] - n, n)


def _lang() -> Column:
    return F.coalesce("lang", F.lit("")).alias("lang")


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, c): how often each n-gram of the highest order occurs. A null language is the empty one."""
    bounded_batches(docs.sparkSession)

    def flush(kept: dict) -> Iterator[pa.RecordBatch]:
        for lang, parts in kept.items():
            gram, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(c)], ["lang", "gram", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = defaultdict(list), 0
        for batch in batches:
            words = Words(batch.column(1))
            for lang, own, at in _by_language(batch.column(0).to_pylist(), words.per_row):
                for grams, _ in _grams(words, at, words.per_row[own]):
                    gram, times = np.unique(grams, return_counts=True)
                    kept[lang].append((gram, times))
                    held += len(gram)
                    if held > _FLUSH:
                        yield from flush(kept)
                        kept, held = defaultdict(list), 0
        yield from flush(kept)

    rows = docs.filter("text IS NOT NULL").select(_lang(), "text")
    return rows.mapInArrow(run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): what modified Kneser-Ney takes from counts of 1, 2, and 3 or more.

    Where a count of counts is missing, so that the estimate is undefined or negative, 1/2, 1 and 3/2 stand for it.
    """
    n = [F.sum(F.when(F.col("c") == k, 1.0).otherwise(0.0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    counts = grams.groupBy("lang").agg(*n)
    usual = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    y = F.try_divide(F.col("n1"), F.expr("n1 + 2 * n2"))
    own = [F.lit(k) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")) for k in (1, 2, 3)]
    fine = usual & reduce(lambda a, b: a & b, [(d > 0) & (d < k) for k, d in zip((1, 2, 3), own)])
    return counts.select("lang", *[F.when(fine, d).otherwise(k / 2).alias(f"d{k}") for k, d in zip((1, 2, 3), own)])


def _by_lang(rows: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """A join with a table of one row for each language, which is sent along, so that rows are not dealt out by language."""
    few = materialize(few, "languages")
    return rows.join(F.broadcast(few) if few.count() <= FEW_LANGUAGES else few, "lang", how)


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(lang, part, key, value) of the interpolated model: part 2k has ln P of k-grams, part 2k+1 ln of what a context leaves to order k-1.

    Lower orders count the different symbols before an n-gram. All orders are Spark aggregations and joins.
    """
    orders = {ORDER: materialize(grams, "grams")}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")
        orders[k] = materialize(orders[k + 1].select("lang", suffix).groupBy("lang", "gram").agg(F.count("*").alias("c")), "grams")
    parts, lower = [], None
    for k in range(1, ORDER + 1):
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = _by_lang(orders[k], _discounts(orders[k])).withColumn("d", F.least(discount, F.col("c")))
        own = own.withColumn("context", F.shiftright("gram", 8))
        contexts = own.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
        contexts = contexts.withColumn("gamma", F.col("left") / F.col("total"))
        rows = own.join(contexts, ["lang", "context"]).withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1))
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / SYMBOLS))
        else:
            rows = rows.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        lower = materialize(rows.select("lang", "gram", (F.expr("(c - d) / total + gamma * below")).alias("p")), "probabilities")
        parts.append(lower.select("lang", F.lit(2 * k).alias("part"), F.col("gram").alias("key"), F.log("p").alias("value")))
        parts.append(contexts.select("lang", F.lit(2 * k + 1).alias("part"), F.col("context").alias("key"), F.log("gamma").alias("value")))
    return reduce(DataFrame.unionByName, parts)


class GramModel:
    """Sorted key arrays with their values, by language and part."""

    def __init__(self, model: DataFrame):
        """Collects the model part by part, so that the driver holds little beyond the arrays."""
        self.arrays: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for part in range(2, 2 * ORDER + 2):
            table = model.filter(F.col("part") == part).select("lang", "key", "value").toArrow().combine_chunks()
            if not table.num_rows:
                continue
            lang = table.column("lang").combine_chunks().dictionary_encode()
            number, key, value = lang.indices.to_numpy(), table.column("key").to_numpy(), table.column("value").to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                own = np.flatnonzero(number == k)
                own = own[np.argsort(key[own])]
                self.arrays[name, part] = key[own], value[own]

    def _find(self, lang: str, part: int, keys: np.ndarray) -> np.ndarray:
        """Values of keys, NaN where there is none."""
        known, value = self.arrays.get((lang, part), (np.zeros(1, np.int64), np.full(1, np.nan)))
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        return np.where(known[at] == keys, value[at], np.nan)

    def log_probabilities(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """ln P of each n-gram's last symbol; orders without the n-gram leave it to the next lower one."""
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            key = grams[open_] & ((1 << 8 * k) - 1)
            found = self._find(lang, 2 * k, key)
            miss = np.isnan(found)
            out[open_[~miss]] += found[~miss]
            open_ = open_[miss]
            left = self._find(lang, 2 * k + 1, key[miss] >> 8)
            out[open_] += np.nan_to_num(left)
            if not len(open_):
                return out
        out[open_] -= np.log(SYMBOLS)
        return out


def _repeated_words(own: np.ndarray) -> int:
    """Words in windows (their hashes in order) that occur twice or more."""
    _, at, times = np.unique(own, return_inverse=True, return_counts=True)
    if len(times) == len(own):
        return 0
    twice = np.flatnonzero(times[at] > 1)
    step = np.zeros(len(own) + REPEAT_WORDS, np.int64)
    step[twice] += 1
    step[twice + REPEAT_WORDS] -= 1
    return int(np.count_nonzero(np.cumsum(step)))


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _measures(words: Words, texts: list[str | None]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words by row."""
    at = words.offsets
    chars = np.r_[0, np.cumsum(words.solid & ((words.data & 0xC0) != 0x80))]
    symbols = np.r_[0, np.cumsum(_SYMBOL[words.data])]
    lines, repeats = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        seen = set()
        for line in (text or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                lines[i] += line in seen
                seen.add(line)
    h, number = shingles(words.hashes(), words.per_row, REPEAT_WORDS)
    end = np.cumsum(number)
    for i in np.flatnonzero(words.per_row > REPEAT_WORDS):
        repeats[i] = _repeated_words(h[end[i] - number[i] : end[i]])
    return [words.per_row.astype(np.int64), np.diff(chars[at]), np.diff(symbols[at]), lines, repeats]


def _scored(docs: DataFrame, model) -> DataFrame:
    """The measures of each row with lp (ln probability, null without ``model``) and bytes (predictions made)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value if model is not None else None
        for batch in batches:
            column = batch.column(3)
            words = Words(column)
            made = (words.end - words.start + 1).astype(np.int64)
            events = np.diff(np.r_[0, np.cumsum(made)][np.r_[0, np.cumsum(words.per_row)]])
            lp = np.zeros(batch.num_rows)
            if own is not None:
                for lang, rows, at in _by_language(batch.column(2).to_pylist(), words.per_row):
                    for grams, row in _grams(words, at, words.per_row[rows]):
                        gram, place = np.unique(grams, return_inverse=True)
                        lp[rows] += np.bincount(row, weights=own.log_probabilities(lang, gram)[place], minlength=len(rows))
            measures = _measures(words, column.to_pylist())
            yield pa.record_batch([*(batch.column(k) for k in range(3)), *map(pa.array, measures), pa.array(lp), pa.array(events)], names)

    names = ["doc_id", "th", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lp", "bytes"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), _lang(), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, lang string, {', '.join(f'{n} long' for n in names[3:8])}, lp double, bytes long")


def _joined_scores(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, th, lang, lp) by a join of each document's n-grams with the model, for a model that is too large to send."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(3))
            for gram, row in _grams(words, np.arange(len(words.start)), words.per_row):
                order = np.lexsort((gram, row))
                gram, row = gram[order], row[order]
                first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])][: len(gram)])
                keep = pa.array(row[first])
                times = np.diff(np.r_[first, len(gram)])
                yield pa.record_batch([*(batch.column(k).take(keep) for k in range(3)), pa.array(gram[first]), pa.array(times)], ["doc_id", "th", "lang", "key", "n"])

    rows = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), _lang(), "text").distinct()
    kind = rows.schema["doc_id"].dataType.simpleString()
    grams = rows.mapInArrow(run, f"doc_id {kind}, th long, lang string, key long, n long")
    # the model has all n-grams of the corpus it was counted on
    known = model.filter(F.col("part") == 2 * ORDER).select("lang", "key", "value")
    return grams.join(known, ["lang", "key"]).groupBy("doc_id", "th", "lang").agg(F.sum(F.col("n") * F.col("value")).alias("lp"))


def bands(scores: DataFrame) -> DataFrame:
    """(lang, low, high) of log perplexity in thousandths, from exact quartiles of each language's documents that pass the base rules."""
    bins = scores.filter("NOT base_failed").groupBy("lang", "milli").agg(F.count("*").alias("n"))
    up = Window.partitionBy("lang").orderBy("milli")  # a few thousand bins at most
    spread = bins.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
    quarter = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("milli"))).alias(f"q{k}") for k in (1, 3)]
    reach = F.greatest(F.expr("q3 - q1"), F.lit(LEAST_RANGE)) * REACH
    return spread.groupBy("lang").agg(*quarter).select("lang", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def quality_rules(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Base measures, perplexity and verdict of every row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under 20 words, or more than 30 % of
    the words in repeated eight-word windows), kept, lang and perplexity (null without words). kept needs the base rules passed and a
    perplexity inside the language's band. Null and empty texts have no words and fail. A null language is one
    language of its own (the empty one). Null ids and repeated rows stay, and each row counts in the model. Extra columns are not read.
    """
    spark = docs.sparkSession
    model = materialize(kneser_ney(count_grams(docs)), "model")
    if model.count() * 20 <= broadcast_bytes:
        rows = _scored(docs, spark.sparkContext.broadcast(GramModel(model)))
    else:
        lp = _joined_scores(docs, model).toDF("id", "hash", "language", "joined")
        rows = _scored(docs, None)
        same = rows["doc_id"].eqNullSafe(lp["id"]) & (rows["th"] == lp["hash"]) & (rows["lang"] == lp["language"])
        rows = rows.join(lp, same, "left").withColumn("lp", F.coalesce("joined", F.lit(0.0))).drop("id", "hash", "language", "joined")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    log_perplexity = F.when(F.col("bytes") > 0, -F.col("lp") / F.col("bytes"))
    rows = rows.withColumn("base_failed", failed).withColumn("milli", F.round(log_perplexity * 1000).cast("int"))
    rows = materialize(rows, "scores")
    judged = _by_lang(rows, bands(rows), "left")
    inside = F.coalesce((F.col("milli") >= F.col("low")) & (F.col("milli") <= F.col("high")), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "lang", F.round(F.exp(F.col("milli") / 1000), 3).alias("perplexity"),
    )
