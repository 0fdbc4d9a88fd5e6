"""Segmentation with a dictionary of any size: most probable words, and tags for what no word covers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lattice import Tags, Trie, cheapest, expected_counts, longest
from ..functions.tokens import Tokenizer, remove_stopwords
from ..session import materialize, widen
from .rows import unfold

#: Costs are -ln of a share, in units of this fraction.
SCALE = 1_000_000
#: Texts are cut together up to this many characters, as what a cut holds in memory is many times its texts.
CUT_CHARS = 1 << 18
#: Terms are sent along up to this many characters in all (a beginning of one takes 16 bytes); more are joined to the texts.
SENT_CHARS = 4_000_000
TAGS = "BMES"

Cut = Callable[[list[str], Trie], list[list[str]]]


def cost_of(share: Column) -> Column:
    return F.round(-F.ln(share) * SCALE).cast("long")


def word_costs(counts: DataFrame, n: str = "n") -> tuple[DataFrame, int]:
    """(term, cost) from counted terms, and the cost of a character that no term has: a count of one."""
    total = counts.agg(F.sum(n).cast("double").alias("total"), cost_of(1 / F.sum(n)).alias("unknown")).first()
    if not total.total:
        return counts.select("term", F.lit(0).cast("long").alias("cost")).limit(0), 0
    kept = counts.filter(F.col(n) > 0)
    return kept.select("term", cost_of(F.col(n) / F.lit(total.total)).alias("cost")), total.unknown


def _groups(texts: pa.Array, most: int = CUT_CHARS) -> Iterator[list[str]]:
    """All texts in order, a few at a time: up to ``most`` characters, or a single longer text."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text.as_py()
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _udf(cut: Cut, trie) -> Callable[[Column], Column]:
    """Equal texts of a batch are cut once."""

    def run(texts: pa.Array) -> pa.Array:
        coded = texts.fill_null("").dictionary_encode()
        kind = pa.list_(pa.string())
        lists = [pa.array(cut(group, trie.value), kind) for group in _groups(coded.dictionary)]
        return (pa.concat_arrays(lists) if lists else pa.array([], kind)).take(coded.indices)

    return F.arrow_udf(run, "array<string>")


def _lattice_cut(unknown: int, letters: bool, tags: Tags | None) -> Cut:
    """Most probable words; the words of short runs are kept as long as the trie is the same."""
    held: list = [None, {}]

    def cut(texts: list[str], trie: Trie) -> list[list[str]]:
        if held[0] is not trie:
            held[:] = [trie, {}]
        return cheapest(texts, trie, unknown, letters, tags, held[1])

    return cut


def _row_udf(cut: Cut) -> Callable[..., Column]:
    """The same with each row's own terms."""

    def run(texts: pa.Array, terms: pa.Array, costs: pa.Array) -> pa.Array:
        rows = zip(texts.fill_null("").to_pylist(), terms.to_pylist(), costs.to_pylist())
        return pa.array([cut([t], Trie.build(w or [], c or []))[0] for t, w, c in rows], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def _small(dictionary: DataFrame, most: int) -> bool:
    size = dictionary.agg(F.sum(F.char_length("term"))).first()[0]
    return (size or 0) <= most


def _sent(dictionary: DataFrame):
    rows = dictionary.select("term", "cost").collect()  # counted before
    trie = Trie.build([r.term for r in rows], [r.cost for r in rows])
    return dictionary.sparkSession.sparkContext.broadcast(trie)


def _cut_docs(docs: DataFrame, key: Sequence[str], dictionary: DataFrame, cut: Cut, text: str, tokens: str, most: int) -> DataFrame:
    """``docs`` with ``tokens``. Beyond ``most`` characters of terms, each text is joined with the terms it holds."""
    words = materialize(dictionary.filter("term <> ''").groupBy("term").agg(F.min("cost").alias("cost")), "words")
    if _small(words, most):
        return docs.withColumn(tokens, _udf(cut, _sent(words))(F.col(text)))
    # beginnings of two characters first: only where a term may begin is longer text taken
    heads = F.array_distinct(F.concat(*[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)) for p in (r"(?s)(.)", r"(?s)(?=(..))")]))
    starts = words.groupBy(F.substring("term", 1, 2).alias("_head")).agg(F.collect_set(F.char_length("term")).alias("_sizes"))
    at = unfold(docs, [*key, text], heads, "_head").join(starts, "_head")
    quoted = F.concat(F.lit("\\Q"), F.replace("_head", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    rest = F.concat(F.lit(".{"), F.greatest(F.col("_size") - 2, F.lit(0)).cast("string"), F.lit("}"))
    found = F.regexp_extract_all(F.col(text), F.concat(F.lit("(?s)(?=("), quoted, rest, F.lit("))")), F.lit(1))
    sized = at.select(*key, text, "_head", F.explode("_sizes").alias("_size"))
    pieces = sized.select(*key, F.explode(F.array_distinct(found)).alias("term")).distinct()
    own = pieces.join(words, "term").groupBy(*key).agg(F.collect_list(F.struct("term", "cost")).alias("_own"))
    both = docs.join(own, list(key), "left")
    return both.withColumn(tokens, _row_udf(cut)(F.col(text), F.col("_own.term"), F.col("_own.cost"))).drop("_own")


def tokenize_lattice(
    docs: DataFrame, key: Sequence[str], counts: DataFrame, *, text: str = "clean_text", letters: bool = False,
    stopwords: Sequence[str] = (), tokens: str = "tokens", tags: Tags | None = None, sent_chars: int = SENT_CHARS,
) -> DataFrame:
    """``docs`` plus ``tokens``: the most probable words by a dictionary ``(term, n)`` with the counts of its terms.

    Runs of Han characters, with ``letters`` also runs of letters and digits, are cut; elsewhere a token is such a
    run, or a mark. ``tags`` cut stretches of single characters further. A null text has no tokens. ``key`` must
    be unique.
    """
    dictionary, unknown = word_costs(counts)
    cut = _lattice_cut(unknown, letters, tags)
    out = _cut_docs(docs, key, dictionary, cut, text, tokens, sent_chars)
    return out.withColumn(tokens, remove_stopwords(F.col(tokens), stopwords))


def tokenize_longest(
    docs: DataFrame, key: Sequence[str], dictionary: DataFrame, *, text: str = "clean_text",
    stopwords: Sequence[str] = (), tokens: str = "tokens", sent_chars: int = SENT_CHARS,
) -> DataFrame:
    """``docs`` plus ``tokens`` by longest match over a table ``(term)`` of any size; ``key`` must be unique."""
    out = _cut_docs(docs, key, dictionary.select("term", F.lit(0).cast("long").alias("cost")), longest, text, tokens, sent_chars)
    return out.withColumn(tokens, remove_stopwords(F.col(tokens), stopwords))


def longest_tokenizer(dictionary: DataFrame) -> Tokenizer:
    """Longest match as a column function, for ``TextOptions``; the terms are sent along."""
    words = dictionary.select("term", F.lit(0).cast("long").alias("cost")).distinct()
    return _udf(longest, _sent(_bounded(words)))


def lattice_tokenizer(counts: DataFrame, letters: bool = False, tags: Tags | None = None) -> Tokenizer:
    """Most probable words as a column function, for ``TextOptions``; the terms are sent along."""
    dictionary, unknown = word_costs(counts)
    return _udf(_lattice_cut(unknown, letters, tags), _sent(_bounded(dictionary)))


def _bounded(words: DataFrame) -> DataFrame:
    words = materialize(words, "words")
    if not _small(words, SENT_CHARS):
        raise ValueError("too many terms to send along: use tokenize_lattice or tokenize_longest")
    return words


# -- learning -----------------------------------------------------------------


def counted_runs(docs: DataFrame, runs: str, text: str = "clean_text") -> DataFrame:
    """(run, n) of all runs that fit a pattern."""
    found = unfold(docs, [], F.regexp_extract_all(F.col(text), F.lit(f"(?U){runs}"), F.lit(0)), "run")
    return found.groupBy("run").agg(F.count("*").alias("n"))


def reestimate(runs: DataFrame, counts: DataFrame, rounds: int = 1) -> DataFrame:
    """(term, n) after expectation steps: how often a term is met on all paths through the runs (run, n), by their probability."""
    spark = runs.sparkSession
    runs = materialize(widen(runs.select("run", F.col("n").cast("long").alias("n")), "run"), "runs")
    for _ in range(rounds):
        dictionary, unknown = word_costs(counts)
        trie = _sent(_bounded(dictionary))

        def expect(batches: Iterator[pa.RecordBatch], trie=trie, unknown=unknown) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = expected_counts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), trie.value, unknown, SCALE)
                yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.string()), "n": pa.array(found.values(), pa.float64())})

        met = runs.mapInArrow(expect, "term string, n double").groupBy("term").agg(F.sum("n").alias("n"))
        counts = materialize(met, "counts")
    return counts


def word_tags(words: Column) -> Column:
    """The tags of a list of words, one for each character."""
    middle = lambda w: F.repeat(F.lit("M"), F.char_length(w) - 2)
    tag = lambda w: F.when(F.char_length(w) == 1, F.lit("S")).otherwise(F.concat(F.lit("B"), middle(w), F.lit("E")))
    return F.array_join(F.transform(words, tag), "")


def tag_counts(segmented: DataFrame) -> DataFrame:
    """(tag, before, char, n) over runs (words, n): ``before`` is the tag of the character before, empty at a run's start.

    Each is counted for all characters of a place, so that sums over it give what a model needs.
    """
    rows = segmented.select("n", F.split(F.array_join("words", ""), "").alias("chars"), F.split(word_tags(F.col("words")), "").alias("tags"))
    place = F.transform("chars", lambda c, i: F.struct(
        F.get("tags", i).alias("tag"), F.coalesce(F.get("tags", i - 1), F.lit("")).alias("before"), c.alias("char")))
    each = rows.select("n", F.explode_outer(place).alias("at")).filter("at.tag IS NOT NULL")
    return each.groupBy("at.tag", "at.before", "at.char").agg(F.sum("n").cast("long").alias("n"))


def learn_tags(segmented: DataFrame) -> Tags:
    """A tag model from runs (words, n) as a segmentation has cut them; one is added to every count that can be.

    What is collected has a row for each tag and different character.
    """
    counts = materialize(tag_counts(segmented), "tag_counts")
    chars = counts.groupBy("tag", "char").agg(F.sum("n").alias("n"))
    kinds = chars.agg(F.count_distinct("char")).first()[0] or 0
    size = {r.tag: r.n for r in chars.groupBy("tag").agg(F.sum("n").alias("n")).collect()}
    totals = F.create_map(*[x for t in TAGS for x in (F.lit(t), F.lit(float(size.get(t, 0) + kinds + 1)))])
    priced: dict[str, dict[str, int]] = {}
    for row in chars.select("tag", "char", cost_of((F.col("n") + 1) / totals[F.col("tag")]).alias("cost")).collect():
        priced.setdefault(row.char, {})[row.tag] = row.cost
    spark = segmented.sparkSession
    steps = {(r.before, r.tag): r.n for r in counts.groupBy("before", "tag").agg(F.sum("n").alias("n")).collect()}
    following = {"": "BS", "B": "ME", "M": "ME", "E": "BS", "S": "BS"}
    shares = [(b, t, (steps.get((b, t), 0) + 1) / (sum(steps.get((b, x), 0) for x in to) + 2)) for b, to in following.items() for t in to]
    shares += [("unseen", t, 1 / (size.get(t, 0) + kinds + 1)) for t in TAGS]
    price = {(r.b, r.t): r.cost for r in spark.createDataFrame(shares, "b string, t string, share double").select("b", "t", cost_of(F.col("share")).alias("cost")).collect()}
    never = 1 << 50
    unseen = tuple(price["unseen", t] for t in TAGS)
    return Tags(
        tuple(price.get(("", t), never) for t in TAGS),
        tuple(tuple(price.get((b, t), never) for t in TAGS) for b in TAGS),
        {c: tuple(own.get(t, unseen[k]) for k, t in enumerate(TAGS)) for c, own in priced.items()},
        unseen,
    )
