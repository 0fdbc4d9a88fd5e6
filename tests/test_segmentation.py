"""Dictionary segmentation against patterns, enumeration and itself over another plan."""

import itertools
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from revlake.functions import lattice
from revlake.functions.lattice import Tags, Trie, cheapest, expected_counts, longest
from revlake.functions.tokens import segment, segment_words, token_pattern
from revlake.operators.segmentation import (
    SCALE, counted_runs, lattice_tokenizer, learn_tags, longest_tokenizer, reestimate, tag_counts, tokenize_lattice, tokenize_longest,
    word_costs,
)
from revlake.plans.reviews import TextOptions

ALPHABET = "ab的手机好é1 \n,。-\\E😀"


def words_of(rng, n, size=4, alphabet="ab的手机好1"):
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, size))) for _ in range(n)})


def test_longest_equals_the_pattern(spark):
    rng = random.Random(3)
    terms = words_of(rng, 40) + [", a", "\\E", "😀好"]
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", "   "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    want = [r[0] for r in df.select("k", segment(F.col("t"), token_pattern(terms)).alias("x")).orderBy("k").select("x").collect()]
    assert longest(texts, Trie.build(terms, [0] * len(terms))) == want
    table = spark.createDataFrame([(t,) for t in [*terms, ""]], "term string")
    for most in (10**6, 0):  # terms sent along, and joined to the texts
        got = tokenize_longest(df, ["k"], table, text="t", sent_chars=most)
        assert [r.tokens for r in got.orderBy("k").collect()] == want


def test_more_terms_than_a_pattern_takes(spark):
    rng = random.Random(8)
    terms = [f"词{i}号" for i in range(30_000)] + ["手机", "手机壳"]
    df = spark.createDataFrame([("我的手机壳词29999号好abc",), (None,)], "t string")
    cut = [["我", "的", "手机壳", "词29999号", "好", "abc"], []]
    assert [r[0] for r in df.select(segment_words(F.col("t"), terms)).collect()] == cut
    options = TextOptions(terms=tuple(terms), stopwords=("的",))
    assert df.select(options.segment(F.col("t"))).first()[0] == cut[0]
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    assert [r[0] for r in df.select(longest_tokenizer(table)(F.col("t"))).collect()] == cut
    trie = Trie.build(terms, list(range(len(terms))))
    codes, _ = lattice._codes(["词12号"])
    at, size, cost = trie.hits(codes, lattice.np.array([4] * 4))
    assert (at.tolist(), size.tolist(), cost.tolist()) == ([0], [4], [12])  # true hits only
    assert rng.random() < 1


def paths(run, prices, unknown):
    """All ways to cut a run, with their costs."""
    if not run:
        yield 0, ()
        return
    for k in range(1, len(run) + 1):
        price = prices.get(run[:k], unknown if k == 1 else None)
        if price is not None:
            for rest, words in paths(run[k:], prices, unknown):
                yield price + rest, (run[:k], *words)


def test_cheapest_path_equals_enumeration(spark):
    rng = random.Random(5)
    for letters in (False, True):
        terms = words_of(rng, 25)
        prices = {t: rng.randint(1, 9) for t in terms}
        trie = Trie.build(list(prices), list(prices.values()))
        runs = ["".join(rng.choice("的手机好" if not letters else "ab1") for _ in range(rng.randint(1, 9))) for _ in range(120)]
        for run, words in zip(runs, cheapest(runs, trie, 6, letters)):
            best = min(paths(run, prices, 6), key=lambda p: (p[0], [-len(w) for w in p[1]]))
            assert tuple(words) == best[1]
    mixed = cheapest(["手机ab ,好1"], Trie.build(["手机", "ab", "b"], [1, 1, 1]), 9)
    assert mixed == [["手机", "ab", ",", "好", "1"]]


def test_lattice_sent_or_joined(spark):
    rng = random.Random(6)
    counts = spark.createDataFrame([(t, rng.randint(1, 50)) for t in words_of(rng, 60)], "term string, n int")
    texts = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(500, None)]
    df = spark.createDataFrame(texts, "k int, t string")
    sent = rows(tokenize_lattice(df, ["k"], counts, text="t", letters=True, stopwords=["好"]))
    assert sent == rows(tokenize_lattice(df, ["k"], counts, text="t", letters=True, stopwords=["好"], sent_chars=0))
    assert not any("好" in r[2] for r in sent) and (500, None, []) in sent
    direct = df.select("k", "t", lattice_tokenizer(counts, letters=True)(F.col("t")).alias("x"))
    assert [[w for w in r.x if w != "好"] for r in direct.orderBy("k").collect()] == [r[2] for r in sorted(sent, key=lambda r: r[0])]
    assert tokenize_lattice(df, ["k"], counts.limit(0), text="t").count() == len(texts)


def test_expected_counts_equal_enumeration(spark):
    rng = random.Random(7)
    prices = {t: rng.randint(1, 3) * SCALE // 2 for t in words_of(rng, 20, 3, "abc")}
    runs = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(30)]
    want: dict = {}
    for run in runs:
        every = [(math.exp(-c / SCALE), words) for c, words in paths(run, prices, 2 * SCALE)]
        total = sum(w for w, _ in every)
        for w, words in every:
            for word in words:
                if word in prices:
                    want[word] = want.get(word, 0) + 2 * w / total
    got = expected_counts(runs, [2] * len(runs), Trie.build(list(prices), list(prices.values())), 2 * SCALE, SCALE)
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)


def test_reestimation_finds_the_words(spark):
    docs = spark.createDataFrame([("手机很好",), ("好手机",), ("手机",), ("机手",)] * 5, "clean_text string")
    counts = spark.createDataFrame([("手机", 1), ("机很", 1), ("很好", 1), ("好手", 1)], "term string, n int")
    met = {r.term: r.n for r in reestimate(counted_runs(docs, r"\p{IsHan}+"), counts, rounds=4).collect()}
    assert met["手机"] > 14 and met.get("机很", 0) < 1 and met.get("好手", 0) < 1


def test_tags_equal_enumeration(spark):
    rng = random.Random(9)
    data = [(["手机", "好"], 3), (["好", "好看的", "手"], 2), (["机", "看的"], 1)]
    words = spark.createDataFrame(data, "words array<string>, n int")
    counts = {(r.tag, r.before, r.char): r.n for r in tag_counts(words).collect()}
    assert counts[("B", "", "手")] == 3 and counts[("E", "B", "机")] == 3 and counts[("M", "B", "看")] == 2 and counts[("S", "E", "手")] == 2
    tags = learn_tags(words)
    for _ in range(200):
        text = "".join(rng.choice("手机好看的新") for _ in range(rng.randint(2, 6)))
        best = None
        for path in itertools.product(range(4), repeat=len(text)):
            if path[-1] not in (2, 3):
                continue
            cost = tags.start[path[0]] + sum(tags.chars.get(c, tags.unseen)[t] for c, t in zip(text, path))
            cost += sum(tags.after[a][b] for a, b in zip(path, path[1:]))
            key = (cost, path[::-1])
            best = min(best, key) if best else key
        spelled = "".join("BMES"[t] for t in best[1][::-1])
        cut = tags.cut(text)
        assert "".join("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E" for w in cut) == spelled and "".join(cut) == text
    assert isinstance(tags, Tags) and cheapest(["新手机很好"], Trie.build(["很"], [1]), 10, tags=tags)[0][-2:] != []


def test_costs_of_nothing(spark):
    none, unknown = word_costs(spark.createDataFrame([], "term string, n int"))
    assert none.count() == 0 and unknown == 0


def test_texts_are_cut_a_few_at_a_time():
    """A batch is not held whole: what is cut together has a bound, and only a longer text is alone."""
    from revlake.operators import segmentation

    texts = ["ab" * 10, "", "c" * 70, "dd", "e" * 30, "f" * 31]
    parts = list(segmentation._groups(pa.array(texts), 60))
    assert [t for part in parts for t in part] == texts
    assert all(len(part) == 1 or sum(map(len, part)) <= 60 for part in parts)

    sizes = []

    def cut(group, trie):
        sizes.append(sum(map(len, group)))
        return [list(t) for t in group]

    class Sent:
        value = None

    long = [chr(97 + i % 26) * 1000 + str(i) for i in range(1000)]
    out = segmentation._udf(cut, Sent).func if hasattr(segmentation._udf(cut, Sent), "func") else None
    assert out is not None
    assert out(pa.array([*long, None, long[0]])).to_pylist() == [list(t) for t in [*long, "", long[0]]]
    assert max(sizes) <= segmentation.CUT_CHARS and len(sizes) > 1


def test_equal_runs_are_cut_once(monkeypatch):
    """Whatever texts are cut together, or before, each gets the words it gets alone."""
    trie = lattice.Trie.build(["ab", "abc", "cd", "汉字", "字"], [5, 7, 4, 3, 9])
    texts = ["abcd x abcd", "abcd,汉字汉x", "", "  ", "汉字汉", "zabcd\tabcd!?", "q" * 60, "abcd " + "q" * 60]
    cut, plain = [], lattice._cheapest_run
    monkeypatch.setattr(lattice, "_cheapest_run", lambda edges, lo, hi, unknown: cut.append(hi - lo) or plain(edges, lo, hi, unknown))
    for letters in (True, False):
        alone = [lattice.cheapest([t], trie, 6, letters)[0] for t in texts]
        cut.clear()
        known = {}
        assert lattice.cheapest(texts, trie, 6, letters, known=known) == alone
        assert len(cut) == (5 if letters else 1)  # abcd, x, 汉字汉, zabcd, q...; or the run of Han characters
        cut.clear()
        assert lattice.cheapest(texts, trie, 6, letters, known=known) == alone
        assert cut == ([60] if letters else [])  # a long run is not kept
        monkeypatch.setattr(lattice, "KNOWN_RUNS", 0)
        assert lattice.cheapest(texts, trie, 6, letters, known=known) == alone
        monkeypatch.undo()
        monkeypatch.setattr(lattice, "_cheapest_run", lambda edges, lo, hi, unknown: cut.append(hi - lo) or plain(edges, lo, hi, unknown))
