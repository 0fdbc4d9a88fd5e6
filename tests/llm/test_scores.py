"""Quality classifier and perplexity rules."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from revlake.llm import perplexity
from revlake.llm.perplexity import LEAST_RANGE, ORDER, REACH, SYMBOLS, count_grams, kneser_ney, quality_rules
from revlake.llm.quality import Features, OrdinalModel, fit_quality, grade_documents, keep_good

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rated_texts(n, seed):
    """(doc_id, text, quality, toxic): toxic texts hold a bad word, poor ones have marks on their words."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        words = ["".join(r.choice("aeiounrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(30, 120))]
        kind = r.random()
        if kind < 0.2:
            words[r.randrange(len(words))] = r.choice(["badword", "Nasty,", "horrid."])
        elif kind < 0.4:
            words = [w + r.choice(["%%%", "$$$", "###"]) for w in words]
        rows.append((seed * 10_000 + k, " ".join(words), int(not 0.2 <= kind < 0.4), int(kind < 0.2)))
    return rows


@pytest.fixture(scope="module")
def rated_tables(spark, make_docs):
    train, held = rated_texts(700, 1), rated_texts(400, 2)
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in train], "doc_id long, quality int, toxic int")
    return make_docs([(i, t) for i, t, _, _ in train]), labels, held


def test_held_out_accuracy(rated_tables, make_docs):
    docs, labels, held = rated_tables
    model = fit_quality(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in grade_documents(make_docs([(i, t) for i, t, _, _ in held]), model).collect()}
    right = sum(got[i].kept == (q == 1 and t == 0) for i, _, q, t in held)
    assert right >= 0.97 * len(held)
    grades = defaultdict(list)
    for i, _, q, t in held:
        grades[0 if t else 1 + q].append(got[i].expected_grade)
    assert np.mean(grades[0]) < np.mean(grades[1]) < np.mean(grades[2])


def test_bound_on_rated_documents_and_no_ratings(rated_tables, make_docs):
    docs, labels, _ = rated_tables
    assert fit_quality(docs, labels, max_rated=50).weights.any()
    none = fit_quality(docs, labels.limit(0))
    kept = grade_documents(make_docs([(1, "some text"), (2, None), (3, "")]), none).collect()
    assert {r.doc_id: r.kept for r in kept} == {1: True, 2: False, 3: False}


def test_odd_rows_are_graded_and_kept_alike(make_docs, odd_pairs):
    model = OrdinalModel(np.zeros(1 << 18), np.array([-2.0, -1.0]))
    docs = make_docs(odd_pairs)
    graded = grade_documents(docs, model).collect()
    assert len(graded) == len(odd_pairs)
    left = keep_good(docs, model)
    assert left.schema == docs.schema
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((r.doc_id for r in graded if r.kept), key=repr)
    assert keep_good(make_docs([]), model).count() == 0


def test_words_are_features_at_any_place_of_a_glued_text():
    features, glued = Features(), "abcdefgh" * 500
    word = set(features.of("horrid")[0].tolist())
    shapes = set(features.of(glued)[0].tolist())
    assert word - shapes and word - shapes <= set(features.of(glued + "horrid" + glued)[0].tolist())
    plain, bad = "今天天气很好我们去公园" * 40, "可恶至极"
    assert len(set(features.of(plain + bad)[0]) - set(features.of(plain)[0])) >= 3
    assert features.of("a" * 200)[0].tolist() != features.of("a" * 200 + "!!!b")[0].tolist()


def padded_text(text):
    words = WORDS.findall(text or "")
    return b" " * (ORDER - 1) + " ".join(words).encode() + b" " if words else b""


def brute_log_probabilities(texts):
    """ln P of every n-gram by the textbook formula, on plain dictionaries."""
    counts = Counter()
    for text in texts:
        padded = padded_text(text)
        counts.update(padded[i : i + ORDER] for i in range(len(padded) - ORDER + 1))
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    p = {}
    for k in range(1, ORDER + 1):
        n = [sum(c == i for c in orders[k].values()) for i in (1, 2, 3, 4)]
        d = [0.5, 1.0, 1.5]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            own = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
            d = own if all(0 < x < i for i, x in zip((1, 2, 3), own)) else d
        total, left = Counter(), Counter()
        for g, c in orders[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += min(d[min(c, 3) - 1], c)
        for g, c in orders[k].items():
            below = p[g[1:]] if k > 1 else 1 / SYMBOLS
            p[g] = (c - min(d[min(c, 3) - 1], c)) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * below
    return p


def test_model_equals_the_textbook(make_docs):
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(40)) for _ in range(20)]
    model = kneser_ney(count_grams(make_docs(list(enumerate(texts))))).collect()
    want = brute_log_probabilities(texts)
    got = {(m.part // 2, m.key.to_bytes(ORDER, "big")[ORDER - m.part // 2 :]): m.value for m in model if m.part % 2 == 0}
    assert {(len(g), g) for g in want} == set(got)
    assert all(math.isclose(math.log(v), got[len(g), g], abs_tol=1e-9) for g, v in want.items())


def brute_measures(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def test_rules_equal_brute_force(make_docs, odd_pairs):
    r = random.Random(9)
    pairs = list(odd_pairs)
    for k in range(60):
        words = [r.choice(["the", "of", "word", "é", "a#b", "x<y>", "more"]) + r.choice(["", "", "\n", "\n\n"]) for _ in range(r.randint(1, 150))]
        pairs.append((100 + k, " ".join(words + words[:12] * r.randint(0, 3))))
    pairs.append((900, " ".join("".join(chr(r.randint(0x100, 0x17F)) for _ in range(8)) for _ in range(60))))  # nothing to predict
    docs = make_docs(pairs)
    sent = quality_rules(docs).collect()
    joined = quality_rules(docs, broadcast_bytes=0).collect()
    assert sorted(map(repr, sent)) == sorted(map(repr, joined))
    got = sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in sent), key=repr)
    assert got == sorted(((i, *brute_measures(t)) for i, t in pairs), key=repr)
    verdict = {x.doc_id: x for x in sent}
    assert not verdict[900].base_failed and not verdict[900].kept
    assert all(not (x.base_failed and x.kept) for x in sent) and sum(x.kept for x in sent) > 20
    assert quality_rules(make_docs([])).count() == 0


def test_perplexity_of_a_document(make_docs):
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(30)) for _ in range(12)]
    p = brute_log_probabilities(texts)
    for row in quality_rules(make_docs(list(enumerate(texts)))).collect():
        total, made = 0.0, 0
        padded = padded_text(texts[row.doc_id])
        for i in range(len(padded) - ORDER + 1):
            total += math.log(p[padded[i : i + ORDER]])
            made += 1
        assert abs(row.perplexity - math.exp(-total / made)) < 0.01


def test_kept_equals_the_bands(make_docs):
    """The verdict from plain perplexities and plain quartiles."""
    r = random.Random(11)
    texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(10, 60))) for _ in range(60)]
    texts += [" ".join("".join(r.choice("xyzq#") for _ in range(12)) for _ in range(40)), "a " * 60, " ".join(f"{k}!{k * k}?" for k in range(40))]
    p = brute_log_probabilities(texts)
    milli, fails = {}, {}
    for i, text in enumerate(texts):
        padded = padded_text(text)
        grams = [padded[k : k + ORDER] for k in range(len(padded) - ORDER + 1)]
        milli[i] = round(-sum(math.log(p[g]) for g in grams) / len(grams) * 1000)
        fails[i] = brute_measures(text)[-1]
    passing = sorted(m for i, m in milli.items() if not fails[i])
    q1, q3 = (passing[-(-len(passing) * k // 4) - 1] for k in (1, 3))
    reach = max(q3 - q1, LEAST_RANGE) * REACH
    want = {i: not fails[i] and q1 - reach <= m <= q3 + reach for i, m in milli.items()}
    assert {x.doc_id: x.kept for x in quality_rules(make_docs(list(enumerate(texts)))).collect()} == want
    assert {False, True} == {want[i] for i in want if not fails[i]}


def test_shuffled_words_have_a_higher_perplexity(make_docs):
    r = random.Random(5)
    verses = ["the old man walked to the far end of the town", "a small dog ran after the red ball in the park", "she said that it was not the right time for it"]
    texts = [" ".join(r.choice(verses) for _ in range(8)) for _ in range(60)]
    words = texts[0].split()
    r.shuffle(words)
    got = {x.doc_id: x.perplexity for x in quality_rules(make_docs([*enumerate(texts), (99, " ".join(words))])).collect()}
    assert got[99] > 1.2 * max(got[k] for k in range(60))


def test_long_texts_are_scored_in_slices(make_docs, monkeypatch):
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(r.randint(0, 200))) for _ in range(30)]
    docs = make_docs(list(enumerate(texts)))
    whole = sorted(map(repr, quality_rules(docs).collect()))
    words = perplexity.Words(perplexity.pa.array(texts))
    one = [x.tolist() for x in next(perplexity._grams(words, np.arange(len(words.start)), words.per_row))]
    monkeypatch.setattr(perplexity, "_SLICE", 37)
    parts = list(perplexity._grams(words, np.arange(len(words.start)), words.per_row))
    assert [sum((p[k].tolist() for p in parts), []) for k in (0, 1)] == one and len(parts) > 10
    assert whole == sorted(map(repr, quality_rules(docs).collect()))
