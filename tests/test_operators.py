import hashlib
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Observation, functions as F

from conftest import rows
from revlake.config import Settings
from revlake.functions.tokens import term_counts, tokenize
from revlake.operators import (
    dictionary, insights, joins, keywords, language, marts, ranking, rolling, segmentation, sentiment_model, topics,
)
from revlake.operators.frequencies import DocumentFrequencies
from revlake.schemas import KEY


def plain_textrank(words, stop=(), top_n=10):
    """Synchronous TextRank with a window of five tokens."""
    ok = [len(w) >= 2 and w not in stop for w in words]
    weight = Counter()
    for i, a in enumerate(words):
        for j in range(i + 1, min(i + 5, len(words))):
            if ok[i] and ok[j]:
                weight[a, words[j]] += 1
                weight[words[j], a] += 1
    total = Counter()
    for (a, _), w in weight.items():
        total[a] += w
    rank = {a: 1 / len(total) for a in total}
    for _ in range(10):
        rank = {
            a: 0.15 + 0.85 * sum(w / total[y] * rank[y] for (x, y), w in weight.items() if x == a)
            for a in rank
        }
    return sorted(((round(s, 6), t) for t, s in rank.items()), key=lambda p: (-p[0], p[1]))[:top_n]


def test_textrank_equals_plain_python(spark):
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "gamma", "de", "the", "x", "!", "eta"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(60)]
    texts += ["", "alpha", "alpha alpha", "x ! x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, clean_text string")
    out = keywords.textrank_keywords(df, ["i"], stopwords=("the",))
    got = {}
    for r in out.orderBy("i", "rank").collect():
        got.setdefault(r.i, []).append((r.score, r.term))
    for i, text in enumerate(texts):
        want = plain_textrank(text.split(), ("the",))
        assert [t for _, t in got.get(i, [])] == [t for _, t in want]
        assert [s for s, _ in got.get(i, [])] == pytest.approx([s for s, _ in want], abs=2e-6)


DOCS = ["a b b c", "a c c d", "a b e", "a f f f f", "", "g h a"]


def tokens_frame(spark, texts, by=None):
    data = [(i, by[i] if by else "p", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "i int, g string, t string")
    return df.withColumn("tokens", tokenize(F.col("t")))


def plain_tfidf(texts):
    docs = [Counter(t.split()) for t in texts]
    df = Counter(t for d in docs for t in d)
    n = len(docs)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items() if c <= 0.95 * n}
    scores = Counter()
    for d in docs:
        w = {t: c * idf[t] for t, c in d.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            scores[t] += x / norm
    return scores


@pytest.mark.parametrize("limit", [joins.BROADCAST_ROWS, 0])
def test_tfidf(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)  # 0 takes the path for large vocabularies
    monkeypatch.setattr(joins, "HEAVY_KEYS", 4)
    out = keywords.tfidf_keywords(tokens_frame(spark, DOCS), ["i"], top_n=50)
    want = plain_tfidf(DOCS)
    got = {r.term: r.score for r in out.collect()}
    assert got == pytest.approx(dict(want), abs=1e-6)
    order = [r.term for r in out.orderBy("rank").collect()]
    assert order == sorted(got, key=lambda t: (-got[t], t))
    by = ["p", "q", "p", "q", "q", "p"]
    grouped = keywords.tfidf_keywords(tokens_frame(spark, DOCS, by), ["i"], ["g"], top_n=50)
    for g in "pq":
        part = {r.term: r.score for r in grouped.filter(F.col("g") == g).collect()}
        assert part == pytest.approx(
            dict(plain_tfidf([t for t, k in zip(DOCS, by) if k == g])), abs=1e-6
        )


def words_at(vocabulary, *columns):
    return sorted(map(tuple, vocabulary.select(*columns, "term", "df", "n_docs").collect()))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_frequencies_of_three_batches_equal_one_over_all(spark, tmp_path, by):
    docs = tokens_frame(spark, [*DOCS, None, "", "late word word"], "pqpqqpppq")
    kept = DocumentFrequencies(spark, str(tmp_path / "df"), by)
    with pytest.raises(ValueError):
        kept.vocabulary()
    for batch in (0, 1, 1, 2, 0):  # a batch given again changes nothing
        kept.add(batch, docs.filter(F.col("i") % 3 == batch))
    kept.add(7, docs.limit(0))
    want = keywords.doc_frequency(docs, ["i"], by)
    assert words_at(kept.vocabulary(), *by) == words_at(want, *by) != []
    got = keywords.tfidf_keywords(docs, ["i"], by, frequencies=kept.vocabulary()).collect()
    assert sorted(got) == sorted(keywords.tfidf_keywords(docs, ["i"], by).collect())


def test_replaced_documents_leave_the_frequencies(spark, tmp_path):
    old, new = tokens_frame(spark, ["a b", "b c", "c d", "x y"]), tokens_frame(spark, ["a b", "b c", "c d", "y z"])
    kept = DocumentFrequencies(spark, str(tmp_path / "df"))
    kept.add(0, old)
    kept.add(1, new.filter("i = 3"), old.filter("i = 3"))
    assert words_at(kept.vocabulary(min_df=1)) == words_at(keywords.doc_frequency(new, ["i"], min_df=1))
    kept.add(1, new.limit(0))  # taken back
    assert words_at(kept.vocabulary(min_df=1)) == words_at(keywords.doc_frequency(old, ["i"], min_df=1))


def test_frequencies_follow_a_stream(spark, tmp_path):
    docs = tokens_frame(spark, DOCS)
    kept = DocumentFrequencies(spark, str(tmp_path / "df"))
    landing = str(tmp_path / "docs")
    for part in range(3):
        docs.filter(F.col("i") % 3 == part).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        assert kept.follow(stream, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert words_at(kept.vocabulary()) == words_at(keywords.doc_frequency(docs, ["i"]))


def test_tfidf_of_nothing_and_of_one_document(spark):
    assert keywords.tfidf_keywords(tokens_frame(spark, ["a b"]).limit(0), ["i"]).count() == 0
    assert keywords.tfidf_keywords(tokens_frame(spark, ["a b"]), ["i"]).count() == 0


def test_lda_shape(spark):
    docs = tokens_frame(spark, ["手 机 好", "电 池 差", "包 装 精 致"]).withColumn("k", F.monotonically_increasing_id())
    found = topics.lda_topics(docs, ["k"], n_topics=2, top_n=3).collect()
    assert {t.topic for t in found} == {0, 1}
    assert all(t.rank <= 3 and t.term in "手机好电池差包装精致" for t in found)
    assert found == topics.lda_topics(docs, ["k"], n_topics=2, top_n=3).collect()
    single = topics.lda_topics(docs, ["k"], n_topics=1, top_n=3)
    assert [r.term for r in single.orderBy("rank").collect()] == sorted("手机好电池差包装精致")[:3]
    assert topics.lda_topics(docs.limit(0), ["k"]).count() == 0


def test_lda_finds_two_themes(spark):
    rng = random.Random(2)
    themes = [[f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]]
    texts = [" ".join(rng.choices(themes[k % 2], k=20)) for k in range(60)]
    docs = tokens_frame(spark, texts).withColumn("k", F.monotonically_increasing_id())
    found = topics.lda_topics(docs, ["k"], n_topics=2, top_n=8, max_iter=20).collect()
    sides = [{t.term[0] for t in found if t.topic == k} for k in (0, 1)]
    assert sorted(map(sorted, sides)) == [["a"], ["b"]]


def test_lda_rounds_equal_plain_python(spark):
    texts = ["x x y", "y z", "z z x w", "w"]
    docs = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "k int, tokens array<string>")
    k, prior = 2, 0.5
    tf = {(str(i), w): float(n) for i, t in enumerate(texts) for w, n in Counter(t.split()).items()}
    p = {}
    for d, w in tf:
        own = int(hashlib.md5(f"{d}|{w}".encode()).hexdigest()[:8], 16) % k
        p[d, w] = [0.95 if j == own else 0.05 for j in range(k)]
    size = len({w for _, w in tf})

    def total(j, of=lambda d, w: True):
        return sum(n * p[d, w][j] for (d, w), n in tf.items() if of(d, w))

    for _ in range(3):
        new = {}
        for d, w in tf:
            u = []
            for j in range(k):
                own = p[d, w][j]
                by_doc, by_term = total(j, lambda x, _: x == d), total(j, lambda _, y: y == w)
                u.append((by_doc - own + prior) * (by_term - own + prior) / (total(j) - own + size * prior))
            new[d, w] = [x / sum(u) for x in u]
        p = new
    want = {(j, w): round((total(j, lambda _, y: y == w) + prior) / (total(j) + size * prior), 6) for j in range(k) for w in "xyzw"}
    got = {(r.topic, r.term): r.weight for r in topics.lda_topics(docs, ["k"], n_topics=2, top_n=9, max_iter=3).collect()}
    assert got == pytest.approx(want)


# -- marts --------------------------------------------------------------------


def analyzed(spark, data):
    return spark.createDataFrame(
        data,
        "platform string, product_id string, review_id string, rating int, clean_text string, "
        "created_at timestamp_ntz, sentiment_label string, sentiment_score double, keywords array<string>",
    )


@pytest.fixture(scope="module")
def sample(spark):
    day = datetime(2024, 1, 1)
    return analyzed(spark, [
        ("jd", "p", "1", 5, "x" * 90, day, "positive", 0.8, ["屏幕", "续航"]),
        ("jd", "p", "2", 1, "bad", None, "negative", -0.7, ["色差", "屏幕"]),
        ("jd", "q", "3", None, "", day, "neutral", 0.0, ["屏幕"]),
        ("tmall", "p", "4", None, "ok", day, "positive", 0.3, ["a", "a", "b"]),
    ])


def test_complaints_and_strengths(sample):
    out = insights.product_insights(sample, "jd", "p")
    assert rows(out, "list", "rank", "term", "signal") == sorted([
        ("strengths", 1, "续航", 1), ("complaints", 1, "色差", 1),
        ("top_positive_terms", 1, "屏幕", 1), ("top_positive_terms", 2, "续航", 1),
        ("top_negative_terms", 1, "屏幕", 1), ("top_negative_terms", 2, "色差", 1),
    ], key=repr)
    assert insights.product_insights(sample, "jd", "none").count() == 0
    lists = {n: {r.term for r in insights.complaints_and_strengths(sample).filter(F.col("list") == n).collect()}
             for n in insights.LISTS}
    assert not lists["strengths"] & lists["complaints"]
    assert rows(insights.top_terms(sample, "positive").filter("platform = 'tmall'"), "rank", "term", "n") == [
        (1, "a", 2), (2, "b", 1),
    ]


def test_read_side(sample):
    assert rows(marts.sentiment_distribution(sample)) == [("negative", 1), ("neutral", 1), ("positive", 2)]
    assert rows(marts.headline_metrics(sample)) == [(4, 2, 1)]
    assert marts.rating_vs_sentiment(sample).count() == 2
    assert marts.rating_correlation(sample).first().correlation == pytest.approx(1.0)
    assert [r.review_id for r in marts.list_reviews(sample, "jd", limit=2).collect()] == ["1", "2"]
    assert marts.list_reviews(sample, "", None).count() == 4
    for limit in (0, 501):
        with pytest.raises(ValueError):
            marts.list_reviews(sample, limit=limit)
    lines = [r.line for r in marts.review_lines(sample, "jd", "p").collect()]
    assert lines == ["[jd/p/1] positive +0.80 | " + "x" * 80, "[jd/p/2] negative -0.70 | bad"]
    assert rows(marts.token_frequencies(sample, 2, "keywords")) == [("a", 2), ("屏幕", 3)]


def test_ranking(spark):
    df = spark.createDataFrame([("a", i % 7, i) for i in range(50)], "k string, v int, i int")
    best = ranking.top_n_per_group(df, ["k"], [F.desc("v"), F.asc("i")], 3)
    assert rows(best, "rank", "i") == [(1, 6), (2, 13), (3, 20)]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert rows(ranking.latest_by_key(df, ["k"], [F.desc("i")]), "i") == [(49,)]


def test_fresh_reviews(spark):
    def frame(keys):
        return spark.createDataFrame(keys, "platform string, product_id string, review_id string")

    fetched = frame([("jd", "a", "1"), ("jd", "a", "2"), ("jd", "a", "2"), ("jd", "b", "1")])
    stored = frame([("jd", "a", "1"), ("tmall", "a", "2")])
    assert rows(joins.fresh_reviews(fetched, stored)) == [("jd", "a", "2"), ("jd", "a", "2"), ("jd", "b", "1")]
    assert joins.fresh_reviews(fetched, stored, incremental=False).count() == 4


@pytest.mark.parametrize("by", [["platform", "product_id"], []])
def test_rolling_mean_equals_pandas(spark, by):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    data = [
        ("jd", "hot" if rng.random() < 0.6 else f"p{i % 9}", str(i),
         None if i % 37 == 0 else start + timedelta(minutes=rng.randint(0, 900)), rng.uniform(-1, 1))
        for i in range(1500)
    ]
    names = ["platform", "product_id", "review_id", "created_at", "sentiment_score"]
    df = spark.createDataFrame(
        data, "platform string, product_id string, review_id string, created_at timestamp_ntz, sentiment_score double"
    )
    got = rolling.rolling_sentiment(df.repartition(8), by).toPandas().set_index("review_id")["rolling_sentiment"]
    frame = pd.DataFrame(data, columns=names).dropna(subset=["created_at"])
    frame = frame.sort_values(["created_at", "review_id"])
    for _, part in frame.groupby(by) if by else [((), frame)]:
        want = part.set_index("review_id")["sentiment_score"].rolling(
            max(5, len(part) // 20), min_periods=1
        ).mean()
        pd.testing.assert_series_equal(got[want.index], want, check_names=False, atol=1e-9)
    assert len(got) == len(frame)


# -- language, dictionary, models ---------------------------------------------


def test_script_language(spark):
    cases = {"这是一个中文句子": "zh-cn", "これはペンです": "ja", "한국어": "ko", "": "unknown", "123 !": "unknown", "hello": None,
             "An English sentence with one 字 sign": None, "Good phone の": None, "iPhone 手机很好": "zh-cn", "这个の手机非常好用": "zh-cn"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.tag for r in df.select("t", language.script_language(F.col("t")).alias("tag")).collect()}
    assert got == cases


def test_language_model_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(8)
    held_out = F.xxhash64("doc_id") % 5 == 0
    model = language.train_language_model(docs.filter(~held_out))
    out = language.detect_language(docs.filter(held_out), ["doc_id"], model, text="text")
    both = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    hits = sum(r.language == r.lang for r in both)
    assert len(both) > 20 and hits / len(both) > 0.95
    blank = spark.createDataFrame([(1, ""), (2, "12"), (3, "中文"), (4, None)], "doc_id int, text string")
    tags = language.detect_language(blank, ["doc_id"], model, text="text")
    assert rows(tags, "doc_id", "language") == [(1, "unknown"), (2, "unknown"), (3, "zh-cn"), (4, "unknown")]


def test_learned_dictionary(spark):
    rng = random.Random(1)
    filler = "天地人口日月山水火木"
    texts = ["".join(rng.choices(filler, k=4)) + "键盘" + "".join(rng.choices(filler, k=4)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "clean_text string")
    out = {r.term: r for r in dictionary.learn_dictionary(df, min_pmi=2.0, min_entropy=1.0).collect()}
    assert "键盘" in out and out["键盘"].n == 200
    assert out["键盘"].pmi == pytest.approx(math.log(200 * 2000 / (200 * 200)))
    left = Counter(t[3] for t in texts)
    want = -sum(c / 200 * math.log(c / 200) for c in left.values())
    assert out["键盘"].left_entropy == pytest.approx(want)


def test_dictionary_table_equals_inline_form(spark):
    texts = ["这个手机屏幕非常好用", "屏幕好,手机壳+手机", "abc手机abcd", "", None, "a.b(手)"]
    words = ["手机", "手机壳", "屏幕", "非常", "非常好", "abc", "b(", "用", "缺席"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, clean_text string")
    table = spark.createDataFrame([(w,) for w in words], "term string")
    got = segmentation.tokenize_longest(df, ["i"], table, stopwords=["用"])
    want = df.withColumn("tokens", tokenize(F.col("clean_text"), terms=words, stopwords=["用"]))
    assert rows(got, "i", "tokens") == rows(want, "i", "tokens")
    none = segmentation.tokenize_longest(df, ["i"], table.limit(0))
    assert rows(none, "i", "tokens") == rows(df.withColumn("tokens", tokenize(F.col("clean_text"))), "i", "tokens")


def test_sentiment_model_and_fallback(spark):
    good, bad = "很好 推荐 满意", "垃圾 失望 退货"
    df = spark.createDataFrame(
        [(i, good if i % 2 else bad, float(i % 2), 3) for i in range(40)] + [(99, " ", 1.0, 5)],
        "i int, clean_text string, label double, rating int",
    )
    model = sentiment_model.train_sentiment_model(df, features=1 << 10)
    out = {r.i: r.sentiment for r in sentiment_model.model_scorer(model)(df).collect()}
    assert out[1].label == "positive" and out[1].score > 0.5
    assert out[2].label == "negative" and out[2].score < -0.5
    assert (out[99].label, out[99].score) == ("neutral", 0.0)

    def broken():
        raise OSError("no model")

    rules = sentiment_model.rule_scorer()(df)
    assert rows(sentiment_model.select_scorer("model", broken)(df)) == rows(rules)
    assert rows(sentiment_model.select_scorer()(df)) == rows(rules)
    with pytest.raises(ValueError):
        sentiment_model.select_scorer("other")


def test_batch_backend(spark):
    def make():
        import numpy as np

        def predict(texts):
            return {"label": np.array(["POS" if "好" in t else "LABEL_0" for t in texts]), "score": np.full(len(texts), 0.75)}

        return predict

    df = spark.createDataFrame([("好",), ("x",), ("",)], "clean_text string").withColumn("rating", F.lit(None).cast("int"))
    scored = sentiment_model.column_scorer(sentiment_model.batch_backend(make))(df)
    assert rows(scored, "clean_text", "sentiment.label", "sentiment.score") == [
        ("", "neutral", 0.0), ("x", "neutral", 0.0), ("好", "positive", 0.75),
    ]


def test_settings_from_session(spark):
    spark.conf.set("revlake.max_pages", "7")
    try:
        assert Settings.from_session(spark).max_pages == 7
        assert Settings.from_session(spark).sentiment_backend == "baseline"
    finally:
        spark.conf.unset("revlake.max_pages")
    assert KEY == ["platform", "review_id"]
    assert spark.createDataFrame([(["b", "a", "b"],)], "t array<string>").select(term_counts(F.col("t"))).count() == 1


def test_model_scores_after_an_observation(spark):
    """The summary of a training holds the session, and that what observes frames, which no task can be sent."""
    df = spark.createDataFrame([(i, "x y" if i % 2 else "u v", float(i % 2), 3) for i in range(20)], "i int, clean_text string, label double, rating int")
    seen = Observation()
    assert df.observe(seen, F.count(F.lit(1)).alias("n")).count() == 20 and seen.get == {"n": 20}
    model = sentiment_model.train_sentiment_model(df, features=1 << 8)
    assert not model.stages[-1].hasSummary
    assert sentiment_model.model_scorer(model)(df).filter("sentiment.label = 'positive'").count() == 10


def test_lda_keeps_no_earlier_round(spark, monkeypatch):
    from pathlib import Path

    from revlake.session import shared_dir

    held = []

    def counted(df, name="stage", path=None):
        out = materialize(df, name, path)
        held.append(len(list(Path(shared_dir(spark)).glob("revlake-*/pairs-*"))))
        return out

    materialize = topics.materialize
    monkeypatch.setattr(topics, "materialize", counted)
    docs = spark.createDataFrame([(i, ["a", "b", f"t{i % 3}"]) for i in range(8)], "k int, tokens array<string>")
    before = len(list(Path(shared_dir(spark)).glob("revlake-*/pairs-*")))
    assert topics.lda_topics(docs, ["k"], n_topics=2, top_n=3, max_iter=4).count() == 6
    assert max(held) - before <= 2


def test_lda_passes_equal_joins(spark, monkeypatch):
    """Repeated and null keys, null and empty lists, terms of one and of several documents, documents that go on in the next batch."""
    rng = random.Random(5)
    lists = [[f"w{int(40 * rng.random() ** 2)}" for _ in range(rng.randrange(1, 25))] + [f"only{i}"] * (i % 3) for i in range(40)]
    data = [(f"k{i % 31}" if i % 13 else None, i % 2 if i % 7 else None, t) for i, t in enumerate(lists)]
    docs = spark.createDataFrame([*data, ("none", 1, None), ("empty", 1, [])], "a string, b int, tokens array<string>").coalesce(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for rounds, frequent in ((0, 5), (1, 5), (4, 5), (4, 0), (4, 1 << 17)):
            monkeypatch.setattr(topics, "FREQUENT", frequent)
            found = []
            for sent in (topics.SENT, 0):
                with monkeypatch.context() as own:
                    own.setattr(topics, "SENT", sent)
                    if sent:  # no round joins pairs
                        own.setattr(topics, "split_heavy_join", None)
                    got = topics.lda_topics(docs, ["a", "b"], n_topics=3, top_n=200, max_iter=rounds).collect()
                    found.append({(r.topic, r.term): r.weight for r in got})
            assert len(found[0]) > 150 and found[0] == pytest.approx(found[1], abs=2e-6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_textrank_of_nothing_and_of_many_texts(spark, monkeypatch):
    """Texts ranked together keep to themselves, wherever a group of them ends."""
    monkeypatch.setattr(keywords, "RANKED_TOKENS", 20)
    texts = [" ".join(f"w{(i * k) % 7}x" for k in range(i)) for i in range(25)]
    lists = pa.array([t.split() for t in texts] + [None])
    parts = list(keywords._slices(lists))
    assert len(parts) > 5 and sum(map(len, parts)) == len(lists)
    got = [r for part in parts for r in keywords._rank(part, pa.array(["w0x"]), 2, 4).to_pylist()]
    assert got[-1] is None and got[0] == [] and got[1] == []
    for text, ranked in zip(texts, got):
        want = plain_textrank(text.split(), ("w0x",), 4)
        assert [r["term"] for r in ranked] == [t for _, t in want]
        assert [r["score"] for r in ranked] == pytest.approx([s for s, _ in want], abs=2e-6)
