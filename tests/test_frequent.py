"""Heavy hitters, language posteriors and page archives."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import JD_REVIEWS, TMALL_REVIEWS, jd_body, jd_name, rows, tmall_body, tmall_name
from revlake.operators import heavy_hitters, language_posterior
from revlake.operators.keywords import tfidf_keywords
from revlake.plans.reviews import TextOptions, process_reviews, run_reviews
from revlake.schemas import RAW
from revlake.sources.landing import read_page_archive, write_page_archive
from revlake.sources.tables import ReviewTables
from revlake.streaming.ingest import ingest_stream


def exact(lists, n):
    counts = Counter(t for tokens in lists for t in tokens or () if t is not None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


def found(df, n):
    return [tuple(r) for r in heavy_hitters.frequent_terms(df, n).orderBy(F.desc("n"), "term").collect()]


@pytest.mark.parametrize("shape", ["skewed", "flat", "few", "long", "empty"])
def test_frequent_terms_equal_the_full_count(spark, shape, monkeypatch):
    monkeypatch.setattr(heavy_hitters, "TRACKED", 64)
    monkeypatch.setattr(heavy_hitters, "MAX_TRACKED", 1024)
    rng = random.Random(3)
    lists = {
        "skewed": [[f"w{int(rng.paretovariate(0.6))}" for _ in range(200)] for _ in range(60)] + [None, [], [None, "w1"]],
        "flat": [[f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(80)],
        "few": [["a", "b", "a"], ["b", None], ["c"]],
        "long": [["x" * 50_000, "x" * 50_001, "y"]] * 3,
        "empty": [],
    }[shape]
    df = spark.createDataFrame([(x,) for x in lists], "tokens array<string>").repartition(6)
    assert found(df, 10) == exact(lists, 10)


def test_frequent_terms_shuffle_no_vocabulary(spark):
    """100,000 different terms beside 20 frequent ones: candidates alone are grouped."""
    df = spark.range(100_000, numPartitions=4).select(
        F.array(F.concat(F.lit("rare"), "id"), F.concat(F.lit("hot"), F.col("id") % 20)).alias("tokens")
    )
    counted = []
    once = heavy_hitters._candidates_counted

    def seen(rows_, n, tracked):
        counted.append(tracked)
        return once(rows_, n, tracked)

    heavy_hitters._candidates_counted = seen
    try:
        assert found(df, 20) == sorted((f"hot{i}", 5000) for i in range(20))
    finally:
        heavy_hitters._candidates_counted = once
    assert counted == [heavy_hitters.TRACKED]  # proven at once, never the full count


def test_frequent_terms_need_a_positive_number(spark):
    with pytest.raises(ValueError):
        heavy_hitters.frequent_terms(spark.createDataFrame([], "tokens array<string>"), 0)


def test_posterior_on_held_out_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(8)
    held_out = F.xxhash64("doc_id") % 5 == 0
    counts = language_posterior.count_trigrams(docs.filter(~held_out))
    path = str(tmp_path / "model")
    counts.write.parquet(path)
    model = language_posterior.load_language_posterior(spark, path)
    tagged = docs.filter(held_out).select("lang", model.tag(F.col("text")).alias("t")).select("lang", "t.*")
    assert "Join" not in tagged._jdf.queryExecution().toString()
    got = tagged.collect()
    known = [r for r in got if r.language != "unknown"]
    assert len(got) > 20 and sum(r.language == r.lang for r in known) / len(known) > 0.97
    assert len(known) / len(got) > 0.9


def test_posterior_is_unknown_where_languages_are_alike(spark):
    labelled = spark.createDataFrame(
        [("aa", "kalo mire"), ("bb", "kalo mire"), ("bb", "zuzu wewe zuzu wewe"), (None, "xyz xyz"), ("aa", None), ("aa", "")],
        "lang string, text string",
    )
    model = language_posterior.train_language_posterior(labelled)
    assert model.languages == ("aa", "bb")
    long = "zuzu wewe " * 50_000
    cases = ["kalo", "zuzu zuzu zuzu zuzu", long, "", None, "12 !", "中文", "한국어", "a"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, text string")
    got = {r.i: r.t for r in df.select("i", model.tag(F.col("text")).alias("t")).collect()}
    assert [got[i].language for i in range(9)] == [
        "unknown", "bb", "bb", "unknown", "unknown", "unknown", "zh-cn", "ko", "unknown",
    ]
    assert 0.5 <= got[0].posterior < 0.9 and got[1].posterior > 0.9 and got[3].posterior is None and got[6].posterior == 1.0
    with pytest.raises(ValueError):
        language_posterior.train_language_posterior(labelled.filter("lang = 'none'"))


def test_posterior_in_the_processed_layer(spark):
    labelled = spark.createDataFrame([("aa", "kalo mire tona"), ("bb", "zuzu wewe")], "lang string, text string")
    model = language_posterior.train_language_posterior(labelled)
    raw = spark.createDataFrame([], RAW).unionByName(
        spark.createDataFrame([("jd", "1", "zuzu wewe zuzu wewe"), ("jd", "2", "")], "platform string, review_id string, text string"),
        allowMissingColumns=True,
    )
    out = process_reviews(raw, TextOptions(language_model=model, segmenter=lambda t: F.split(t, " ")))
    assert rows(out, "review_id", "language") == [("1", "bb"), ("2", "unknown")]


@pytest.fixture
def archive(spark, tmp_path):
    """All pages of the landing in one file, with a broken line."""
    pages = [
        (jd_name(0), jd_body(JD_REVIEWS[:2])), (jd_name(1), jd_body(JD_REVIEWS[2:])), (jd_name(2), jd_body([])),
        (jd_name(3), jd_body([{"id": 99, "content": "late"}])),
        (tmall_name(1), tmall_body(TMALL_REVIEWS)), (tmall_name(2), tmall_body(None)),
    ]
    folder = tmp_path / "archive"
    frame = spark.createDataFrame(pages, "location string, body string")
    write_page_archive(frame.withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp_ntz")), str(folder), 1)
    (folder / "broken.json").write_text('{"location": "club.jd', encoding="utf-8")
    return str(folder)


def stored(tables):
    return rows(tables.read("raw_reviews"), "platform", "product_id", "review_id", "rating", "text")


def test_archive_gives_what_single_files_give(spark, archive, landing, tmp_path):
    one, many, stream = (ReviewTables(spark, str(tmp_path / name)) for name in ("one", "many", "stream"))
    run_reviews(spark, str(landing), many)
    run_reviews(spark, archive, one, archive=True)
    ingest_stream(spark, archive, stream, str(tmp_path / "at"), archive=True).awaitTermination()
    assert stored(one) == stored(many) == stored(stream) and stored(one)
    assert one.read("quarantined_pages").count() == many.read("quarantined_pages").count() + 1


def test_one_archive_file_is_split_over_tasks(spark, tmp_path):
    pages = spark.range(3000, numPartitions=1).select(
        F.concat(F.lit("club.jd.com/c?productId=5&page="), "id").alias("location"), F.repeat(F.lit("x"), 500).alias("body")
    )
    path = str(tmp_path / "large")
    write_page_archive(pages, path, 1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        read = read_page_archive(spark, path)
        assert read.rdd.getNumPartitions() >= 4
        assert read.select("page").distinct().count() == read.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_texts_are_cut_once_for_counts_and_weights(spark):
    cut = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        cut.add(1)
        return text.split()

    texts = ["a b a", "b c", "c d d", ""]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "review_id string, text string").withColumn("tokens", words("text"))
    best = tfidf_keywords(docs.drop("text"), ["review_id"], top_n=2)
    assert [r.rank for r in best.orderBy("rank").collect()] == [1, 2]
    assert cut.value == len(texts)
