import os
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import JD_PRODUCT, JD_REVIEWS, jd_body, jd_name, rows
from revlake.plans.reviews import (
    TextOptions, ingest, landing_report, load_landing, missing_pages, pending_raw, refine, run_reviews,
)
from revlake.schemas import ANALYZED, PROCESSED, RAW
from revlake.session import materialize, scratch_scope, shared_dir
from revlake.sources.tables import ReviewTables
from revlake.streaming import ingest as streaming
from revlake.streaming.ingest import ingest_stream


def names_and_types(schema):
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


@pytest.fixture
def tables(spark, tmp_path):
    return ReviewTables(spark, str(tmp_path / "store"))


def test_schemas(tables):
    tables.init_tables()
    tables.init_tables()
    for table, schema in (
        ("raw_reviews", RAW), ("processed_reviews", PROCESSED), ("analyzed_reviews", ANALYZED),
    ):
        assert names_and_types(tables.read(table).schema) == names_and_types(schema)
        assert tables.read(table).count() == 0


def test_end_to_end_and_rerun(spark, tables, landing):
    analyzed, summary = run_reviews(spark, str(landing), tables)
    got = {r.review_id: r for r in analyzed.collect()}
    assert set(got) == {"41", "g-42", "43", "t1", "r2"}
    assert names_and_types(analyzed.schema) == names_and_types(ANALYZED)
    assert got["41"].sentiment_label == "positive" and got["g-42"].sentiment_label == "negative"
    assert got["43"].keywords == [] and got["43"].language == "unknown"
    assert got["41"].language == "zh-cn" and "，" not in got["41"].clean_text
    assert rows(summary) == [("jd", JD_PRODUCT, 3, 3, 3), ("tmall", "888002", 2, 2, 2)]

    again, summary = run_reviews(spark, str(landing), tables)
    assert again.count() == 0
    assert rows(summary, "fetched", "fresh", "analyzed") == [(2, 0, 0), (3, 0, 0)]
    assert tables.list_analyzed("jd", JD_PRODUCT).count() == 3
    assert tables.list_analyzed("", "").count() == 5
    assert rows(tables.existing_review_ids("jd", JD_PRODUCT)) == [("41",), ("43",), ("g-42",)]


def test_full_refetch_overwrites_and_reanalyzes(spark, tables, landing):
    run_reviews(spark, str(landing), tables)
    changed = [dict(JD_REVIEWS[0], content="太差，垃圾", score=None)]
    (landing / jd_name(0)).write_text(jd_body(changed), encoding="utf-8")
    skipped, _ = run_reviews(spark, str(landing), tables)
    assert skipped.count() == 0
    redone, _ = run_reviews(spark, str(landing), tables, incremental=False)
    row = tables.list_analyzed("jd").filter("review_id = '41'").first()
    assert row.sentiment_label == "negative" and row.rating is None
    assert "41" in {r.review_id for r in redone.collect()}
    assert tables.read("raw_reviews").count() == 5


def test_one_product_and_bad_platform(spark, tables, landing):
    _, fresh = ingest(spark, str(landing), tables, platform="tmall", product_id="888002")
    assert fresh.count() == 2
    with pytest.raises(ValueError):
        ingest(spark, str(landing), tables, platform="other")


def test_a_broken_off_run_is_completed(spark, tables, landing):
    ingest(spark, str(landing), tables)  # nothing analyzed yet
    assert pending_raw(tables).count() == 5
    assert refine(tables).count() == 5
    assert pending_raw(tables).count() == 0


def test_load_landing(spark, landing, tmp_path):
    assert load_landing(spark, str(landing), str(tmp_path / "demo"), [("jd", JD_PRODUCT)]).count() == 3


def test_stream_equals_batch_and_repeats_safely(spark, tmp_path, landing):
    batch = ReviewTables(spark, str(tmp_path / "batch"))
    run_reviews(spark, str(landing), batch)
    stream = ReviewTables(spark, str(tmp_path / "stream"))
    for checkpoint in ("a", "a", "b"):  # a second run, then a run that forgot its progress
        query = ingest_stream(
            spark, str(landing), stream, str(tmp_path / checkpoint), analyze=True
        )
        query.awaitTermination()
        assert query.exception() is None
        for table in ("raw_reviews", "analyzed_reviews"):
            assert rows(stream.read(table)) == rows(batch.read(table))


def test_stream_in_small_batches(spark, tmp_path, landing):
    stream = ReviewTables(spark, str(tmp_path / "s"))
    query = ingest_stream(
        spark, str(landing), stream, str(tmp_path / "c"), analyze=True, max_files=2, max_pages=2
    )
    query.awaitTermination()
    assert query.exception() is None
    assert stream.read("analyzed_reviews").count() == stream.read("raw_reviews").count() == 5
    assert stream.read("page_index").count() == 6


def test_stream_knows_empty_pages_of_earlier_batches(spark, tmp_path, landing):
    late = tmp_path / "late.txt"
    (landing / jd_name(3)).rename(late)
    stream = ReviewTables(spark, str(tmp_path / "s"))
    ingest_stream(spark, str(landing), stream, str(tmp_path / "c")).awaitTermination()
    (landing / jd_name(3)).write_text(late.read_text())
    ingest_stream(spark, str(landing), stream, str(tmp_path / "c")).awaitTermination()
    assert stream.read("raw_reviews").filter("review_id = '99'").count() == 0
    assert stream.read("page_index").count() == 6


@pytest.mark.parametrize("stream", [False, True])
def test_earlier_layers_go_before_later_ones_are_stored(spark, tmp_path, landing, monkeypatch, stream):
    shared, held, merge = Path(shared_dir(spark)), [], ReviewTables._merge
    there = lambda: {p for kind in ("parsed", "fresh", "processed", "analyzed_reviews") for p in shared.glob(f"revlake-*/{kind}-*")}
    before = there()

    def merged(self, table, batch):
        merge(self, table, batch)
        if table == "analyzed_reviews":
            held.extend(there() - before)

    monkeypatch.setattr(ReviewTables, "_merge", merged)
    root = str(tmp_path / "store")
    if stream:
        ingest_stream(spark, str(landing), ReviewTables(spark, root), str(tmp_path / "c"), analyze=True).awaitTermination()
    else:
        assert load_landing(spark, str(landing), root).count() == 5
    assert ReviewTables(spark, root).read("analyzed_reviews").count() == 5
    assert held == []


def test_many_pages_are_several_batches(spark, tmp_path, landing, monkeypatch):
    monkeypatch.setattr(streaming, "PAGE_FILES", 4)
    stream, listing = ReviewTables(spark, str(tmp_path / "s")), [spark.conf.get(k, None) for k in streaming.LISTING]
    ingest_stream(spark, str(landing), stream, str(tmp_path / "c"), max_pages=2).awaitTermination()
    assert len([p for p in (tmp_path / "c" / "commits").iterdir() if p.name.isdigit()]) == 2  # of six pages
    assert stream.read("raw_reviews").count() == 5 and stream.read("page_index").count() == 6
    assert [spark.conf.get(k, None) for k in streaming.LISTING] == listing


def test_options_segment_with_own_words(spark):
    options = TextOptions(terms=("手机", "屏幕"))
    df = spark.createDataFrame([("这个手机的屏幕非常好abc1",)], "t string")
    assert df.select(options.segment(F.col("t"))).first()[0] == [
        "这个", "手机", "的", "屏幕", "非常好", "abc1",
    ]


def landed(folder, products):
    """Files of pages with one review each: {product: [body or None for a broken page]}."""
    folder.mkdir()
    for product, pages in products.items():
        for page, items in enumerate(pages):
            body = "{broken" if items is None else jd_body(items)
            (folder / jd_name(page, product)).write_text(body, encoding="utf-8")
    return str(folder)


def test_nothing_that_landed_is_lost(spark, tmp_path):
    def item(i):
        return {"id": i, "content": f"review {i}", "score": 5}

    good = [[item(100 + 2 * k), item(101 + 2 * k)] for k in range(12)]
    pages = {"1": good, "2": [[item(7)], None, [item(8)]], "3": [[{"content": "no id"}, {"content": "none either"}]], "4": [[item(9)], [item(10)], [item(11)]]}
    path = landed(tmp_path / "land", pages)
    os.remove(f"{path}/{jd_name(1, '4')}")
    tables = ReviewTables(spark, str(tmp_path / "t"))
    run_reviews(spark, path, tables)
    counts = {r.product_id: r["count"] for r in tables.read("raw_reviews").groupBy("product_id").count().collect()}
    assert counts == {"1": 24, "2": 2, "3": 1, "4": 2}
    assert rows(tables.read("quarantined_pages"), "product_id", "page", "error") == [("2", 1, "invalid JSON")]
    assert rows(missing_pages(tables), "product_id", "page") == [("4", 1)]
    assert rows(tables.read("idless_reviews"), "product_id", "page", "seq") == [("3", 0, 0), ("3", 0, 1)]
    assert rows(landing_report(tables), "product_id", "quarantined", "missing", "idless") == [("2", 1, 0, 0), ("3", 0, 0, 2), ("4", 0, 1, 0)]


def test_a_page_number_that_is_no_page_is_reported_as_one_run(spark, tables, tmp_path):
    path = landed(tmp_path / "land", {"1": [[{"id": 1, "content": "a"}]]})
    (tmp_path / "land" / jd_name(1_500_000_000, "1")).write_text(jd_body([{"id": 2, "content": "b"}]), encoding="utf-8")
    ingest(spark, path, tables)
    assert rows(landing_report(tables), "product_id", "missing") == [("1", 1_499_999_999)]


def test_refine_takes_the_latest_of_given_rows_and_a_selection(spark, tables, landing):
    ingest(spark, str(landing), tables)
    raw = tables.read("raw_reviews")
    older = raw.withColumn("text", F.lit("older")).withColumn("fetched_at", F.expr("fetched_at - interval 1 day"))
    done = refine(tables, raw.unionByName(older), product_id=JD_PRODUCT)
    assert {r.product_id for r in done.collect()} == {JD_PRODUCT}
    assert done.filter("text = 'older'").count() == 0 and done.count() == raw.filter(F.col("product_id") == JD_PRODUCT).count()


def test_scopes_of_threads_are_apart(spark):
    inside, leave = threading.Event(), threading.Event()

    def other():
        with scratch_scope(spark):
            inside.set()
            leave.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    with scratch_scope(spark):
        mine = materialize(spark.range(3), "mine")
        leave.set()
        thread.join()
        assert mine.count() == 3
