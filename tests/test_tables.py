import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from conftest import rows
from revlake.schemas import KEY, RAW
from revlake.session import materialize
from revlake.sources.tables import ReviewTables

DAY = datetime(2024, 1, 1)


def raw(spark, data):
    """Rows from (platform, review_id, product_id, rating, fetched day)."""
    full = [
        (p, r, pid, rating, f"text {r}", None, None, None, None, "{}", DAY + timedelta(days=day))
        for p, r, pid, rating, day in data
    ]
    return spark.createDataFrame(full, RAW)


def store(spark, path):
    tables = ReviewTables(spark, str(path))
    tables.init_tables()
    return tables


def test_upsert_twice(spark, tmp_path):
    tables = store(spark, tmp_path)
    row = raw(spark, [("jd", "r1", "p1", 5, 0)])
    assert tables.upsert("raw_reviews", row.limit(0)) == 0
    assert tables.upsert("raw_reviews", row) == 1
    assert tables.upsert("raw_reviews", row) == 1
    assert tables.upsert("raw_reviews", row.limit(0)) == 0
    assert rows(tables.existing_review_ids("jd", "p1")) == [("r1",)]
    assert rows(tables.read("raw_reviews")) == rows(row)


def test_random_batches_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(11)
    tables, want = store(spark, tmp_path), {}
    for day in range(4):
        batch = [
            (rng.choice(["jd", "tmall"]), f"r{rng.randint(0, 25)}", f"p{rng.randint(0, 3)}",
             rng.choice([None, 1, 5]), day)
            for _ in range(15)
        ]
        newest = {(b[0], b[1]): b for b in batch}
        unique = list(newest.values())
        assert tables.upsert("raw_reviews", raw(spark, unique)) == len(unique)
        want |= newest
    got = tables.read("raw_reviews").select(*KEY, "product_id", "rating", F.col("fetched_at"))
    assert rows(got) == sorted(
        [(p, r, pid, rating, DAY + timedelta(days=d)) for p, r, pid, rating, d in want.values()], key=repr
    )


def test_last_fetch_wins_inside_a_batch_and_splits_commute(spark, tmp_path):
    data = [("jd", "a", "p", 1, 0), ("jd", "a", "p", 2, 2), ("jd", "a", "p", 3, 1), ("jd", "", "p", 4, 0), ("jd", "", "q", 5, 1)]
    one, two = store(spark, tmp_path / "one"), store(spark, tmp_path / "two")
    assert one.upsert("raw_reviews", raw(spark, data)) == 5
    for row in sorted(data, key=lambda d: d[4]):
        two.upsert("raw_reviews", raw(spark, [row]))
    assert rows(one.read("raw_reviews"), *KEY, "rating") == [("jd", "", 5), ("jd", "a", 2)]
    assert rows(one.read("raw_reviews")) == rows(two.read("raw_reviews"))


def dated(spark, data):
    """Rows from (review_id, created month or None, rating)."""
    full = [("jd", r, "p", rating, f"text {r}", m and datetime(2024, m, 3), None, None, None, "{}", DAY) for r, m, rating in data]
    return spark.createDataFrame(full, RAW)


def files(tables, part="data"):
    return {str(f): f.stat().st_mtime_ns for f in (Path(tables.root) / "raw_reviews" / part).rglob("*.parquet")}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    tables = store(spark, tmp_path)
    tables.upsert("raw_reviews", dated(spark, [("a", 1, 1), ("b", 1, 1), ("c", 2, 1), ("d", None, 1)]))
    before = files(tables)
    tables.upsert("raw_reviews", dated(spark, [("c", 2, 5), ("e", 2, 5), ("f", 3, 5)]))
    after = files(tables)
    assert {f for f in before if f in after and before[f] == after[f]} == {f for f in before if "month=2024-02" not in f}
    assert rows(tables.read("raw_reviews"), "review_id", "rating") == [("a", 1), ("b", 1), ("c", 5), ("d", 1), ("e", 5), ("f", 5)]
    before = after
    tables.upsert("raw_reviews", dated(spark, [("g", 1, 2)]))  # only new keys: nothing is rewritten
    assert before.items() <= files(tables).items()


def test_a_key_moves_with_its_month(spark, tmp_path):
    tables = store(spark, tmp_path)
    tables.upsert("raw_reviews", dated(spark, [("a", 1, 1), ("b", 2, 1), ("c", 2, 1)]))
    tables.upsert("raw_reviews", dated(spark, [("a", 2, 3), ("c", 4, 3)]))
    assert rows(tables.read("raw_reviews"), "review_id", "rating") == [("a", 3), ("b", 1), ("c", 3)]
    assert not any("month=2024-01" in f for f in files(tables))  # a partition that lost its only row is gone
    assert not any("month=2024-01" in f for f in files(tables, "seen"))


def test_only_partitions_that_may_hold_a_key_are_read(spark, tmp_path):
    tables = store(spark, tmp_path)
    for month in range(1, 7):  # filters of one partition add up over appends
        for part in range(2):
            tables.upsert("raw_reviews", dated(spark, [(f"{month}-{part}-{i}", month, 1) for i in range(40)]))
    asked = spark.createDataFrame([("jd", "3-0-7"), ("jd", "5-1-9"), ("jd", "none"), ("tmall", "1-0-1")], "platform string, review_id string")
    assert tables.may_hold("raw_reviews", asked) == ["jd/2024-03", "jd/2024-05"]
    read = tables.read_around("raw_reviews", asked)
    assert read.count() == 160
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [concat_ws(/, platform" in plan
    everything = tables.read("raw_reviews").select(*KEY)
    assert len(tables.may_hold("raw_reviews", everything)) == 6
    assert tables.may_hold("raw_reviews", asked.limit(0)) == [] and tables.read_around("raw_reviews", asked.limit(0)).count() == 0


def test_a_batch_given_again_changes_nothing(spark, tmp_path):
    tables = store(spark, tmp_path)
    first, second = dated(spark, [("a", 1, 1), ("b", 1, 1)]), dated(spark, [("a", 2, 2), ("c", 1, 2)])
    for batch in (first, second, second, second):
        tables.upsert("raw_reviews", batch)
    assert rows(tables.read("raw_reviews"), "review_id", "rating") == [("a", 2), ("b", 1), ("c", 2)]


def test_retention(spark, tmp_path):
    tables = store(spark, tmp_path)
    tables.upsert("raw_reviews", raw(spark, [("jd", f"r{i}", "p", 1, i % 2) for i in range(8)]))
    tables.upsert("raw_reviews", raw(spark, [("jd", f"s{i}", "p", 1, 5) for i in range(4)]))
    done = tables.read("raw_reviews").filter("review_id <> 'r0'").select(
        "platform", "review_id", "product_id", "rating", "text", F.col("text").alias("clean_text"),
        F.array().cast("array<string>").alias("tokens"), F.lit("x").alias("language"), "created_at", "fetched_at",
        F.lit("neutral").alias("sentiment_label"), F.lit(0.0).alias("sentiment_score"),
        F.array().cast("array<string>").alias("keywords"),
    )
    tables.upsert("analyzed_reviews", done)
    cut = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    assert tables.retain_raw(cut) == 3  # r2, r4, r6 are old and analyzed, r0 is not analyzed
    on_disk = spark.read.option("recursiveFileLookup", "true").parquet(str(tables.root) + "/raw_reviews")
    assert not {r.review_id for r in on_disk.collect()} & {"r2", "r4", "r6"}
    left = {r.review_id for r in tables.read("raw_reviews").collect()}
    assert left == {"r0", "r1", "r3", "r5", "r7", "s0", "s1", "s2", "s3"}
    assert tables.retain_raw(cut) == 0


def test_platform_filter_prunes_folders(spark, tmp_path):
    tables = store(spark, tmp_path)
    tables.upsert("raw_reviews", raw(spark, [("jd", "a", "p", 1, 0), ("tmall", "b", "p", None, 0)]))
    plan = tables.read("raw_reviews").filter("platform = 'jd' AND product_id = 'p'").select("review_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(platform" in text and "EqualTo(product_id,p)" in text
    assert "text" not in text.split("ReadSchema:")[1]


def test_tables_and_scratch_are_packed(spark, tmp_path):
    tables = store(spark, tmp_path)
    tables.upsert("raw_reviews", raw(spark, [("jd", f"r{i}", "p", i, 0) for i in range(50)]))
    path = str(tmp_path / "scratch")
    assert materialize(spark.range(9), path=path).count() == 9
    for folder in (tmp_path / "raw_reviews", Path(path)):
        files = list(folder.rglob("*.parquet"))
        assert files and all(f.name.endswith(".zstd.parquet") for f in files)
