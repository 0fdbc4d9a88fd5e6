"""Review-shaped views of the benchmark tables, shared by the registered queries.

The tables hold no reviews, so documents play that part: the source is the product, even
ids have a rating. Lexicon and stopwords are word parts of the same texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.sentiment import Lexicon, rule_sentiment
from ..functions.tokens import remove_stopwords, tokenize

LEXICON = Lexicon(positive=("tion", "and"), negative=("er", "ou"), negation=("ha",))
STOPWORDS = ("the", "of", "and", "to", "de", "la", "le", "que", "der", "und")
# Below this many bytes per core a scan is spread over the cores before costly work.
SMALL_SHARE = 64 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on a table too small to be split; a large scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if size < cores * SMALL_SHARE else df


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    docs = spread(load(spark, sf_dir, "documents"), "doc_id")
    return docs.select(
        F.when(even, "jd").otherwise("tmall").alias("platform"),
        F.col("source").alias("product_id"),
        F.col("doc_id").cast("string").alias("review_id"),
        F.when(even, (1 + F.col("doc_id") % 10 / 2).cast("int")).alias("rating"),
        "text", "lang", "doc_id", "n_chars",
    )


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).withColumn("tokens", tokenize(F.col("text"), stopwords=STOPWORDS))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with sentiment; the tokens serve as keywords."""
    result = rule_sentiment(F.col("text"), F.col("rating"), LEXICON)
    return (
        reviews(spark, sf_dir)
        .withColumn("clean_text", F.col("text"))
        .withColumn("_s", result)
        .withColumns(
            {"sentiment_label": F.col("_s.label"), "sentiment_score": F.col("_s.score")}
        )
        .drop("_s")
    )


def with_tokens(df: DataFrame) -> DataFrame:
    tokens = remove_stopwords(tokenize(F.col("clean_text")), STOPWORDS)
    return df.withColumn("tokens", tokens).withColumn("keywords", F.col("tokens"))


def raw_rows(df: DataFrame, *, fetched: Column, level: Column) -> DataFrame:
    """Reviews in the shape of the raw layer."""
    return df.select(
        "platform", "review_id", "product_id", "rating", "text",
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("string").alias("user_id"),
        level.alias("user_level"),
        F.col("n_chars").cast("int").alias("helpful_votes"),
        F.lit("{}").alias("raw"),
        fetched.cast("timestamp_ntz").alias("fetched_at"),
    )


PAGE_SIZE = 10


def _stamp(pattern: str) -> Column:
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.col("doc_id").cast("int")
    )
    bad = F.col("doc_id") % 7 == 0
    return F.when(bad, "unknown").otherwise(F.date_format(at, pattern))


def landed_pages(spark: SparkSession, sf_dir: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """Payload pages ``(location, body)`` made from the documents, ten reviews each unless ``page_size`` says otherwise."""
    rows = reviews(spark, sf_dir).withColumn(
        "page",
        F.floor(F.floor(F.col("doc_id") / 20) / page_size).cast("int")
        + F.when(F.col("platform") == "jd", 0).otherwise(1),
    )
    jd_item = F.struct(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("g-"), "review_id").alias("guid"),
        F.concat(F.lit("  "), "text", F.lit("\n")).alias("content"),
        _stamp("yyyy-MM-dd HH:mm:ss").alias("creationTime"),
        F.col("rating").alias("score"),
        F.concat(F.lit("nick"), "review_id").alias("nickname"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("client "), "lang")).alias("userClientShow"),
        F.col("lang").alias("userLevelName"),
        F.col("n_chars").cast("string").alias("usefulVoteCount"),
    )
    tmall_item = F.struct(
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("t-"), "review_id")).alias("id"),
        F.concat(F.lit("r-"), "review_id").alias("tradeId"),
        F.col("text").alias("rateContent"),
        _stamp("yyyy-MM-dd HH:mm").alias("rateDate"),
        F.concat(F.lit("nick"), "review_id").alias("displayUserNick"),
        F.col("lang").alias("userVipLevel"),
    )
    page = ["product_id", "page"]

    def bodies(platform: str, item: Column, location: str, body) -> DataFrame:
        own = rows.filter(F.col("platform") == platform)
        items = own.groupBy(*page).agg(F.sort_array(F.collect_list(item)).alias("items"))
        return items.select(F.format_string(location, *page).alias("location"), body.alias("body"))

    jd = bodies(
        "jd", jd_item,
        "club.jd.com__comment_productPageComments.action__productId-%s_score-0_sortType-5_page-%d_pageSize-10_isShadowSku-0",
        F.concat(
            F.lit("fetchJSON_comment98("), F.to_json(F.struct(F.col("items").alias("comments"))), F.lit(");")
        ),
    )
    tmall = bodies(
        "tmall", tmall_item,
        "rate.tmall.com__list_detail_rate.htm__itemId-%s_currentPage-%d_order-3",
        F.to_json(F.struct(F.struct(F.col("items").alias("rateList")).alias("rateDetail"))),
    )
    return jd.unionByName(tmall)
