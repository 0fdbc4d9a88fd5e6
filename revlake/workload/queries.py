"""One query per operator over the benchmark tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Settings
from ..functions import clean, coerce, sentiment, tokens as tok
from ..functions.codec import decode_list, encode_list
from ..operators import (
    dictionary, heavy_hitters, insights, joins, keywords, language, language_posterior, marts, ranking, rolling, segmentation, sentiment_model, topics,
)
from ..operators.frequencies import DocumentFrequencies
from ..operators.rows import unfold
from ..plans.reviews import TextOptions, analyze_reviews, ingest, load_landing, missing_pages, process_reviews
from ..session import materialize, scratch_path
from ..sources import landing, payloads, wordlists
from ..sources.tables import ReviewTables
from ..streaming.ingest import ingest_stream
from .tables import (
    LEXICON, STOPWORDS, landed_pages, load, raw_rows, reviews, scored, spread, tokenized, with_tokens,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

OPTIONS = TextOptions(stopwords=STOPWORDS, lexicon=LEXICON, segmenter=tok.tokenize)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _digest(text: Column, name: str) -> list[Column]:
    return [F.md5(text).alias(f"{name}_md5"), F.char_length(text).alias(f"{name}_chars")]


# -- scans and parsing --------------------------------------------------------


def _land(spark: SparkSession, sf: str) -> str:
    """Landing folder with one text file per derived page."""
    path = scratch_path(spark, "landing")
    landing.write_payload_pages(landed_pages(spark, sf), path)
    return path


DAMAGED_PAGE = 3  # reviews on each page of a damaged landing; most products then have over ten pages


def _damaged(spark: SparkSession, sf: str) -> ReviewTables:
    """Tables of a landing in which some pages are missing, cut off, or hold reviews without ids, read with default arguments."""
    pages = landed_pages(spark, sf, DAMAGED_PAGE)
    number = F.regexp_extract("location", "(?:_page|currentPage)-([0-9]+)", 1).cast("int")
    body = (
        F.when(number % 7 == 2, F.substring("body", 1, 60))
        .when(number % 7 == 4, F.regexp_replace("body", '"(id|guid|tradeId)":', '"no_$1":'))
        .otherwise(F.col("body"))
    )
    path = scratch_path(spark, "landing")
    landing.write_payload_pages(pages.filter(number % 7 != 6).select("location", body.alias("body")), path)
    tables = ReviewTables(spark, scratch_path(spark, "damaged"))
    ingest(spark, path, tables)
    return tables


@query
def ingest_defaults(spark, sf):
    raw = _damaged(spark, sf).read("raw_reviews").filter("review_id <> ''")
    return raw.select("platform", "product_id", "review_id", "rating", *_digest(F.col("text"), "text"))


@query
def quarantined_pages(spark, sf):
    return _damaged(spark, sf).read("quarantined_pages").select("platform", "product_id", "page", "error")


@query
def ingest_gaps(spark, sf):
    return missing_pages(_damaged(spark, sf))


@query
def idless_reviews(spark, sf):
    lost = _damaged(spark, sf).read("idless_reviews")
    return lost.select("platform", "product_id", "page", "seq", *_digest(F.col("text"), "text"))


def _opened(spark: SparkSession, sf: str) -> DataFrame:
    pages = landing.payload_pages(landed_pages(spark, sf), "location", "body")
    return payloads.open_pages(pages)


@query
def payload_pages(spark, sf):
    opened = payloads.open_pages(landing.read_payload_pages(spark, _land(spark, sf)))
    return opened.select("platform", "product_id", "page", "n_items")


@query
def archived_pages(spark, sf):
    """The pages out of archive files of many pages."""
    path = scratch_path(spark, "archive")
    landing.write_page_archive(landed_pages(spark, sf), path)
    opened = payloads.open_pages(landing.read_page_archive(spark, path))
    return opened.select("platform", "product_id", "page", "n_items")


@query
def unwrap_jsonp(spark, sf):
    docs = spread(load(spark, sf, "documents"), "doc_id")
    kind = F.col("doc_id") % 3
    body = (
        F.when(kind == 0, F.concat(F.lit("  fetchJSON_c1("), "text", F.lit(");\n")))
        .when(kind == 1, F.col("text"))
        .otherwise(F.concat(F.lit("fetchJSON_c2("), "text", F.lit(");x")))
    )
    return docs.select("doc_id", *_digest(landing.unwrap_jsonp(body), "payload"))


_PARSED = ["platform", "product_id", "review_id", "rating", "user_id", "user_level", "helpful_votes", "page"]


def _parsed(df: DataFrame, raw_field: str) -> DataFrame:
    return df.select(
        *_PARSED,
        *_digest(F.col("text"), "text"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.get_json_object("raw", f"$.{raw_field}").alias("raw_id"),
    )


@query
def parse_jd_reviews(spark, sf):
    return _parsed(payloads.parse_jd_reviews(_opened(spark, sf)), "guid")


@query
def parse_tmall_reviews(spark, sf):
    return _parsed(payloads.parse_tmall_reviews(_opened(spark, sf)), "tradeId")


def _page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of two documents; short documents count as no item."""
    pages = reviews(spark, sf).withColumn(
        "page",
        F.floor(F.floor(F.col("doc_id") / 20) / 2).cast("int")
        + F.when(F.col("platform") == "jd", 0).otherwise(1),
    )
    return pages.groupBy("platform", "product_id", "page").agg(
        F.count_if(F.col("n_chars") > 700).alias("n_items")
    )


@query
def contiguous_pages(spark, sf):
    return payloads.contiguous_pages(_page_sizes(spark, sf), max_pages=None).select(
        "platform", "product_id", "page", "n_items"
    )


@query
def page_gaps(spark, sf):
    landed = _page_sizes(spark, sf).filter(F.col("n_items") > 0)
    return payloads.page_gaps(landed, max_pages=None)


@query
def route_platform(spark, sf):
    docs = reviews(spark, sf)
    address = F.concat(
        F.when(F.col("lang") == "de", "https://shop.example/r?productId=")
        .when(F.col("platform") == "jd", "https://club.jd.com/c?productId=")
        .otherwise("https://rate.tmall.com/l?itemId="),
        "product_id", F.lit("&page=1&currentPage=1"),
    )
    body = F.when(F.col("n_chars") > 700, F.lit('{"comments": null}')).otherwise(F.col("text"))
    pages = docs.select(address.alias("url"), body.alias("body"))
    opened = payloads.open_pages(landing.payload_pages(pages, "url", "body"))
    return opened.groupBy("platform", F.coalesce("error", F.lit("ok")).alias("status")).agg(
        F.count("*").alias("pages")
    )


@query
def stopword_list(spark, sf):
    path = scratch_path(spark, "words")
    docs = spread(load(spark, sf, "documents"), "doc_id")
    mark = F.when(F.col("lang") == "de", "#").otherwise(" ")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"), mark.alias("mark"))
    lines.select(F.concat("mark", "line").alias("value")).write.text(path)
    return wordlists.read_stopwords(spark, path)


@query
def coerce_int(spark, sf):
    events = load(spark, sf, "events")
    digits = F.regexp_extract("props", r"(\d+)", 1)
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, digits)
        .when(kind == 1, F.concat(F.lit(" "), digits, F.lit(" ")))
        .when(kind == 2, F.concat(digits, F.lit(".0")))
        .when(kind == 3, F.concat(F.lit("-"), digits))
        .when(kind == 4, F.concat(F.lit("x"), digits))
        .otherwise("")
    )
    return events.select("event_id", coerce.coerce_int(text).alias("parsed"))


@query
def parse_times(spark, sf):
    events = load(spark, sf, "events")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format("ts", "yyyy-MM-dd HH:mm"))
        .when(kind == 2, F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
        .otherwise("")
    )
    show = "yyyy-MM-dd HH:mm:ss"
    return events.select(
        "event_id",
        F.date_format(coerce.parse_seconds_time(text), show).alias("with_seconds"),
        F.date_format(coerce.parse_minutes_time(text), show).alias("with_minutes"),
    )


@query
def review_fields(spark, sf):
    rows = load(spark, sf, "conversations")
    primary = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.col("role"))
    fallback = F.when(F.col("role") == "user", F.col("conv_id").cast("string"))
    return rows.select(
        "conv_id", "turn",
        coerce.review_key(primary, fallback).alias("review_id"),
        coerce.first_present(primary, fallback).alias("user_id"),
        *_digest(coerce.strip_text(F.concat(F.lit(" \t\n"), "text", F.lit("\r\n "))), "text"),
    )


# -- cleaning -----------------------------------------------------------------


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "pages"), "page_id")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "documents"), "doc_id")


@query
def strip_html(spark, sf):
    return _pages(spark, sf).select("page_id", *_digest(clean.strip_html(F.col("html")), "shown"))


@query
def nfkc(spark, sf):
    wide = F.translate("text", "abcxyzABC019!?,;: ", "ａｂｃｘｙｚＡＢＣ０１９！？，；：　")
    return _docs(spark, sf).select("doc_id", *_digest(clean.nfkc(wide), "text"))


@query
def drop_urls(spark, sf):
    text = F.concat(F.lit("see "), "url", F.lit(" or\n"), "url", F.lit("\n"), "html")
    return _pages(spark, sf).select("page_id", *_digest(clean.drop_urls(text), "text"))


@query
def squeeze_punct(spark, sf):
    text = F.replace(F.replace(F.col("text"), F.lit("."), F.lit("!!!!")), F.lit(","), F.lit("。。。"))
    return _docs(spark, sf).select("doc_id", *_digest(clean.squeeze_punct(text), "text"))


@query
def squeeze_whitespace(spark, sf):
    text = F.replace(F.col("text"), F.lit(" "), F.lit(" \t "))
    return _docs(spark, sf).select("doc_id", *_digest(clean.squeeze_ws(text), "text"))


@query
def clean_review_text(spark, sf):
    return _pages(spark, sf).select(
        "page_id", *_digest(clean.clean_review_text(F.col("html")), "clean")
    )


# -- tokens and language ------------------------------------------------------


def _joined(tokens: Column) -> list[Column]:
    return [F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5")]


@query
def tokenize(spark, sf):
    return _docs(spark, sf).select("doc_id", *_joined(tok.tokenize(F.col("text"))))


@query
def remove_stopwords(spark, sf):
    tokens = tok.tokenize(F.col("text"), stopwords=STOPWORDS)
    return _docs(spark, sf).select("doc_id", *_joined(tokens))


def _frequent_words(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)))
    words = unfold(_docs(spark, sf), [], found, "term")
    return words.groupBy("term").agg(F.count("*").alias("n")).filter(
        (F.col("n") >= 150) & (F.char_length("term") > 1)
    )


@query
def tokenize_with_dictionary(spark, sf):
    out = segmentation.tokenize_longest(
        _docs(spark, sf), ["doc_id"], _frequent_words(spark, sf), text="text"
    )
    return out.select("doc_id", *_joined(F.col("tokens")))


RUNS = r"[\p{L}\p{N}]+"


def _learned(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(dictionary.learn_dictionary(_docs(spark, sf), text="text", runs=r"\p{L}+", min_count=20), "learned")


@query
def tokenize_lattice(spark, sf):
    out = segmentation.tokenize_lattice(_docs(spark, sf), ["doc_id"], _learned(spark, sf), text="text", letters=True)
    return out.select("doc_id", *_joined(F.col("tokens")))


@query
def tokenize_unknown(spark, sf):
    learned = _learned(spark, sf)
    runs = materialize(segmentation.counted_runs(_docs(spark, sf), RUNS, "text"), "runs")
    segmented = segmentation.tokenize_lattice(runs, ["run"], learned, text="run", letters=True, tokens="words")
    out = segmentation.tokenize_lattice(
        _docs(spark, sf), ["doc_id"], learned, text="text", letters=True, tags=segmentation.learn_tags(segmented)
    )
    return out.select("doc_id", *_joined(F.col("tokens")))


@query
def reestimate_dictionary(spark, sf):
    runs = segmentation.counted_runs(_docs(spark, sf), RUNS, "text")
    met = segmentation.reestimate(runs, _learned(spark, sf))
    return met.select("term", F.round("n", 3).alias("n"))


@query
def learn_dictionary(spark, sf):
    learned = _learned(spark, sf)
    return learned.select(
        "term", "n",
        *[F.round(c, 6).alias(c) for c in ("pmi", "left_entropy", "right_entropy")],
    )


@query
def language_posterior_folds(spark, sf):
    """Every document tagged by a model that was fitted on the other half of them."""
    docs = _docs(spark, sf)
    half = F.pmod("doc_id", F.lit(2))
    parts = []
    for fold in (0, 1):
        model = language_posterior.train_language_posterior(docs.filter(half != fold))
        tagged = docs.filter(half == fold).select("doc_id", model.tag(F.col("text")).alias("t"))
        parts.append(tagged.select("doc_id", "t.language", F.round("t.posterior", 3).alias("posterior")))
    return parts[0].unionByName(parts[1])


@query
def detect_language(spark, sf):
    docs = _docs(spark, sf)
    model = language.train_language_model(docs)
    return language.detect_language(docs, ["doc_id"], model, text="text").select(
        "doc_id", "language", F.round("log_likelihood", 3).alias("log_likelihood")
    )


@query
def encode_lists(spark, sf):
    tokens = _docs(spark, sf).select("doc_id", tok.tokenize(F.col("text")).alias("tokens"))
    coded = tokens.select("doc_id", encode_list(F.col("tokens")).alias("json"))
    return coded.select(
        "doc_id", *_digest(F.col("json"), "json"), *_joined(decode_list(F.col("json")))
    )


@query
def lexicon_membership(spark, sf):
    words = unfold(tokenized(spark, sf), ["review_id"], "tokens", "term")
    table = wordlists.lexicon_table(spark, LEXICON)
    kept = wordlists.keep_listed(words, table)
    return kept.groupBy("term").agg(F.count("*").alias("n"))


# -- sentiment ----------------------------------------------------------------


@query
def lexicon_hits(spark, sf):
    text = F.col("text")
    return reviews(spark, sf).select(
        "review_id",
        sentiment.lexicon_hits(text, LEXICON).alias("hits"),
        sentiment.negation_factor(text, LEXICON).alias("factor"),
        F.round(sentiment.length_divisor(text), 6).alias("divisor"),
    )


def _labels(df: DataFrame) -> DataFrame:
    return df.select(
        "platform", "review_id", "sentiment_label", F.round("sentiment_score", 6).alias("sentiment_score")
    )


@query
def rule_sentiment(spark, sf):
    return _labels(scored(spark, sf))


@query
def sentiment_fallback(spark, sf):
    def load_model():
        raise OSError("no model here")

    score = sentiment_model.select_scorer("model", load_model, LEXICON)
    df = score(reviews(spark, sf).withColumn("clean_text", F.col("text")))
    return df.select(
        "platform", "review_id",
        F.col("sentiment.label").alias("sentiment_label"),
        F.round("sentiment.score", 6).alias("sentiment_score"),
    )


@query
def model_label_mapping(spark, sf):
    rows = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    name = (
        F.when(F.col("lang") == "de", F.concat(F.lit("LABEL_"), "quality"))
        .when(F.col("lang") == "fr", F.col("quality").cast("string"))
        .otherwise(F.when(F.col("quality") == 1, "Positive").otherwise("NEG"))
    )
    chance = F.lit(0.5) + F.col("doc_id") % 50 / 100
    text = F.when(F.col("toxic") == 1, F.lit(" \n")).otherwise(F.col("text"))
    result = sentiment.map_model_output(text, name, chance)
    return rows.select(
        "doc_id", result["label"].alias("sentiment_label"),
        F.round(result["score"], 6).alias("sentiment_score"),
    )


def _trained(spark: SparkSession, sf: str, docs: DataFrame):
    labels = load(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    marked = materialize(docs.join(labels, "doc_id").select("clean_text", "label"), "marked")  # every iteration reads it
    return sentiment_model.train_sentiment_model(marked)


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return reviews(spark, sf).withColumn("clean_text", F.col("text"))


@query
def model_sentiment(spark, sf):
    docs = _cleaned(spark, sf)
    out = sentiment_model.model_scorer(_trained(spark, sf, docs))(docs)
    label, score = F.col("sentiment.label"), F.col("sentiment.score")
    fits = F.when(label == "positive", score >= 0.5).when(label == "negative", score <= -0.5).otherwise(score == 0)
    return out.select("platform", "review_id", fits.alias("sign_fits"), (F.abs(score) <= 1).alias("bounded"))


def _named(df: DataFrame) -> DataFrame:
    return df.select(
        "platform", "review_id", F.col("sentiment.label").alias("sentiment_label"),
        F.round("sentiment.score", 6).alias("sentiment_score"),
    )


@query
def custom_backend(spark, sf):
    """A backend of the user's own: long texts are good."""

    def backend(text: Column, rating: Column) -> Column:
        size = F.char_length(text)
        label = F.when(size > 700, "positive").when(size < 300, "negative").otherwise("neutral")
        return F.struct(label.alias("label"), F.round(F.least(size / 1000, F.lit(1.0)), 6).alias("score"))

    return _named(sentiment_model.column_scorer(backend)(_cleaned(spark, sf)))


@query
def custom_tokenizer(spark, sf):
    """TextRank over a tokenizer of the user's own: words of letters, in lower case."""
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return keywords.textrank_keywords(reviews(spark, sf), ["review_id"], text="text", stopwords=STOPWORDS, tokenizer=words)


def _processed(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(
        "platform", "review_id", "product_id", "rating", "text", "clean_text",
        F.array().cast("array<string>").alias("tokens"), F.col("lang").alias("language"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("fetched_at"),
    )


@query
def analyze_by_settings(spark, sf):
    """Settings name a stopword file, a number of keywords, and a model that is not there."""
    words = scratch_path(spark, "stopwords")
    spark.createDataFrame([(w,) for w in STOPWORDS], "value string").write.text(words)
    settings = Settings(sentiment_backend="model", model_path=scratch_path(spark, "no-model"), stopwords_path=words, keyword_count=3)
    options = TextOptions.from_settings(spark, settings, lexicon=LEXICON, segmenter=tok.tokenize)
    out = analyze_reviews(_processed(spark, sf), options)
    return out.select(
        "platform", "review_id", "sentiment_label", F.round("sentiment_score", 6).alias("sentiment_score"),
        F.array_join("keywords", " ").alias("keywords"),
    )


@query
def analyze_by_saved_model(spark, sf):
    """Settings name a model that was trained and saved before."""
    docs, path = _cleaned(spark, sf), scratch_path(spark, "model")
    _trained(spark, sf, docs).save(path)
    options = TextOptions.from_settings(spark, Settings(sentiment_backend="model", model_path=path), segmenter=tok.tokenize)
    out = analyze_reviews(_processed(spark, sf), options)
    label, score = F.col("sentiment_label"), F.col("sentiment_score")
    fits = F.when(label == "positive", score >= 0.5).when(label == "negative", score <= -0.5).otherwise(score == 0)
    return out.select("platform", "review_id", fits.alias("sign_fits"))


@query
def process_with_language_model(spark, sf):
    """The language-model branch of the processed layer."""
    model = language.train_language_model(_docs(spark, sf))
    out = process_reviews(_raw(spark, sf), replace(OPTIONS, language_model=model))
    return out.select("platform", "review_id", "language", *_joined(F.col("tokens")))


# -- layers -------------------------------------------------------------------

def _raw(spark: SparkSession, sf: str, df: DataFrame | None = None, day: int = 1) -> DataFrame:
    return raw_rows(
        reviews(spark, sf) if df is None else df,
        fetched=F.lit(f"2024-01-{day:02d} 00:00:00"), level=F.lit(f"day{day}"),
    )


def _store(spark: SparkSession) -> ReviewTables:
    tables = ReviewTables(spark, scratch_path(spark, "store"))
    tables.init_tables()
    return tables


@query
def process_reviews_layer(spark, sf):
    raw = _raw(spark, sf).withColumn(
        "text", F.concat(F.lit("<p class='r'>"), "text", F.lit("</p> &amp; !!!!!"))
    )
    out = process_reviews(raw, OPTIONS)
    return out.select(
        "platform", "review_id", "rating", "language",
        *_digest(F.col("clean_text"), "clean"), *_joined(F.col("tokens")),
    )


@query
def analyze_reviews_layer(spark, sf):
    out = analyze_reviews(_processed(spark, sf), OPTIONS)
    return out.select(
        "platform", "review_id", "sentiment_label",
        F.round("sentiment_score", 6).alias("sentiment_score"),
        F.array_join("keywords", " ").alias("keywords"),
    )


def _stored_raw(spark: SparkSession, sf: str) -> ReviewTables:
    """All documents first, then the labelled ones again with other values."""
    tables = _store(spark)
    docs = reviews(spark, sf)
    tables.upsert("raw_reviews", _raw(spark, sf, docs))
    again = docs.join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    changed = again.withColumns(
        {"text": F.concat("text", F.lit(" (edited)")), "rating": F.lit(None).cast("int"), "product_id": F.lit("moved")}
    )
    tables.upsert("raw_reviews", _raw(spark, sf, changed, day=2))
    return tables


@query
def upsert_reviews(spark, sf):
    return _stored_raw(spark, sf).read("raw_reviews").select(
        "platform", "review_id", "product_id", "rating", "helpful_votes", "user_level",
        *_digest(F.col("text"), "text"),
    )


@query
def existing_review_ids(spark, sf):
    return _stored_raw(spark, sf).existing_review_ids("jd", "moved")


@query
def latest_by_key(spark, sf):
    events = load(spark, sf, "events")
    order = [F.desc("ts"), F.desc("event_id")]
    return ranking.latest_by_key(events, ["event_type", "user_id"], order).select(
        "event_type", "user_id", "event_id", "value"
    )


@query
def fresh_reviews(spark, sf):
    docs = reviews(spark, sf)
    stored = docs.join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return joins.fresh_reviews(docs, stored).select("platform", "product_id", "review_id")


@query
def run_summary(spark, sf):
    docs = reviews(spark, sf)
    marked = load(spark, sf, "labels")
    stored = docs.join(marked.select("doc_id"), "doc_id", "left_semi")
    analyzed = docs.join(marked.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return marts.run_summary(docs, joins.fresh_reviews(docs, stored), analyzed)


def _as_analyzed(df: DataFrame) -> DataFrame:
    return df.select(
        "platform", "review_id", "product_id", "rating", "text", "clean_text",
        F.array().cast("array<string>").alias("tokens"), F.col("lang").alias("language"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("fetched_at"),
        "sentiment_label", "sentiment_score", F.array().cast("array<string>").alias("keywords"),
    )


@query
def retain_raw(spark, sf):
    tables = _stored_raw(spark, sf)
    good = load(spark, sf, "labels").filter("quality = 1").select("doc_id")
    tables.upsert("analyzed_reviews", _as_analyzed(scored(spark, sf).join(good, "doc_id", "left_semi")))
    tables.retain_raw(F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    return tables.read("raw_reviews").select("platform", "review_id", "user_level")


def _analyzed(df: DataFrame) -> DataFrame:
    return df.select(
        "platform", "product_id", "review_id", "rating", "sentiment_label",
        F.round("sentiment_score", 6).alias("sentiment_score"),
        F.md5("clean_text").alias("clean_md5"),
    )


@query
def incremental_ingest(spark, sf):
    path = _land(spark, sf)
    store, progress = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    tables = ReviewTables(spark, store)
    for _ in range(2):  # the second run finds nothing new
        ingest_stream(spark, path, tables, progress, max_pages=None).awaitTermination()
    return tables.read("raw_reviews").select(
        "platform", "product_id", "review_id", "rating", *_digest(F.col("text"), "text")
    )


@query
def analyzed_stream(spark, sf):
    tables = ReviewTables(spark, scratch_path(spark, "stream"))
    ingest_stream(
        spark, _land(spark, sf), tables, scratch_path(spark, "progress"),
        max_pages=None, analyze=True, options=OPTIONS,
    ).awaitTermination()
    return _analyzed(tables.read("analyzed_reviews"))


@query
def load_landed_reviews(spark, sf):
    out = load_landing(
        spark, _land(spark, sf), scratch_path(spark, "demo"), max_pages=None, options=OPTIONS
    )
    return _analyzed(out)


# -- keywords and topics ------------------------------------------------------


@query
def textrank_keywords(spark, sf):
    return keywords.textrank_keywords(
        reviews(spark, sf), ["review_id"], text="text", stopwords=STOPWORDS
    )


@query
def doc_frequency(spark, sf):
    return keywords.doc_frequency(tokenized(spark, sf), ["review_id"])


@query
def tfidf_keywords(spark, sf):
    return keywords.tfidf_keywords(tokenized(spark, sf), ["review_id"])


@query
def tfidf_by_product(spark, sf):
    return keywords.tfidf_keywords(
        tokenized(spark, sf), ["review_id"], ["platform", "product_id"], top_n=10
    )


def _counted(spark: SparkSession, sf: str, docs: DataFrame, by: Sequence[str] = ()) -> DocumentFrequencies:
    """Frequencies of all documents, added in three batches, the second of them twice."""
    kept = DocumentFrequencies(spark, scratch_path(spark, "frequencies"), by)
    for batch in (0, 1, 1, 2):
        kept.add(batch, docs.filter(F.pmod(F.xxhash64("review_id"), F.lit(3)) == batch))
    return kept


@query
def doc_frequency_by_batches(spark, sf):
    return _counted(spark, sf, tokenized(spark, sf)).vocabulary()


@query
def tfidf_of_kept_frequencies(spark, sf):
    docs, by = tokenized(spark, sf), ["platform", "product_id"]
    kept = _counted(spark, sf, docs, by)
    return keywords.tfidf_keywords(docs, ["review_id"], by, top_n=10, frequencies=kept.vocabulary())


@query
def lda_topics(spark, sf):
    return topics.lda_topics(tokenized(spark, sf).select("review_id", "tokens"), ["review_id"])


# -- marts --------------------------------------------------------------------


@query
def sentiment_distribution(spark, sf):
    return marts.sentiment_distribution(scored(spark, sf))


@query
def sentiment_distribution_by_product(spark, sf):
    return marts.sentiment_distribution(scored(spark, sf), ["platform", "product_id"])


@query
def headline_metrics(spark, sf):
    return marts.headline_metrics(scored(spark, sf), ["platform"])


@query
def rating_vs_sentiment(spark, sf):
    return marts.rating_vs_sentiment(scored(spark, sf)).select(
        "platform", "review_id", "rating", "sentiment_label",
        F.round("sentiment_score", 6).alias("sentiment_score"), F.md5("clean_text").alias("clean_md5"),
    )


@query
def rating_correlation(spark, sf):
    return marts.rating_correlation(scored(spark, sf), ["platform"]).select(
        "platform", "rated", F.round("correlation", 6).alias("correlation")
    )


@query
def sentiment_by_rating(spark, sf):
    return marts.sentiment_by_rating(scored(spark, sf), ["product_id"]).select(
        "product_id", "rating", "reviews", F.round("mean_score", 6).alias("mean_score")
    )


@query
def token_frequencies(spark, sf):
    return marts.token_frequencies(tokenized(spark, sf))


@query
def word_cloud_terms(spark, sf):
    return marts.token_frequencies(tokenized(spark, sf), top_n=200)


@query
def heavy_hitter_terms(spark, sf):
    words = materialize(tokenized(spark, sf).select("tokens"), "tokens")
    return heavy_hitters.frequent_terms(words, 200)


@query
def top_terms(spark, sf):
    return insights.top_terms(with_tokens(scored(spark, sf)), "positive")


@query
def complaints_and_strengths(spark, sf):
    ranked = keywords.textrank(tok.tokenize(F.col("clean_text")), top_n=5, stopwords=STOPWORDS)
    rows = scored(spark, sf).withColumn("keywords", F.transform(ranked, lambda k: k["term"]))
    return insights.complaints_and_strengths(rows)


@query
def product_insights(spark, sf):
    return insights.product_insights(with_tokens(scored(spark, sf)), "jd", "src0")


@query
def rolling_sentiment(spark, sf):
    events = load(spark, sf, "events")
    return _rolled(rolling.rolling_sentiment(
        events, ["user_id"], score="value", time="ts", row_key="event_id"
    ))


@query
def rolling_sentiment_overall(spark, sf):
    events = load(spark, sf, "events")
    return _rolled(rolling.rolling_sentiment(events, [], score="value", time="ts", row_key="event_id"))


def _rolled(df: DataFrame) -> DataFrame:
    return df.select("event_id", "rn", F.round("rolling_sentiment", 6).alias("rolling_sentiment"))


@query
def list_analyzed(spark, sf):
    tables = _store(spark)
    tables.upsert("analyzed_reviews", _as_analyzed(scored(spark, sf)), unique=True)
    return _analyzed(tables.list_analyzed("jd", ""))


@query
def list_reviews(spark, sf):
    return _analyzed(marts.list_reviews(scored(spark, sf), "tmall", limit=50))


@query
def review_lines(spark, sf):
    return marts.review_lines(scored(spark, sf), None, "src4")
