"""The layers as plans: landed pages -> raw -> processed -> analyzed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Settings
from ..functions.clean import clean_review_text
from ..functions.sentiment import SHIPPED, Lexicon
from ..functions.tokens import Tokenizer, remove_stopwords, segment_words
from ..operators.joins import fresh_reviews
from ..operators.keywords import textrank
from ..operators.language import UNKNOWN, LanguageModel, detect_language, script_language
from ..operators.language_posterior import LanguagePosterior
from ..operators.marts import run_summary
from ..operators.ranking import latest_by_key
from ..operators.sentiment_model import Scorer, model_scorer, rule_scorer, select_scorer
from ..schemas import ANALYZED, KEY, PROCESSED, RAW
from ..session import materialize, scratch_path, scratch_scope
from ..sources.landing import read_page_archive, read_payload_pages
from ..sources.payloads import (
    contiguous_pages, in_range, merge_bounds, open_pages, page_bounds, page_gap_ranges, page_gaps, parse_reviews, route_platform,
)
from ..sources.tables import ReviewTables, newest_first
from ..sources.wordlists import STOPWORDS_ZH, read_stopwords


@dataclass(frozen=True)
class TextOptions:
    """What the text steps need: words, stopwords, lexicon, models."""

    terms: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = STOPWORDS_ZH
    lexicon: Lexicon = SHIPPED
    language_model: LanguageModel | LanguagePosterior | None = None
    scorer: Scorer | None = None
    keyword_count: int = 5
    segmenter: Tokenizer | None = field(default=None, compare=False)

    def segment(self, text: Column) -> Column:
        if self.segmenter:
            return self.segmenter(text)
        words = {*self.terms, *self.stopwords, *self.lexicon.positive, *self.lexicon.negative}
        return segment_words(text, words)

    @classmethod
    def from_settings(cls, spark: SparkSession, settings: Settings, **more) -> TextOptions:
        if settings.stopwords_path:
            # a hand-kept word list, folded into the plan as literals
            words = read_stopwords(spark, settings.stopwords_path).collect()
            more["stopwords"] = tuple(sorted(r.term for r in words))
        scorer = select_scorer(
            settings.sentiment_backend,
            lambda: model_scorer(PipelineModel.load(settings.model_path)),
            more.get("lexicon", SHIPPED),
        )
        return cls(scorer=scorer, keyword_count=settings.keyword_count, **more)


def process_reviews(raw: DataFrame, options: TextOptions = TextOptions()) -> DataFrame:
    """Raw to processed: clean, tokenise, tag the language."""
    clean = raw.withColumn("clean_text", clean_review_text(F.col("text")))
    rows = clean.withColumn(
        "tokens", remove_stopwords(options.segment(F.col("clean_text")), options.stopwords)
    )
    if options.language_model is None:
        tag = F.coalesce(script_language(F.col("clean_text")), F.lit(UNKNOWN))
        rows = rows.withColumn("language", tag)
    elif isinstance(options.language_model, LanguagePosterior):
        rows = rows.withColumn("language", options.language_model.tag(F.col("clean_text"))["language"])
    else:
        tags = detect_language(clean.select(*KEY, "clean_text"), KEY, options.language_model)
        rows = rows.join(tags.select(*KEY, "language"), KEY)
    return rows.select(*PROCESSED.names)


def analyze_reviews(processed: DataFrame, options: TextOptions = TextOptions()) -> DataFrame:
    """Processed to analyzed: sentiment and the top keywords; an empty text has none."""
    scored = (options.scorer or rule_scorer(options.lexicon))(processed)
    ranked = textrank(
        options.segment(F.col("clean_text")),
        top_n=options.keyword_count,
        stopwords=options.stopwords,
    )
    return scored.withColumns(
        {
            "sentiment_label": F.col("sentiment.label"),
            "sentiment_score": F.col("sentiment.score"),
            "keywords": F.transform(ranked, lambda k: k["term"]),
        }
    ).select(*ANALYZED.names)


def batch_order() -> list[Column]:
    """Later fetch, later page, later item wins inside a batch."""
    return [F.desc(c) for c in ("fetched_at", "page", "seq", "product_id")] + [F.desc(F.xxhash64("raw"))]


def parse_landed(pages: DataFrame) -> DataFrame:
    """Every page parsed once and stored; empty and broken pages stay as rows without a ``seq``."""
    return materialize(parse_reviews(open_pages(pages), keep_empty=True), "parsed")


def record_landing(parsed: DataFrame, tables: ReviewTables) -> None:
    """Sizes of readable pages, pages that cannot be read, and reviews without an id, as tables.

    All reviews without an id share one key in ``raw_reviews``, where the newest wins; here each has its place as the key.
    """
    place = F.concat_ws("/", "product_id", "page")
    readable = parsed.filter(F.col("n_items").isNotNull() & (F.coalesce("seq", F.lit(0)) == 0))
    tables.upsert("page_index", readable.withColumn("review_id", place))
    broken = parsed.filter(F.col("error").isNotNull())
    if not broken.isEmpty():
        known = F.when(F.col("product_id").isNotNull() & F.col("page").isNotNull(), place)
        tables.upsert("quarantined_pages", broken.withColumn("review_id", F.coalesce(known, F.md5(F.coalesce("payload", F.lit(""))))))
    idless = parsed.filter(F.col("seq").isNotNull() & (F.col("review_id") == ""))
    if not idless.isEmpty():
        tables.upsert("idless_reviews", idless.withColumn("review_id", F.concat_ws("/", place, "seq")))


def known_pages(tables: ReviewTables) -> DataFrame:
    """Pages that have landed in any form; ``n_items`` is null for broken ones."""
    page = ["platform", "product_id", "page"]
    broken = tables.read("quarantined_pages").filter("product_id IS NOT NULL AND page IS NOT NULL")
    return tables.read("page_index").select(*page, "n_items").unionByName(
        broken.select(*page, F.lit(None).cast("int").alias("n_items"))
    )


def missing_pages(tables: ReviewTables) -> DataFrame:
    """Pages before the end of their product that have not landed in any form."""
    return page_gaps(known_pages(tables))


def landing_report(tables: ReviewTables) -> DataFrame:
    """Number of quarantined pages, missing pages and reviews without an id by platform and product."""
    product = ["platform", "product_id"]
    gaps = page_gap_ranges(known_pages(tables)).withColumn("n", (F.col("last_page") - F.col("first_page") + 1).cast("long"))
    one = F.lit(1).cast("long").alias("n")
    kinds = {
        "quarantined": tables.read("quarantined_pages").select(*product, one),
        "missing": gaps.select(*product, "n"),
        "idless": tables.read("idless_reviews").select(*product, one),
    }
    rows = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    counts = [F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind) for kind in kinds]
    return every.groupBy(*product).agg(*counts)


def product_bounds(parsed: DataFrame, tables: ReviewTables) -> DataFrame:
    """Bounds of the products in this batch from all batches so far, kept as the table ``product_pages``.

    The pages of one product may land in different batches, so its first empty page can only be told from all of
    them; the table has one row per product, so that no earlier page is read again.
    """
    own = materialize(page_bounds(in_range(parsed)), "bounds")
    products = own.select("platform", F.col("product_id").alias("review_id"))
    stored = tables.read_around("product_pages", products).join(own.select("platform", "product_id"), ["platform", "product_id"], "left_semi")
    both = materialize(merge_bounds(own, stored), "bounds")
    tables.upsert("product_pages", both.withColumn("review_id", F.col("product_id")), unique=True)
    return both


def ingest_parsed(
    parsed: DataFrame, tables: ReviewTables, *, incremental: bool = True,
    max_pages: int | None = None, stored_pages: bool = False, path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Store the new reviews of parsed pages; returns the fetched and the fresh rows, the latter stored in ``path`` if given.

    What does not become a review of its own is stored too, see ``record_landing``. Only those partitions of
    the raw table are read that may hold a fetched id.
    """
    record_landing(parsed, tables)
    bounds = product_bounds(parsed, tables) if stored_pages else None
    fetched = contiguous_pages(parsed, max_pages, bounds).filter(F.col("seq").isNotNull()).drop("error", "payload")
    stored = tables.read_around("raw_reviews", fetched) if incremental else tables.read("raw_reviews")
    fresh = materialize(fresh_reviews(fetched, stored, incremental), "fresh", path)
    tables.upsert("raw_reviews", fresh, batch_order())
    return fetched, fresh


def ingest(
    spark: SparkSession, landing_dir: str, tables: ReviewTables, *, incremental: bool = True,
    max_pages: int | None = None, platform: str | None = None, product_id: str | None = None, archive: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Landed pages of all (or one) products into ``raw_reviews``; ``archive`` if files hold many pages each."""
    if platform:
        route_platform(platform)
    tables.init_tables()
    pages = (read_page_archive if archive else read_payload_pages)(spark, landing_dir)
    if platform:
        pages = pages.filter(F.col("platform") == platform)
    if product_id:
        pages = pages.filter(F.col("product_id") == product_id)
    return ingest_parsed(
        parse_landed(pages), tables, incremental=incremental, max_pages=max_pages
    )


def newest_in_batch(fresh: DataFrame) -> DataFrame:
    """Fresh rows with one row per key, as the raw table keeps them."""
    return latest_by_key(fresh, KEY, batch_order()).select(*RAW.names)


def pending_raw(tables: ReviewTables) -> DataFrame:
    """Raw rows whose current fetch is not analyzed yet, also after a run that broke off."""
    done = tables.read("analyzed_reviews").select(*KEY, "fetched_at")
    return tables.read("raw_reviews").join(done, [*KEY, "fetched_at"], "left_anti")


def refine(
    tables: ReviewTables, raw: DataFrame | None = None, options: TextOptions = TextOptions(), *,
    platform: str | None = None, product_id: str | None = None,
) -> DataFrame:
    """Process and analyze raw rows (default: all pending ones, or those of one platform or product) and store both layers.

    Of given rows with one key the latest fetch counts. Each layer is computed once, stored in scratch
    and handed on from there; returns the analyzed rows, the processed ones are removed before these are stored.
    """
    tables.init_tables()
    rows = pending_raw(tables) if raw is None else latest_by_key(raw, KEY, newest_first(raw))
    if platform:
        rows = rows.filter(F.col("platform") == platform)
    if product_id:
        rows = rows.filter(F.col("product_id") == product_id)
    path = scratch_path(tables.spark, "analyzed")
    with scratch_scope(tables.spark):
        processed = materialize(process_reviews(rows, options), "processed")
        tables.upsert("processed_reviews", processed, unique=True, stored=True)
        analyzed = materialize(analyze_reviews(processed, options), path=path)
    tables.upsert("analyzed_reviews", analyzed, unique=True, stored=True)
    return analyzed


def run_reviews(
    spark: SparkSession, landing_dir: str, tables: ReviewTables, *, incremental: bool = True,
    max_pages: int | None = None, platform: str | None = None, product_id: str | None = None,
    options: TextOptions = TextOptions(), archive: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Ingest and refine; returns the newly analyzed rows and the counts per product."""
    fetched, fresh = ingest(
        spark, landing_dir, tables, incremental=incremental, max_pages=max_pages,
        platform=platform, product_id=product_id, archive=archive,
    )
    analyzed = refine(tables, options=options, platform=platform, product_id=product_id)
    return analyzed, run_summary(fetched, fresh, analyzed)


def load_landing(
    spark: SparkSession, landing_dir: str, root: str, products: Sequence[tuple[str, str]] = (),
    max_pages: int | None = None, options: TextOptions = TextOptions(), archive: bool = False,
) -> DataFrame:
    """Everything that has landed (or some products) through all layers in one job."""
    tables = ReviewTables(spark, root)
    tables.init_tables()
    pages = (read_page_archive if archive else read_payload_pages)(spark, landing_dir)
    if products:
        wanted = spark.createDataFrame(list(products), "platform string, product_id string")
        pages = pages.join(wanted, ["platform", "product_id"], "left_semi")
    with scratch_scope(spark):  # what is refined is read from the raw table
        ingest_parsed(parse_landed(pages), tables, max_pages=max_pages)
    return refine(tables, options=options)
