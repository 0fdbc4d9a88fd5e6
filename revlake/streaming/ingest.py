"""Incremental ingestion of landed pages as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.reviews import TextOptions, ingest_parsed, newest_in_batch, parse_landed, refine
from ..session import scratch_path, scratch_scope, settings
from ..sources.landing import stream_page_archive, stream_payload_pages
from ..sources.tables import ReviewTables


#: Page files of one batch, unless more or fewer are asked for: each takes some kilobytes of the driver while its batch is planned.
PAGE_FILES = 20_000
# Files are listed without the hosts of their blocks, of no use for some kilobytes, and not by a task for each of them.
LISTING = {"spark.sql.sources.ignoreDataLocality": "true", "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256"}


def ingest_stream(
    spark: SparkSession,
    landing_dir: str,
    tables: ReviewTables,
    checkpoint: str,
    *,
    incremental: bool = True,
    max_pages: int | None = None,
    analyze: bool = False,
    options: TextOptions = TextOptions(),
    max_files: int | None = None,
    archive: bool = False,
) -> StreamingQuery:
    """Process what has landed since the last run and stop.

    Every write is an upsert by key and the seen-set skips stored ids, so a batch that is
    repeated after a failure changes nothing. A batch has ``max_files`` files at most; more than
    ``PAGE_FILES`` pages are several batches also without it. A page that lands after a later empty page of
    its product was seen stays out; reviews stored before an earlier page turned out to be
    empty stay in, as they would after separate runs.
    """
    tables.init_tables()
    healed = not analyze

    def one_batch(pages: DataFrame, _batch_id: int) -> None:
        nonlocal healed
        with scratch_scope(spark):
            path = scratch_path(spark, "fresh") if analyze and healed else None
            with scratch_scope(spark):  # parsed pages, and fresh rows that are read from the raw table, go before refining
                _, fresh = ingest_parsed(
                    parse_landed(pages), tables, incremental=incremental, max_pages=max_pages, stored_pages=True, path=path,
                )
            if not healed:  # once per run: whatever an earlier run left unanalyzed
                refine(tables, options=options)
                healed = True
            elif analyze:  # afterwards only the rows of this batch
                refine(tables, newest_in_batch(fresh), options)

    with settings(spark, LISTING):  # the stream keeps the settings of its start
        pages = stream_page_archive(spark, landing_dir, max_files) if archive else stream_payload_pages(spark, landing_dir, max_files or PAGE_FILES)
        return (
            pages.writeStream.foreachBatch(one_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
