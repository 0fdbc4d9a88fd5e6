"""Document frequencies kept by increments.

A batch of documents adds rows (term, change) below ``batch=<number>``; the row without a term holds its number of
documents. A vocabulary is the sum of all batches, so that texts of earlier batches are never read again, and a
batch given again replaces its own rows by dynamic partition overwrite.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import term_counts
from ..session import path_exists
from .keywords import MAX_DF, MIN_DF
from .rows import unfold


class DocumentFrequencies:
    """Frequencies below ``root``, inside the groups named by ``by``. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, by: Sequence[str] = (), *, tokens: str = "tokens") -> None:
        self.spark, self.root, self.by, self.tokens = spark, root.rstrip("/"), list(by), tokens

    def _counts(self, docs: DataFrame, sign: int) -> DataFrame:
        """One pass: each document counts once under each of its terms and once under no term."""
        whole = F.array(F.struct(F.lit(None).cast("string").alias("term")))
        terms = F.transform(term_counts(F.col(self.tokens)), lambda x: F.struct(x["term"].alias("term")))
        rows = unfold(docs, self.by, F.concat(whole, F.coalesce(terms, F.filter(whole, lambda x: F.lit(False)))), "_t")
        return rows.groupBy(*self.by, F.col("_t.term").alias("term")).agg((F.count("*") * sign).alias("change"))

    def add(self, batch: int, docs: DataFrame, replaced: DataFrame | None = None) -> None:
        """Count the documents of a batch; ``replaced`` holds former versions of documents, which leave."""
        changes = self._counts(docs, 1)
        if replaced is not None:
            changes = changes.unionByName(self._counts(replaced, -1))
        # a row of its own, so that an empty batch given again replaces what it wrote before
        mark = self.spark.range(1).select(F.lit(0).cast("bigint").alias("change"))
        rows = changes.unionByName(mark, allowMissingColumns=True).withColumn("batch", F.lit(batch).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.root)

    def vocabulary(self, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
        """Vocabulary ``(by..., term, df, n_docs)`` of all batches, as ``keywords.doc_frequency`` gives it."""
        if not path_exists(self.spark, self.root):
            raise ValueError(f"no batch below {self.root}")
        changes = self.spark.read.parquet(self.root)
        sizes = changes.filter("term IS NULL")
        df = changes.filter("term IS NOT NULL").groupBy(*self.by, "term").agg(F.sum("change").alias("df")).filter("df > 0")
        if self.by:
            df = df.join(sizes.groupBy(*self.by).agg(F.sum("change").alias("n_docs")), self.by)
        else:
            df = df.withColumn("n_docs", sizes.agg(F.sum("change")).scalar())
        return df.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))

    def follow(self, docs: DataFrame, checkpoint: str) -> StreamingQuery:
        """Add what a stream of documents has since the last run, a micro-batch at a time, and stop."""
        add = lambda rows, batch: self.add(batch, rows)
        return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
