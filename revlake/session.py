"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. Sizes stay adaptive so that the same code fits
# eight local threads and a thousand executors.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "revlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**JOB_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a fresh temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    base = tempfile.mkdtemp(prefix="revlake-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _on_disk(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    store, at = _on_disk(spark, path)
    return store.exists(at)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder of the file system that ``path`` names, or None if it lies in another store."""
    store, at = _on_disk(spark, path)
    return at.toUri().getPath() if store.getUri().getScheme() == "file" else None


def make_path(spark: SparkSession, path: str) -> None:
    store, at = _on_disk(spark, path)
    store.mkdirs(at)


def remove_path(spark: SparkSession, path: str) -> None:
    store, at = _on_disk(spark, path)
    store.delete(at, True)


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows that are few in bytes but costly to expand over all shuffle partitions.

    An explicit number keeps adaptive coalescing, which goes by bytes, from undoing it.
    """
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, spark.sparkContext.defaultParallelism), *keys)


# Texts take about a third less than in Spark's usual compression, and every layer is written more than once.
PACKED = {"compression": "zstd"}

# the scope of the running thread or task; each keeps its own paths
_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below one folder per application, so leftovers can be told by owner."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/revlake-{app}/{name}-{uuid.uuid4().hex}"
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch tables written inside the block once it is left."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in own:
            remove_path(spark, path)


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what is run inside the block."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def tidy_shuffles(spark: SparkSession):
    """Remove what a write inside the block has shuffled once it ends, where Spark would wait for a collection on the driver."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def materialize(df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (or a ``path`` taken there before) as Parquet and read it back.

    Unlike a cached frame this survives lost executors, and unlike an RDD checkpoint later
    readers still prune columns.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with tidy_shuffles(spark):
        df.write.options(**PACKED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
