"""Session builder and the shared scratch folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tallywright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job of this package assumes.

    On a cluster leave ``master`` unset and let spark-submit supply it.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors that ``spark.checkpoint.dir`` names.

    Only a local-mode session may fall back to a folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="tallywright-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that no other job uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Queries whose shuffle files nothing reads again: they go with the query, not with a later garbage collection."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark, rows: int = 1_000):
    """Whole texts go to Python in small batches."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


#: Parquet's settings for rows of many megabytes: pages and row groups end after every row, instead of after 100 rows.
LARGE_ROWS = {
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "1",
    "parquet.block.size": str(8 << 20),
    "parquet.enable.dictionary": "false",
}


def written(df: DataFrame, name: str = "table", large_rows: bool = False) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts the lineage, survives lost executors, and gives the optimizer the
    table's real size. The shuffle files of the way there are removed.
    """
    return written_to(df, scratch_path(df.sparkSession, name), large_rows)


def written_to(df: DataFrame, path: str, large_rows: bool = False) -> DataFrame:
    """``written``, to a path of the caller's."""
    with cleaned(df.sparkSession):
        df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``scratch_path`` that this job wrote and nothing reads again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released() -> None:
    """Give back to the system what a worker has freed: workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
