"""Exact deduplication as a stateful stream.

Every document becomes a narrow row: digest of the normalised text, stable
identifier and a content locator. A Structured Streaming aggregation without a
watermark keeps one state row per digest, for ever, in a disk-backed (RocksDB)
state store: the best row so far and the number of rows. State rows are a few
dozen bytes whatever the texts are, and the map side combines copies before
they are shuffled, so a hot text costs one row per task.

Digests with more than one row are hits. For hits the full texts are compared,
again with map-side grouping; should two different texts share a digest, their
rows are grouped by the text itself instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, written
from .common import SPACES, load, numbered, whole_text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "spark.sql.streaming.stateStore"
#: Disk-backed state. Every partition has a store of its own, most of them small, so none reserves disk ahead, and all
#: stores of an executor share one bounded memory.
STATE_SETTINGS = {
    f"{STATE}.providerClass": ROCKSDB,
    f"{STATE}.rocksdb.allowFAllocate": "false",
    f"{STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{STATE}.rocksdb.maxMemoryUsageMB": "128",
}


def normalised(text: str | Column) -> Column:
    """The text without white space (space, \\x09 to \\x0D)."""
    return F.translate(whole_text(text), SPACES, "")


def _locator(row_col: str | None) -> Column:
    return (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("locator")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, digest_chars: int, row_col: str | None) -> DataFrame:
    """One narrow row per document: state key, digest, number of code points, identifier, locator."""
    sha = F.sha2(normalised(text_col), 256)
    return docs.select(
        F.substring(sha, 1, digest_chars).alias("digest"),
        sha.alias("text_sha256"),
        F.length(whole_text(text_col)).cast("long").alias("n_points"),
        F.col(id_col).alias("doc_id"),
        _locator(row_col),
    )


def _best() -> Column:
    """The row that stays: most code points, then smallest id (null last), then first locator."""
    return F.min(
        F.struct(
            (-F.col("n_points")).alias("minus_points"),
            F.col("doc_id").isNull().alias("no_id"),
            F.col("doc_id").alias("doc_id"),
            F.col("locator").alias("locator"),
        )
    ).alias("best")


def stream_groups(spark: SparkSession, rows: DataFrame, checkpoint: str, sink: str) -> DataFrame:
    """Run the stateful aggregation over the stream ``rows`` until it has no more input.

    Each micro-batch writes the state rows that it changed to a folder of its
    own under ``sink``; a repeated batch overwrites its folder. Counts only
    grow, so the last state of a digest is the one with the highest batch.
    """
    state = rows.groupBy("digest").agg(_best(), F.count(F.lit(1)).alias("group_size"))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    # An empty first folder, so that a stream without any row can be read as well.
    spark.createDataFrame([], state.schema).write.mode("overwrite").parquet(f"{sink}/batch=-1")
    states = spark.read.schema(T.StructType([*state.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(sink)
    last = states.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("last"))
    return last.select("digest", "last.best", "last.group_size")


def collisions(docs: DataFrame, hits: DataFrame, text_col: str, digest_chars: int) -> DataFrame:
    """Digests of ``hits`` that stand for different texts, found by comparing the full texts.

    Texts are grouped in the map tasks first: of a hot text each task sends one copy.
    """
    norm = docs.select(normalised(text_col).alias("norm"))
    texts = norm.withColumn("digest", F.substring(F.sha2("norm", 256), 1, digest_chars))
    distinct = texts.join(hits, "digest", "left_semi").groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1").select("digest")


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("locator") == F.col("best.locator")).alias("kept"),
        "text_sha256",
        "locator",
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_chars: int = 64,
    files_per_batch: int = 100_000,
    row_col: str | None = None,
) -> DataFrame:
    """Group documents whose texts are equal apart from white space.

    Of equal texts the row with the most code points stays, then the smallest
    id. Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256, locator``. Exactly one row of a group has ``kept``. ``row_col``
    names a column of unique numbers to use as locator. ``digest_chars`` is the
    number of hex digits of the state key; a short key saves state and leaves
    more work to the comparison of full texts.

    Defined results: a null text equals the empty text; a null id sorts last;
    repeated rows and ids count as rows of their own and one of them stays; an
    empty table gives an empty result. Other columns of ``docs`` are not read,
    so their names cannot clash.
    """
    spark = docs.sparkSession
    home = scratch_path(spark, "exact-dedup")
    fingerprints(docs, id_col, text_col, digest_chars, row_col).write.parquet(f"{home}/rows")
    rows = spark.read.parquet(f"{home}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/rows")
    groups = written(stream_groups(spark, stream, f"{home}/state", f"{home}/groups"), "groups")
    hits = groups.where("group_size > 1").select("digest")
    clashing = written(collisions(docs, hits, text_col, digest_chars), "collisions")
    result = _result(rows.join(groups, "digest"))
    if clashing.isEmpty():
        return result
    result = _result(rows.join(groups, "digest").join(clashing, "digest", "left_anti"))
    apart = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(whole_text(text_col)).cast("long").alias("n_points"),
        normalised(text_col).alias("norm"),
        _locator(row_col),
    ).withColumn("text_sha256", F.sha2("norm", 256))
    apart = apart.withColumn("digest", F.substring("text_sha256", 1, digest_chars))
    apart = written(apart.join(clashing, "digest", "left_semi"), "apart")
    by_text = written(apart.groupBy("norm").agg(_best(), F.count(F.lit(1)).alias("group_size")), "by-text")
    return result.unionByName(_result(apart.join(by_text, "norm")))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.

    Defined results: those of ``exact_dedup``; null and blank texts are equal,
    so one of them stays; of repeated rows one stays; an empty table gives no
    rows; columns may have any names.
    """
    rows, row = numbered(docs, "exact-rows")
    dropped = exact_dedup(rows, row_col=row, **options).where("not kept").select(F.col("locator").alias(row))
    return rows.join(written(dropped, "exact-dropped"), row, "left_anti").drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir)).drop("locator")


SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
