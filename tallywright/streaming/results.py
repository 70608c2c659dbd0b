"""Results that arrive over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import macro_scores


def read_incoming(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Files that appear in ``folder`` as a stream of rows."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def append_incoming(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Append everything that has arrived to the parquet table ``sink``, then stop.

    The checkpoint makes the append exactly-once; running it again continues
    where the last run ended.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def count_incoming(
    stream: DataFrame, groups: Sequence[str], true: str, pred: str, latency: str, state: str, checkpoint: str
) -> None:
    """Keep confusion counts up to date as rows arrive.

    The state holds one row per (group, true, predicted). Batches write the
    counts to two folders in turn, so a repeated batch overwrites its own and
    the counts before it stay readable meanwhile.
    """
    counts = stream.groupBy(
        *groups, F.col(true).alias("true_label"), F.col(pred).alias("pred_label")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(latency).alias("seconds"), F.count(latency).alias("timed"))

    def store(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{state}/turn={epoch % 2}")

    query = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_counts(spark: SparkSession, state: str) -> DataFrame:
    """The counts after the last batch."""
    epochs = spark.read.parquet(state)
    last = epochs.agg(F.max("epoch")).first()[0]
    return epochs.where(F.col("epoch") == last).drop("epoch", "turn")


def running_leaderboard(spark: SparkSession, state: str, groups: Sequence[str]) -> DataFrame:
    """Scores per group over everything counted so far."""
    counts = current_counts(spark, state)
    scores = macro_scores(counts.select(*groups, "true_label", "pred_label", "n"), groups)
    latency = counts.groupBy(*groups).agg(F.when(F.sum("timed") > 0, F.sum("seconds") / F.sum("timed")).alias("mean_latency_s"))
    return scores.join(latency, list(groups)).select(*groups, "macro_f1", "accuracy", "mean_latency_s", "n")
