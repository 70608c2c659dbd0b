"""Calls that are paid once: a ledger of scored prompts, filled batch by batch.

Every call has a key, the hash of model and prompt. The ledger is a table of
outcomes, one committed folder per batch. A job first finds the keys that no
committed batch holds, without their prompts. Prompts are stored for some of the
batches at a time, each prompt once, and are removed when those batches are
scored and committed, one after the other. A job that dies loses the calls of its open
batch only; started again, it does not repeat the others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cleaned, removed, scratch_path, written
from .scoring import Scorer, score_batch

CALLS_IN_A_BATCH = 100_000
#: Tasks that a batch is scored in.
TASKS = 16
#: Characters of prompts that are stored at a time, in whole batches, and into how many parts a larger whole is cut.
WINDOW_CHARS, WINDOWS = 200_000_000, 10
OUTCOME = "call_key string, raw_text string, tempo_s double, erro string, try_count int"


def call_key(model: str | Column, prompt: str | Column) -> Column:
    """Hash of model and prompt; null and empty parts differ."""
    parts = [F.col(c) if isinstance(c, str) else c for c in (model, prompt)]
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def answered_parts(spark: SparkSession, path: str) -> list[str]:
    """Folders of the committed batches."""
    system, root = _folder(spark, path)
    done = [str(s.getPath()) for s in system.listStatus(root)] if system.exists(root) else []
    return [p for p in done if p.rsplit("/", 1)[-1].startswith("batch-")]


def answered(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of all committed batches; an empty table if there is none."""
    done = answered_parts(spark, path)
    return spark.read.schema(OUTCOME).parquet(*done) if done else spark.createDataFrame([], OUTCOME)


def _commit(spark: SparkSession, table: DataFrame, path: str) -> None:
    """Write a batch beside the ledger and rename it into place: it is visible whole or not at all."""
    name = uuid.uuid4().hex
    with cleaned(spark):
        table.write.parquet(f"{path}/open-{name}")
    system, source = _folder(spark, f"{path}/open-{name}")
    if not system.rename(source, _folder(spark, f"{path}/batch-{name}")[1]):
        raise OSError(f"could not commit a batch of {path}")


def score_once(
    df: DataFrame,
    scorer: Scorer,
    ledger: str,
    model: str = "model_id",
    prompt: str = "prompt",
    base_backoff: float = 1.0,
    calls_in_a_batch: int = CALLS_IN_A_BATCH,
) -> DataFrame:
    """``score_batch`` for prompts that the ledger does not hold yet; every row gets its outcome from the ledger.

    Equal prompts of a model are called once. An outcome with an error is an
    outcome: it is not called again. Rows with a null model or prompt are called
    like any other. ``ledger`` is a folder in storage that all executors reach.
    """
    spark = df.sparkSession
    keyed = df.withColumn("call_key", call_key(model, prompt))
    # Which calls are open is found by their keys alone; no prompt is moved for it.
    found = keyed.groupBy(F.unhex("call_key").alias("_key")).agg(F.max(F.coalesce(F.length(prompt), F.lit(0))).alias("_chars"))
    known = answered(spark, ledger).select(F.unhex("call_key").alias("_key"), F.lit(True).alias("_known"))
    listed = written(found.join(known, "_key", "left").where("_known IS NULL").drop("_known"), "open-calls")
    n_calls, chars = listed.agg(F.count(F.lit(1)), F.sum("_chars")).first()
    if n_calls:
        # Some are answered already: only then has every call to be looked up.
        left = listed.select("_key") if next(iter(answered_parts(spark, ledger)), None) else None
        batches = -(-n_calls // calls_in_a_batch)
        windows = min(max(-(-chars // WINDOW_CHARS), 1), WINDOWS, batches)
        # A place by hash: another job that runs beside this one takes the same calls first.
        place = F.pmod(F.xxhash64(model, prompt), F.lit(1 << 32)).cast("double") / F.lit(float(1 << 32))
        number = F.least(F.floor(place * F.lit(batches)), F.lit(batches - 1)).cast("int")
        for low, high in ((batches * w // windows, batches * (w + 1) // windows) for w in range(windows)):
            some = df.withColumn("_batch", number).where(F.col("_batch").between(low, high - 1)).select(
                "_batch", call_key(model, prompt).alias("call_key"), F.col(model).alias("_model"), F.col(prompt).alias("_prompt")
            )
            if left is not None:
                some = some.withColumn("_key", F.unhex("call_key")).join(left, "_key", "left_semi").drop("_key")
            _score_window(spark, some, scorer, ledger, base_backoff)
    return keyed.join(answered(spark, ledger), "call_key").drop("call_key")


def _score_window(spark: SparkSession, calls: DataFrame, scorer: Scorer, ledger: str, base_backoff: float) -> None:
    """Store the calls of some batches, ``_batch, call_key, _model, _prompt``, each once; score and commit one batch after the other."""
    folder = scratch_path(spark, "call-batches")
    # One shuffle deals the calls out to the batches' files and brings equal ones together.
    dealt = calls.withColumn("_slot", F.pmod(F.xxhash64("call_key"), F.lit(TASKS))).repartition("_batch", "_slot")
    once = dealt.groupBy("_batch", "_slot", "call_key").agg(F.first("_model").alias("_model"), F.first("_prompt").alias("_prompt"))
    with cleaned(spark):
        once.drop("_slot").write.option("compression", "zstd").partitionBy("_batch").parquet(folder)
    system, root = _folder(spark, folder)
    held = sorted(int(s.getPath().getName().split("=")[1]) for s in system.listStatus(root) if s.getPath().getName().startswith("_batch="))
    schema = once.select("call_key", "_model", "_prompt").schema
    for turn in held:
        batch = spark.read.schema(schema).parquet(f"{folder}/_batch={turn}").repartition(TASKS)
        # The condition always holds; with it, whatever reads the table makes the calls.
        scored = score_batch(batch, scorer, "_model", "_prompt", base_backoff).where("try_count IS NOT NULL")
        _commit(spark, scored.select("call_key", "raw_text", "tempo_s", "erro", "try_count"), ledger)
    removed(spark, folder)
