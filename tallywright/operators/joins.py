"""Crossing rows with catalogues, disagreement between runs, lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries up to this number are constants of the plan; more are a table, so that the plan stays small.
IN_PLAN = 1_000


def with_catalogue(df: DataFrame, entries: Sequence[Mapping], what: str = "catalogue") -> DataFrame:
    """One copy of every row per catalogue entry, the entry's fields as columns.

    The catalogue is a list of the driver: a constant of the plan or, if long, a
    one-row table that is broadcast. Either way the fan-out happens in place,
    without a shuffle.
    """
    if not entries:
        raise ValueError(f"{what} must have at least one entry")
    if len(entries) > IN_PLAN:
        rows = df.sparkSession.createDataFrame([dict(entry) for entry in entries])
        listed = rows.select(F.struct(*entries[0]).alias("_entry")).agg(F.collect_list("_entry").alias("_entries"))
        return df.join(F.broadcast(listed.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).select(
            *df.columns, F.inline("_entries")
        )
    structs = [F.struct(*[F.lit(value).alias(name) for name, value in entry.items()]) for entry in entries]
    return df.select("*", F.inline(F.array(*structs)))


def cross_prompt_model(df: DataFrame, prompts: Sequence[Mapping], models: Sequence[str]) -> DataFrame:
    """rows x prompts x models, with ``prompt_id``, ``template`` and ``model_id``."""
    calls = [
        {"prompt_id": prompt["id"], "template": prompt["template"], "model_id": model}
        for prompt in prompts
        for model in models
    ]
    return with_catalogue(df, calls, "prompts x models")


def disagreement_pairs(
    llm: DataFrame, local: DataFrame, text: str, true: str, pred: str, run: str
) -> DataFrame:
    """Where an LLM run and a local run predict different labels for the same text.

    Copies of a text are counted before the join: a row of the result stands for
    ``n_pairs`` pairs of input rows, so a text with many copies yields at most
    one row per pair of (run, label) combinations instead of all pairs of copies.
    """
    key = F.sha2(F.col(text), 256).alias("_text")
    left = llm.groupBy(key, F.col(true).alias("true_label"), F.col(pred).alias("llm_pred"), F.col(run).alias("llm_run"))
    left = left.agg(F.count(F.lit(1)).alias("_left"), F.min(text).alias("text"))
    right = local.groupBy(key, F.col(pred).alias("local_pred"), F.col(run).alias("local_run"))
    right = right.agg(F.count(F.lit(1)).alias("_right"))
    return (
        left.join(right, "_text")
        .where(F.col("llm_pred") != F.col("local_pred"))
        .select(
            "text",
            "true_label",
            "llm_pred",
            "local_pred",
            "llm_run",
            "local_run",
            (F.col("_left") * F.col("_right")).alias("n_pairs"),
        )
    )


def runtime_lookup(summary: DataFrame, evaluations: DataFrame, logs: DataFrame, key: str) -> DataFrame:
    """Add each summary row's runtime.

    The evaluation of the same key decides if there is one (a missing runtime in
    it counts as 0); otherwise the log's ``time`` is summed; otherwise 0.
    ``summary`` and ``evaluations`` have one row per key.
    """
    evaluated = evaluations.select(key, F.col("runtime_seconds").alias("_runtime"), F.lit(True).alias("_evaluated"))
    logged = logs.groupBy(key).agg(F.sum("time").alias("_logged"))
    runtime = F.when(F.col("_evaluated"), F.coalesce("_runtime", F.lit(0.0))).otherwise(
        F.coalesce("_logged", F.lit(0.0))
    )
    return (
        summary.join(evaluated, key, "left")
        .join(logged, key, "left")
        .withColumn("runtime_seconds", runtime)
        .drop("_runtime", "_evaluated", "_logged")
    )


def dimension_lookup(df: DataFrame, key: str, dimension: DataFrame, value: str, default: Column | str) -> DataFrame:
    """Left join to a dimension with unique keys; unknown keys get ``default``.

    The dimension's size is left to the optimizer, which knows it for stored
    tables and broadcasts it below spark.sql.autoBroadcastJoinThreshold.
    """
    fallback = F.lit(default) if isinstance(default, str) else default
    return df.join(dimension, key, "left").withColumn(value, F.coalesce(value, fallback))
