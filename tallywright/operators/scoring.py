"""Scoring prompts with a pluggable scorer, and collapsing a log of attempts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attempts import MAX_ATTEMPTS, NO_RETRY_PART, RATE_LIMIT_PARTS, classify_error, planned_backoff
from .ranking import top_rows

OUTCOME = "raw_text string, tempo_s double, erro string, try_count int"

Scorer = Callable[[str, str, int], str | None]


def score_one(scorer: Scorer, model: str, prompt: str, base_backoff: float) -> tuple:
    """Call ``scorer(model, prompt, attempt)`` with retries; a failure becomes an outcome, not an exception."""
    start = time.monotonic()
    for attempt in range(1, MAX_ATTEMPTS + 1):
        try:
            answer = scorer(model, prompt, attempt)
            return answer.strip() if answer else None, time.monotonic() - start, None, attempt
        except Exception as error:  # noqa: BLE001 - every failure must end up in the row
            message = str(error)
            not_initialised = isinstance(error, ValueError) and NO_RETRY_PART in message
            if not_initialised or attempt == MAX_ATTEMPTS:
                return None, time.monotonic() - start, message, attempt
            limited = any(part in message.lower() for part in RATE_LIMIT_PARTS)
            time.sleep(base_backoff * (2 ** (attempt - 1) if limited else attempt))
    raise AssertionError("unreachable")


def score_batch(
    df: DataFrame,
    scorer: Scorer,
    model: str = "model_id",
    prompt: str = "prompt",
    base_backoff: float = 1.0,
    calls_at_a_time: int = 8,
) -> DataFrame:
    """Add raw_text, tempo_s, erro and try_count for every row.

    Only the model and the prompt cross over to Python; all other columns stay in
    the JVM. Each task keeps ``calls_at_a_time`` calls going, so that one that
    waits to try again does not hold up the others; the scorer must allow it.
    A lost executor repeats its calls, so write the result (see
    ``append_results``) before using it further.
    """

    @F.pandas_udf(OUTCOME)
    def outcome(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = ["raw_text", "tempo_s", "erro", "try_count"]
        with ThreadPoolExecutor(calls_at_a_time) as pool:
            for models, prompts in batches:
                rows = list(pool.map(lambda call: score_one(scorer, *call, base_backoff), zip(models, prompts)))
                yield pd.DataFrame(rows, columns=names).astype({"try_count": "int32", "tempo_s": "float64"})

    scored = df.withColumn("_outcome", outcome.asNondeterministic()(F.col(model), F.col(prompt)))
    return scored.select(*df.columns, "_outcome.*")


def collapse_attempts(
    attempts: DataFrame,
    item: str,
    order: Sequence[str],
    error: str,
    elapsed: str,
    base_backoff: float = 1.0,
) -> DataFrame:
    """One outcome per item from a log of attempts, under the retry rule.

    Attempts count up to the first success or non-retryable error, and never
    beyond ``MAX_ATTEMPTS``. ``error`` is null on success; ``order`` is unique
    per item. Only the first attempts of an item leave its map task.
    """
    log = attempts.select(item, *order, F.col(error).alias("_error"), F.col(elapsed).alias("_elapsed"))
    first = top_rows(log, [item], [F.col(c) for c in order], MAX_ATTEMPTS)
    # At most MAX_ATTEMPTS rows per item from here on.
    tries = first.groupBy(item).agg(
        F.sort_array(F.collect_list(F.struct(*order, "_error", "_elapsed"))).alias("_tries")
    )
    final = F.transform(
        "_tries",
        lambda t: t["_error"].isNull() | (classify_error(t["_error"]) == "not_initialised"),
    )
    stop = F.array_position(final, True)
    used = F.when(stop > 0, stop).otherwise(F.size("_tries")).cast("int")
    waits = F.transform(
        F.slice("_tries", 1, F.col("try_count") - 1),
        lambda t, i: F.coalesce(planned_backoff(classify_error(t["_error"]), i + 1, base_backoff), F.lit(0.0)),
    )
    return (
        tries.withColumn("try_count", used)
        .withColumn("erro", F.get("_tries", F.col("try_count") - 1)["_error"])
        .withColumn(
            "busy_s",
            F.aggregate(
                F.slice("_tries", 1, F.col("try_count")), F.lit(0.0), lambda total, t: total + t["_elapsed"]
            ),
        )
        .withColumn("wait_s", F.aggregate(waits, F.lit(0.0), lambda total, w: total + w))
        .withColumn("tempo_s", F.col("busy_s") + F.col("wait_s"))
        .withColumn("succeeded", F.col("erro").isNull().cast("int"))
        .select(item, "succeeded", "try_count", "erro", "busy_s", "wait_s", "tempo_s")
    )
