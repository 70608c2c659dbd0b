"""Frontiers, convergence, running bests, champions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import real
from .filters import timed_runs
from .ranking import MAX_GROUP_ROWS, previous_value, running_max, top_rows
from .sizing import join_key_stats


def pareto_frontier(
    df: DataFrame,
    time: str,
    score: str,
    keys: Sequence[str] = (),
    keep_untimed: bool = False,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Rows whose score no faster row beats; ties stay. A missing or NaN score is never on the frontier.

    Only the best score per time can be on the frontier, so the running maximum
    is taken over one point per (group, time), and the surviving points select
    their rows.
    """
    if not keep_untimed:
        df = timed_runs(df, time)
    points = df.groupBy(*keys, time).agg(F.max(real(score)).alias("_best"), F.count(F.lit(1)).alias("_rows"))
    faster = running_max(points, keys, [time], "_best", "_faster", False, max_group_rows)
    frontier = faster.where(F.col("_best").isNotNull()).where(
        F.col("_faster").isNull() | (F.col("_best") >= F.col("_faster"))
    )
    frontier = frontier.select(*keys, time, "_best", "_rows")
    on = [*keys, time]
    return join_key_stats(df, frontier, on, "_rows").where(F.col(score) == F.col("_best")).drop("_best", "_rows")


def convergence_point(df: DataFrame, keys: Sequence[str], gen: str, best: str, tolerance: float = 1e-9) -> DataFrame:
    """First generation that reaches the group's best value."""
    peaks = df.groupBy(*keys).agg(F.max(real(best)).alias("best_value"), F.count(F.lit(1)).alias("_rows"))
    reached = join_key_stats(df.select(*keys, gen, best), peaks, keys, "_rows").where(
        real(best) >= F.col("best_value") - tolerance
    )
    return reached.groupBy(*keys, "best_value").agg(F.min(gen).alias("convergence_gen"))


def best_generation(df: DataFrame, keys: Sequence[str], gen: str, best: str) -> DataFrame:
    """The row with the highest value per group; the earliest generation on ties."""
    return top_rows(df, keys, [real(best).desc_nulls_last(), F.col(gen)])


def best_so_far(
    df: DataFrame, keys: Sequence[str], gen: str, value: str, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Best value of any generation up to each one."""
    per_generation = df.groupBy(*keys, gen).agg(F.max(real(value)).alias("gen_best"))
    return running_max(per_generation, keys, [gen], "gen_best", "best_so_far", True, max_group_rows)


def champions(df: DataFrame, keys: Sequence[str], score: str, tie_break: Sequence[str]) -> DataFrame:
    """Best row per group; on equal scores the first by ``tie_break`` (which must be unique). NaN counts as missing."""
    return top_rows(df, keys, [real(score).desc_nulls_last(), *[F.col(c) for c in tie_break]])


def best_overall(df: DataFrame, holdout: str, train: str, tie_break: Sequence[str]) -> DataFrame:
    """The one best row, by holdout score or, where a table has none, by train score."""
    score = holdout if holdout in df.columns else train
    return df.orderBy(real(score).desc_nulls_last(), *tie_break).limit(1)


def elite_topk(
    candidates: DataFrame, carried: DataFrame, keys: Sequence[str], score: str, tie_break: Sequence[str], k: int
) -> DataFrame:
    """Best ``k`` of the candidates and the carried-over rows together."""
    pool = candidates.unionByName(carried)
    return top_rows(pool, keys, [real(score).desc_nulls_last(), *[F.col(c) for c in tie_break]], k)


def run_duration(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cumulative: str,
    out: str = "own_seconds",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Own time of each run from a clock that keeps running over all of them."""
    before = previous_value(df, keys, order, cumulative, "_previous", max_group_rows)
    return before.withColumn(out, F.col(cumulative) - F.coalesce("_previous", F.lit(0.0))).drop("_previous")
