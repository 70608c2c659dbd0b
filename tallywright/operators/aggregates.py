"""Group statistics, review statistics and the prediction pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import yes_no_flag
from ..functions.numbers import real
from .filters import high_quality_share


def best_per_strategy(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(real(score)).alias("best_score"))


def population_stats(df: DataFrame, keys: Sequence[str], fitness: str) -> DataFrame:
    """Average, population deviation, minimum and maximum per generation."""
    return df.groupBy(*keys).agg(
        F.avg(fitness).alias("avg"),
        F.stddev_pop(fitness).alias("std"),
        F.min(fitness).alias("min"),
        F.max(fitness).alias("max"),
        F.count(F.lit(1)).alias("nevals"),
    )


def gene_diversity(df: DataFrame, genes: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over gene positions of the population deviation at that position."""
    spread = (
        df.select(*keys, F.posexplode(genes).alias("position", "gene"))
        .groupBy(*keys, "position")
        .agg(F.stddev_pop(F.col("gene").cast("double")).alias("deviation"))
    )
    return spread.groupBy(*keys).agg(
        F.avg("deviation").alias("diversity"), F.count(F.lit(1)).alias("n_genes")
    )


def review_statistics(
    df: DataFrame,
    consistent: str,
    realism: str,
    leakage: str,
    complexity: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Percent consistent, mean realism, percent rated 4 or better, percent leaking, percent complex."""
    rating = real(F.col(f"`{realism}`").try_cast("double"))

    def percent(name: str):
        answers = F.sum(yes_no_flag(F.col(f"`{name}`")).cast("long"))
        return F.try_divide(answers * F.lit(100.0).cast("double"), F.count(F.lit(1)))

    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        percent(consistent).alias("consistency_pct"),
        F.avg(rating).alias("mean_realism"),
        high_quality_share(rating).alias("high_quality_pct"),
        percent(leakage).alias("leakage_pct"),
        percent(complexity).alias("complexity_pct"),
    )


def snapshot_stats(df: DataFrame, label: str) -> DataFrame:
    """Row count, class count and the sorted class names.

    Rows are first counted per label, so only distinct labels are gathered: they
    are the one row's result.
    """
    per_label = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return per_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"),
        F.count(label).alias("n_classes"),
        F.sort_array(F.collect_list(label)).alias("classes"),
    )


def run_total_time(df: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(seconds).alias("total_seconds"))


def prediction_pivot(
    df: DataFrame,
    index: Sequence[str],
    model: str,
    pred: str,
    order: Sequence[str],
    models: Sequence[str],
) -> DataFrame:
    """One row per item with one column per model: the first prediction in ``order``.

    ``order`` must be unique per (item, model); min_by combines on the map side,
    so many copies of one item do not travel.
    """
    first = F.min_by(F.col(pred), F.struct(*order))
    return df.groupBy(*index).pivot(model, list(models)).agg(first)


def divergent_rows(df: DataFrame, index: Sequence[str], pred: str) -> DataFrame:
    """Items on which the (non-null) predictions are not all the same.

    Minimum against maximum needs two values per item instead of a distinct set.
    """
    return (
        df.groupBy(*index)
        .agg(F.min(pred).alias("lowest"), F.max(pred).alias("highest"), F.count(pred).alias("n_predictions"))
        .where(F.col("lowest") != F.col("highest"))
    )
