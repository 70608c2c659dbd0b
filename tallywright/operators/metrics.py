"""Classification metrics.

Facts are shuffled once, into (group, true, predicted) counts. Everything else
is derived from that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_ROWS = ["accuracy", "macro avg", "weighted avg"]


def _ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 where the denominator is 0."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double")).otherwise(F.lit(0.0))


def confusion(
    df: DataFrame, true: str = "true_label", pred: str = "pred_label", groups: Sequence[str] = ()
) -> DataFrame:
    """Rows per (group, true, predicted)."""
    return (
        df.groupBy(*groups, F.col(true).alias("true_label"), F.col(pred).alias("pred_label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def accuracy(df: DataFrame, hit: str, groups: Sequence[str] = ()) -> DataFrame:
    """Share of rows with ``hit`` = 1; 0 for no rows."""
    share = F.coalesce(_ratio(F.sum(F.col(hit).cast("long")), F.count(F.lit(1))), F.lit(0.0))
    return df.groupBy(*groups).agg(share.alias("accuracy"), F.count(F.lit(1)).alias("n"))


def label_counts(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Support, predictions and hits per label, over the union of true and predicted labels."""
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("true_label").alias("label"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")
        ),
        F.struct(
            F.col("pred_label").alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")
        ),
    )
    return (
        counts.select(*groups, F.inline(sides))
        .groupBy(*groups, "label")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    )


def label_scores(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 per label."""
    per_label = label_counts(counts, groups)
    return per_label.select(
        *groups,
        "label",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "predicted",
        "tp",
    )


def macro_scores(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One row per group: accuracy, macro, weighted and micro scores.

    With one label per row, micro precision, recall and F1 all equal accuracy;
    micro F1 is still computed from its own definition.
    """
    total = F.sum("support")
    micro_precision = _ratio(F.sum("tp"), F.sum("predicted"))
    micro_recall = _ratio(F.sum("tp"), total)

    def weighted(name: str) -> Column:
        return _ratio(F.sum(F.col(name) * F.col("support")), total)

    return (
        label_scores(counts, groups)
        .groupBy(*groups)
        .agg(
            F.coalesce(_ratio(F.sum("tp"), total), F.lit(0.0)).alias("accuracy"),
            F.coalesce(F.avg("precision"), F.lit(0.0)).alias("macro_precision"),
            F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall"),
            F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
            weighted("precision").alias("weighted_precision"),
            weighted("recall").alias("weighted_recall"),
            weighted("f1").alias("weighted_f1"),
            F.coalesce(
                _ratio(2 * micro_precision * micro_recall, micro_precision + micro_recall), F.lit(0.0)
            ).alias("micro_f1"),
            F.coalesce(total, F.lit(0)).alias("n"),
        )
    )


def class_report(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Long report: one row per label, then accuracy, macro and weighted averages."""
    labels = label_scores(counts, groups).select(
        *groups, F.lit("label").alias("kind"), "label", "precision", "recall", "f1", "support"
    )
    nothing = F.lit(None).cast("double")
    rows = F.array(
        F.struct(
            F.lit(SUMMARY_ROWS[0]).alias("label"),
            nothing.alias("precision"),
            nothing.alias("recall"),
            F.col("accuracy").alias("f1"),
        ),
        F.struct(
            F.lit(SUMMARY_ROWS[1]).alias("label"),
            F.col("macro_precision").alias("precision"),
            F.col("macro_recall").alias("recall"),
            F.col("macro_f1").alias("f1"),
        ),
        F.struct(
            F.lit(SUMMARY_ROWS[2]).alias("label"),
            F.col("weighted_precision").alias("precision"),
            F.col("weighted_recall").alias("recall"),
            F.col("weighted_f1").alias("f1"),
        ),
    )
    summary = (
        macro_scores(counts, groups)
        .select(*groups, F.lit("summary").alias("kind"), F.inline(rows), F.col("n").alias("support"))
    )
    return labels.unionByName(summary)


def leaderboard(
    df: DataFrame,
    groups: Sequence[str] = ("kind", "model", "strategy"),
    true: str = "true_label",
    pred: str = "pred_label",
    latency: str = "latency_s",
) -> DataFrame:
    """Macro F1, accuracy, mean latency and row count per group, best first.

    Latency is summed alongside the confusion counts, so the facts are shuffled once.
    """
    groups = list(groups)
    cells = df.groupBy(*groups, F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(latency).alias("_seconds"),
        F.count(latency).alias("_timed"),
    )
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col("true_label").alias("label"), F.col("n").alias("support"), zero.alias("predicted"),
            hit.alias("tp"), F.col("_seconds"), F.col("_timed"),
        ),
        F.struct(
            F.col("pred_label").alias("label"), zero.alias("support"), F.col("n").alias("predicted"),
            zero.alias("tp"), F.lit(0.0).alias("_seconds"), zero.alias("_timed"),
        ),
    )
    sums = ["support", "predicted", "tp", "_seconds", "_timed"]
    per_label = cells.select(*groups, F.inline(sides)).groupBy(*groups, "label").agg(
        *[F.sum(name).alias(name) for name in sums]
    )
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return (
        per_label.groupBy(*groups)
        .agg(
            F.avg(f1).alias("macro_f1"),
            _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
            F.when(F.sum("_timed") > 0, F.sum("_seconds") / F.sum("_timed")).alias("mean_latency_s"),
            F.sum("support").alias("n"),
        )
        .orderBy(F.col("macro_f1").desc(), *groups)
    )


def cv_mean_score(fold_scores: DataFrame, config: Sequence[str], score: str = "macro_f1") -> DataFrame:
    """Mean fold score per configuration; a failed fold (null) counts as 0."""
    return fold_scores.groupBy(*config).agg(
        F.avg(F.coalesce(F.col(score), F.lit(0.0))).alias("mean_score"), F.count(F.lit(1)).alias("n_folds")
    )
