"""Metrics against golden numbers and identities."""

import pytest
from pyspark.sql import functions as F

from tallywright.operators import aggregates, metrics
from tallywright.plans.derived import predictions


def scores(spark, pairs):
    counts = metrics.confusion(spark.createDataFrame(pairs, "true_label string, pred_label string"))
    return counts, metrics.macro_scores(counts).first()


def test_macro_f1_over_union_of_labels(spark):
    _, row = scores(spark, [("a", "a"), ("a", "c"), ("b", "b")])
    assert row["macro_f1"] == pytest.approx(0.555556, abs=1e-6)
    assert row["accuracy"] == pytest.approx(2 / 3)
    assert row["macro_precision"] == pytest.approx(2 / 3)
    assert row["macro_recall"] == pytest.approx(0.5)


def test_no_rows(spark):
    _, row = scores(spark, [])
    assert (row["accuracy"], row["macro_f1"], row["micro_f1"], row["n"]) == (0.0, 0.0, 0.0, 0)
    empty = spark.createDataFrame([], "hit int")
    assert metrics.accuracy(empty, "hit").first()["accuracy"] == 0.0


def test_label_never_predicted_scores_zero(spark):
    counts, _ = scores(spark, [("a", "b"), ("b", "b")])
    rows = {r["label"]: r for r in metrics.label_scores(counts).collect()}
    assert (rows["a"]["precision"], rows["a"]["recall"], rows["a"]["f1"]) == (0.0, 0.0, 0.0)


def test_report_identities(spark, sf_dir):
    groups = ["model", "strategy"]
    counts = metrics.confusion(predictions(spark, sf_dir), groups=groups)
    for row in metrics.macro_scores(counts, groups).collect():
        assert row["micro_f1"] == pytest.approx(row["accuracy"])
        assert row["weighted_recall"] == pytest.approx(row["accuracy"])
    report = metrics.class_report(counts, groups)
    assert report.where("kind = 'summary'").count() == 3 * 16


def test_failed_fold_counts_as_zero(spark):
    rows = spark.createDataFrame([("c", 0, 0.5), ("c", 1, None)], "config string, fold int, macro_f1 double")
    assert metrics.cv_mean_score(rows, ["config"]).first()["mean_score"] == 0.25


def test_review_statistics(spark):
    rows = [("Sim", "5", "não", "1"), ("s", "4", None, "0"), ("Não", "x", " Sim", ""), (None, "2", "", "Sim")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    row = aggregates.review_statistics(df, "a", "b", "c", "d").first()
    assert row["n"] == 4
    assert row["consistency_pct"] == 50.0
    assert row["mean_realism"] == pytest.approx(11 / 3)
    assert row["high_quality_pct"] == 50.0
    assert row["leakage_pct"] == 25.0
    assert row["complexity_pct"] == 50.0


def test_pivot_takes_first_and_divergence_ignores_null(spark):
    rows = [("t", "m1", "x", 2), ("t", "m1", "y", 1), ("t", "m2", None, 1), ("u", "m1", "x", 1), ("u", "m2", "z", 1)]
    df = spark.createDataFrame(rows, "text string, model string, pred string, at int")
    wide = {r["text"]: (r["m1"], r["m2"]) for r in aggregates.prediction_pivot(
        df, ["text"], "model", "pred", ["at"], ["m1", "m2"]).collect()}
    assert wide == {"t": ("y", None), "u": ("x", "z")}
    firsts = df.where("at = 1")
    assert [r["text"] for r in aggregates.divergent_rows(firsts, ["text"], "pred").collect()] == ["u"]


def test_snapshot(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "label string")
    row = aggregates.snapshot_stats(df, "label").first()
    assert (row["n_samples"], row["n_classes"], row["classes"]) == (4, 2, ["a", "b"])
