"""Queries: classification metrics, group statistics, pivots and disagreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import metrics
from ..operators.joins import disagreement_pairs
from ..functions.labels import hit_flag
from . import derived
from .derived import GENERATIONS, GRADED, GROUPS, PREDICTIONS, sql_scores
from .registry import query, rounded, table, whole

SCORED = f"WITH {PREDICTIONS}, {sql_scores('predictions', 'kind, model, strategy')}"


def _counts(spark, sf_dir):
    return metrics.confusion(derived.predictions(spark, sf_dir), groups=GROUPS)


def _pooled(spark, sf_dir):
    return metrics.confusion(derived.predictions(spark, sf_dir), groups=["model"])


@query(
    "confusion",
    f"""WITH {PREDICTIONS}
SELECT kind, model, strategy, true_label, pred_label, count(*) AS n FROM predictions GROUP BY ALL""",
)
def confusion(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(
    "accuracy",
    f"""WITH {PREDICTIONS}
SELECT model, strategy, round(avg(CAST(true_label = pred_label AS INT)), 6) AS accuracy, count(*) AS n
FROM predictions GROUP BY ALL""",
)
def accuracy(spark, sf_dir):
    rows = derived.predictions(spark, sf_dir).withColumn("hit", hit_flag("pred_label", "true_label"))
    return rounded(metrics.accuracy(rows, "hit", ["model", "strategy"]), "accuracy")


@query(
    "class_report",
    f"""{SCORED}, totals AS (SELECT kind, model, strategy, sum(tp) / CAST(sum(support) AS DOUBLE) AS acc, sum(support) AS n,
  avg(p) AS mp, avg(r) AS mr, avg(f1) AS mf, sum(p * support) / sum(support) AS wp,
  sum(r * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM scores GROUP BY ALL)
SELECT model, strategy, 'label' AS kind, label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM scores
UNION ALL SELECT model, strategy, 'summary', 'accuracy', NULL, NULL, round(acc, 6), CAST(n AS BIGINT) FROM totals
UNION ALL SELECT model, strategy, 'summary', 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(n AS BIGINT) FROM totals
UNION ALL SELECT model, strategy, 'summary', 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), CAST(n AS BIGINT) FROM totals""",
)
def class_report(spark, sf_dir):
    groups = ["model", "strategy"]
    counts = metrics.confusion(derived.predictions(spark, sf_dir), groups=groups)
    return rounded(metrics.class_report(counts, groups), "precision", "recall", "f1")


@query("macro_f1", f"{SCORED} SELECT model, strategy, round(avg(f1), 6) AS macro_f1 FROM scores GROUP BY ALL")
def macro_f1(spark, sf_dir):
    return rounded(metrics.macro_scores(_counts(spark, sf_dir), GROUPS).select("model", "strategy", "macro_f1"), "macro_f1")


@query(
    "macro_precision_recall",
    f"""{SCORED} SELECT model, strategy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall
FROM scores GROUP BY ALL""",
)
def macro_precision_recall(spark, sf_dir):
    scores = metrics.macro_scores(_counts(spark, sf_dir), GROUPS)
    return rounded(
        scores.select("model", "strategy", "macro_precision", "macro_recall"), "macro_precision", "macro_recall"
    )


@query(
    "micro_f1",
    f"""WITH {PREDICTIONS}, {sql_scores('predictions', 'model')},
sums AS (SELECT model, sum(tp) / CAST(sum(predicted) AS DOUBLE) AS p, sum(tp) / CAST(sum(support) AS DOUBLE) AS r
  FROM scores GROUP BY model)
SELECT model, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS micro_f1 FROM sums""",
)
def micro_f1(spark, sf_dir):
    scores = metrics.macro_scores(_pooled(spark, sf_dir), ["model"])
    return rounded(scores.select("model", "micro_f1"), "micro_f1")


@query(
    "leaderboard",
    f"""{SCORED}, quality AS (SELECT kind, model, strategy, avg(f1) AS macro_f1 FROM scores GROUP BY ALL),
speed AS (SELECT kind, model, strategy, avg(CAST(true_label = pred_label AS INT)) AS accuracy,
  avg(latency_s) AS mean_latency_s, count(*) AS n FROM predictions GROUP BY ALL)
SELECT kind, model, strategy, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy,
  round(mean_latency_s, 6) AS mean_latency_s, n
FROM quality JOIN speed USING (kind, model, strategy) ORDER BY macro_f1 DESC, kind, model, strategy""",
)
def leaderboard(spark, sf_dir):
    board = metrics.leaderboard(derived.predictions(spark, sf_dir), GROUPS)
    return rounded(board, "macro_f1", "accuracy", "mean_latency_s")


@query(
    "best_per_strategy",
    f"WITH {derived.RUNS} SELECT model, strategy, max(score) AS best_score FROM runs GROUP BY ALL",
)
def best_per_strategy(spark, sf_dir):
    return agg.best_per_strategy(derived.runs(spark, sf_dir), ["model", "strategy"], "score")


@query(
    "population_stats",
    f"""WITH {GENERATIONS}
SELECT gen, round(avg(value), 6) AS avg, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
  count(*) AS nevals FROM generations GROUP BY gen""",
)
def population_stats(spark, sf_dir):
    return rounded(agg.population_stats(derived.generations(spark, sf_dir), ["gen"], "value"), "avg", "std")


@query(
    "gene_diversity",
    """WITH genes AS (SELECT label, unnest(range(0, len(embedding))) AS position,
  CAST(unnest(embedding) AS DOUBLE) AS gene FROM embeddings),
spread AS (SELECT label, position, stddev_pop(gene) AS deviation FROM genes GROUP BY ALL)
SELECT label, round(avg(deviation), 6) AS diversity, count(*) AS n_genes FROM spread GROUP BY label""",
)
def gene_diversity(spark, sf_dir):
    return rounded(agg.gene_diversity(table(spark, sf_dir, "embeddings"), "embedding", ["label"]), "diversity")


REVIEW = """count(*) AS n,
  round(avg(CASE WHEN lower(trim(consistent)) LIKE 's%' OR trim(consistent) = '1' THEN 1 ELSE 0 END) * 100, 6) AS consistency_pct,
  round(avg(TRY_CAST(realism AS DOUBLE)), 6) AS mean_realism,
  round(count(*) FILTER (TRY_CAST(realism AS DOUBLE) >= 4) * CAST(100 AS DOUBLE) / count(*), 6) AS high_quality_pct,
  round(avg(CASE WHEN lower(trim(leakage)) LIKE 's%' OR trim(leakage) = '1' THEN 1 ELSE 0 END) * 100, 6) AS leakage_pct,
  round(avg(CASE WHEN lower(trim(complexity)) LIKE 's%' OR trim(complexity) = '1' THEN 1 ELSE 0 END) * 100, 6) AS complexity_pct"""
REVIEW_PERCENTS = ["consistency_pct", "mean_realism", "high_quality_pct", "leakage_pct", "complexity_pct"]


@query("review_statistics", f"WITH {GRADED} SELECT lang, {REVIEW} FROM graded GROUP BY lang")
def review_statistics(spark, sf_dir):
    stats = agg.review_statistics(
        derived.graded(spark, sf_dir), "consistent", "realism", "leakage", "complexity", ["lang"]
    )
    return rounded(stats, *REVIEW_PERCENTS)


@query(
    "snapshot_stats",
    """SELECT count(*) AS n_samples, count(DISTINCT lang) AS n_classes,
  array_to_string(list_sort(list(DISTINCT lang)), ',') AS classes FROM documents""",
)
def snapshot_stats(spark, sf_dir):
    stats = agg.snapshot_stats(table(spark, sf_dir, "documents"), "lang")
    return stats.withColumn("classes", F.array_join("classes", ","))


@query(
    "run_total_time",
    f"WITH {GENERATIONS} SELECT user_id, round(sum(value), 6) AS total_seconds FROM generations GROUP BY user_id",
)
def run_total_time(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return rounded(agg.run_total_time(events, ["user_id"], "value"), "total_seconds")


FOLD_SCORES = f"WITH {PREDICTIONS}, folded AS (SELECT *, item_id % 5 AS fold FROM predictions), " + sql_scores(
    "folded", "model, strategy, fold"
)


@query(
    "cv_mean_score",
    f"""{FOLD_SCORES}, fold_scores AS (SELECT model, strategy, fold, avg(f1) AS macro_f1 FROM scores GROUP BY ALL)
SELECT model, strategy, round(avg(macro_f1), 6) AS mean_score, count(*) AS n_folds FROM fold_scores GROUP BY ALL""",
)
def cv_mean_score(spark, sf_dir):
    groups = ["model", "strategy", "fold"]
    folded = derived.predictions(spark, sf_dir).withColumn("fold", F.col("item_id") % 5)
    per_fold = metrics.macro_scores(metrics.confusion(folded, groups=groups), groups)
    return rounded(metrics.cv_mean_score(per_fold, ["model", "strategy"]), "mean_score")


MODELS = ["m_const", "m_cycle", "m_gap", "m_value"]


@query(
    "prediction_pivot",
    f"""WITH {PREDICTIONS}
SELECT item_id, true_label, """
    + ", ".join(f"max(pred_label) FILTER (model = '{m}') AS {m}" for m in MODELS)
    + " FROM predictions GROUP BY item_id, true_label",
)
def prediction_pivot(spark, sf_dir):
    rows = derived.predictions(spark, sf_dir)
    return agg.prediction_pivot(rows, ["item_id", "true_label"], "model", "pred_label", ["strategy", "latency_s"], MODELS)


@query(
    "divergent_rows",
    f"""WITH {PREDICTIONS}
SELECT item_id, true_label, count(DISTINCT pred_label) > 1 AS divergent, count(pred_label) AS n_predictions
FROM predictions GROUP BY item_id, true_label HAVING count(DISTINCT pred_label) > 1""",
)
def divergent_rows(spark, sf_dir):
    rows = agg.divergent_rows(derived.predictions(spark, sf_dir), ["item_id", "true_label"], "pred_label")
    return rows.select("item_id", "true_label", F.lit(True).alias("divergent"), "n_predictions")


def text_predictions(documents):
    """Labels two LLM runs and two local runs give each document, as functions of its length and source."""
    runs = F.array(
        F.struct(
            F.lit("llm").alias("side"),
            F.lit("llm-a").alias("run"),
            F.when(F.col("n_chars") % 7 == 0, "en").otherwise(F.col("lang")).alias("pred"),
        ),
        F.struct(F.lit("llm").alias("side"), F.lit("llm-b").alias("run"), F.lit("fr").alias("pred")),
        F.struct(F.lit("local").alias("side"), F.lit("local-a").alias("run"), F.col("lang").alias("pred")),
        F.struct(
            F.lit("local").alias("side"),
            F.lit("local-b").alias("run"),
            F.when(F.col("source") < "src2", "de").otherwise(F.col("lang")).alias("pred"),
        ),
    )
    return documents.select("text", F.col("lang").alias("true_label"), F.inline(runs))


@query(
    "disagreement_pairs",
    """WITH p AS (SELECT d.text, d.lang AS true_label, r.side, r.run,
  CASE r.run WHEN 'llm-a' THEN CASE WHEN n_chars % 7 = 0 THEN 'en' ELSE lang END
             WHEN 'llm-b' THEN 'fr' WHEN 'local-a' THEN lang
             ELSE CASE WHEN source < 'src2' THEN 'de' ELSE lang END END AS pred
  FROM documents d CROSS JOIN (VALUES ('llm', 'llm-a'), ('llm', 'llm-b'), ('local', 'local-a'), ('local', 'local-b')) r(side, run))
SELECT a.text, a.true_label, a.pred AS llm_pred, b.pred AS local_pred, a.run AS llm_run, b.run AS local_run,
  count(*) AS n_pairs
FROM p a JOIN p b ON a.text = b.text
WHERE a.side = 'llm' AND b.side = 'local' AND a.pred <> b.pred GROUP BY ALL""",
)
def disagreement(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("text", "lang", "n_chars", "source")
    rows = text_predictions(documents)
    return disagreement_pairs(
        rows.where("side = 'llm'"), rows.where("side = 'local'"), "text", "true_label", "pred", "run"
    )
