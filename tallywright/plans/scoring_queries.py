"""Queries: batch scoring, attempt logs, streaming results and whole benchmark runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import LABELS, canonical_label, clean_answer, hit_flag, prompt_strategy
from ..functions.text import render_prompt
from ..operators import ledger, metrics, scoring
from ..operators.joins import cross_prompt_model
from ..session import scratch_path
from ..streaming import results
from . import derived
from .derived import ATTEMPTS, PREDICTIONS, sql_scores
from .prompts import MODELS, PROMPTS
from .registry import query, rounded, six, table, whole
from .text_queries import _CALLS


def length_scorer(model: str, prompt: str, attempt: int) -> str | None:
    """A stand-in for a hosted model: answers and failures follow from the prompt's length."""
    n = len(prompt)
    if n % 17 == 0:
        raise ValueError("Cliente não inicializado.")
    if model.startswith("llama") and n % 3 == 0 and attempt < 3:
        raise RuntimeError("429 too many requests")
    if n % 23 == 0:
        raise RuntimeError("timeout")
    if n % 29 == 0:
        return None
    return f"Analisando o texto...\nCategoria: {LABELS[n % 6]}\n"


_LABELS = "[" + ", ".join(f"'{label}'" for label in LABELS) + "]"
SCORED = f"""calls AS (SELECT doc_id, text, lang, prompt_id, model_id, length(replace(template, '{{demanda}}', text)) AS n
  FROM documents CROSS JOIN {_CALLS}),
scored AS (SELECT *, CASE WHEN n % 17 = 0 THEN 'Cliente não inicializado.' WHEN n % 23 = 0 THEN 'timeout' END AS erro,
  CASE WHEN n % 17 <> 0 AND n % 23 <> 0 AND n % 29 <> 0 THEN {_LABELS}[1 + n % 6] END AS answer,
  CASE WHEN n % 17 = 0 THEN 1 WHEN n % 23 = 0 THEN 5 WHEN starts_with(model_id, 'llama') AND n % 3 = 0 THEN 3
    ELSE 1 END AS try_count FROM calls)"""


def _scored(spark, sf_dir, columns):
    calls = cross_prompt_model(table(spark, sf_dir, "documents").select(*columns), PROMPTS, MODELS)
    calls = calls.withColumn("prompt", render_prompt("template", "text")).drop("template")
    return scoring.score_batch(calls, length_scorer, base_backoff=0.0)


@query(
    "score_batch",
    f"""WITH {SCORED} SELECT doc_id, prompt_id, model_id,
  'Analisando o texto...' || chr(10) || 'Categoria: ' || answer AS raw_text, erro, try_count FROM scored""",
)
def score_batch(spark, sf_dir):
    scored = _scored(spark, sf_dir, ["doc_id", "text"])
    return scored.select("doc_id", "prompt_id", "model_id", "raw_text", "erro", "try_count")


@query(
    "score_once",
    f"""WITH {SCORED} SELECT doc_id, prompt_id, model_id,
  'Analisando o texto...' || chr(10) || 'Categoria: ' || answer AS raw_text, erro, try_count FROM scored""",
)
def score_once(spark, sf_dir):
    """The same through a ledger of calls; a second run finds all of them there."""
    calls = cross_prompt_model(table(spark, sf_dir, "documents").select("doc_id", "text"), PROMPTS, MODELS)
    calls = calls.withColumn("prompt", render_prompt("template", "text")).drop("template")
    path = scratch_path(spark, "ledger")
    ledger.score_once(calls, length_scorer, path, base_backoff=0.0)
    scored = ledger.score_once(calls, length_scorer, path, base_backoff=0.0)
    return scored.select("doc_id", "prompt_id", "model_id", "raw_text", "erro", "try_count")


@query(
    "benchmark_leaderboard",
    f"""WITH {SCORED}, judged AS (SELECT model_id AS model, prompt_id,
  {_LABELS}[1 + doc_id % 6] AS true_label, coalesce(answer, 'ERRO_API') AS pred_label FROM scored),
{sql_scores('judged', 'model, prompt_id')},
quality AS (SELECT model, prompt_id, avg(f1) AS macro_f1, sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy,
  CAST(sum(support) AS BIGINT) AS n FROM scores GROUP BY ALL)
SELECT 'LLM' AS kind, model, CASE prompt_id WHEN 'zero_shot_direto' THEN 'Zero-Shot' WHEN 'zero_shot_cot' THEN 'Zero-Shot-CoT'
    WHEN 'few_shot_completo' THEN 'Few-Shot' ELSE 'Meta-Prompt' END AS strategy,
  round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy, n FROM quality""",
)
def benchmark_leaderboard(spark, sf_dir):
    """Rows x prompts x models, scored, cleaned, judged and ranked in one plan."""
    scored = _scored(spark, sf_dir, ["doc_id", "text"])
    labels = F.array(*[F.lit(label) for label in LABELS])
    judged = scored.select(
        F.lit("LLM").alias("kind"),
        F.col("model_id").alias("model"),
        prompt_strategy("prompt_id").alias("strategy"),
        F.get(labels, (F.col("doc_id") % 6).cast("int")).alias("true_label"),
        clean_answer("raw_text").alias("pred_label"),
        F.col("tempo_s").alias("latency_s"),
    )
    board = metrics.leaderboard(judged).drop("mean_latency_s")
    return rounded(board, "macro_f1", "accuracy")


@query(
    "collapse_attempts",
    f"""WITH {ATTEMPTS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
  CASE WHEN contains(error, 'inicializado') THEN 'stop' WHEN error IS NULL THEN 'stop'
    WHEN contains(lower(error), 'rate') OR contains(error, '429') THEN 'rate_limit' ELSE 'other' END AS kind FROM attempts),
stops AS (SELECT user_id, min(attempt) AS stop FROM k WHERE kind = 'stop' GROUP BY user_id),
used AS (SELECT k.*, least(coalesce(stop, 5), 5) AS last FROM k LEFT JOIN stops USING (user_id)
  WHERE attempt <= least(coalesce(stop, 5), 5)),
tries AS (SELECT *, max(attempt) OVER (PARTITION BY user_id) AS final FROM used)
SELECT user_id, CAST(max(CASE WHEN attempt = final AND error IS NULL THEN 1 ELSE 0 END) AS INT) AS succeeded,
  CAST(max(final) AS INT) AS try_count, max(CASE WHEN attempt = final THEN error END) AS erro,
  round(sum(value), 6) AS busy_s,
  CAST(sum(CASE WHEN attempt < final THEN CASE kind WHEN 'rate_limit' THEN pow(2, attempt - 1) ELSE attempt END ELSE 0 END) AS DOUBLE) AS wait_s
FROM tries GROUP BY user_id""",
)
def collapse_attempts(spark, sf_dir):
    log = derived.attempts(spark, sf_dir)
    outcome = scoring.collapse_attempts(log, "user_id", ["ts", "event_id"], "error", "value")
    return rounded(outcome.drop("tempo_s"), "busy_s")


@query(
    "incremental_results",
    "SELECT event_id, user_id, event_type, value FROM events",
)
def incremental_results(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = results.read_incoming(spark, sf_dir, schema, "events.parquet")
    sink, checkpoint = scratch_path(spark, "incremental"), scratch_path(spark, "incremental-checkpoint")
    results.append_incoming(stream.select("event_id", "user_id", "event_type", "value"), sink, checkpoint)
    return spark.read.parquet(sink)


@query(
    "running_leaderboard",
    f"""WITH {PREDICTIONS}, {sql_scores('predictions', 'model, strategy')},
quality AS (SELECT model, strategy, avg(f1) AS macro_f1, sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy FROM scores GROUP BY ALL),
speed AS (SELECT model, strategy, avg(latency_s) AS mean_latency_s, count(*) AS n FROM predictions GROUP BY ALL)
SELECT model, strategy, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy,
  round(mean_latency_s, 6) AS mean_latency_s, n FROM quality JOIN speed USING (model, strategy)""",
)
def running_leaderboard(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    arriving = derived.predict_events(results.read_incoming(spark, sf_dir, schema, "events.parquet"))
    state, checkpoint = scratch_path(spark, "leaderboard"), scratch_path(spark, "leaderboard-checkpoint")
    groups = ["model", "strategy"]
    results.count_incoming(arriving, groups, "true_label", "pred_label", "latency_s", state, checkpoint)
    board = results.running_leaderboard(spark, state, groups)
    return rounded(board, "macro_f1", "accuracy", "mean_latency_s")
