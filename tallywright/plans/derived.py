"""Inputs of the operators, derived from the tables: as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import LABELS
from ..functions.text import EDGE_SPACE, PUNCTUATION, SPACE
from ..operators.ranking import number_rows
from ..operators.sampling import stratified_folds
from .registry import table

GROUPS = ["kind", "model", "strategy"]


def predict_events(events: DataFrame) -> DataFrame:
    """Four models' predictions of every event's type, in long form."""
    actual = F.col("event_type")
    outcomes = F.array(
        F.struct(
            F.lit("LLM").alias("kind"),
            F.lit("m_cycle").alias("model"),
            F.when(F.col("event_id") % 5 == 0, "view").otherwise(actual).alias("pred_label"),
        ),
        F.struct(
            F.lit("ML").alias("kind"),
            F.lit("m_value").alias("model"),
            F.when(F.col("value") < 10, actual).otherwise(F.lit("click")).alias("pred_label"),
        ),
        F.struct(F.lit("ML").alias("kind"), F.lit("m_const").alias("model"), F.lit("purchase").alias("pred_label")),
        F.struct(
            F.lit("LLM").alias("kind"),
            F.lit("m_gap").alias("model"),
            F.when(F.col("event_id") % 11 == 0, "ERRO_API").otherwise(actual).alias("pred_label"),
        ),
    )
    return events.select(
        F.col("event_id").alias("item_id"),
        actual.alias("true_label"),
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("strategy"),
        (F.col("value") / 1000).alias("latency_s"),
        F.inline(outcomes),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_events(table(spark, sf_dir, "events"))


PREDICTIONS = """predictions AS (
  SELECT e.event_id AS item_id, e.event_type AS true_label, 's' || CAST(e.user_id % 4 AS VARCHAR) AS strategy,
         e.value / 1000 AS latency_s, m.kind, m.model,
         CASE m.model
           WHEN 'm_cycle' THEN CASE WHEN e.event_id % 5 = 0 THEN 'view' ELSE e.event_type END
           WHEN 'm_value' THEN CASE WHEN e.value < 10 THEN e.event_type ELSE 'click' END
           WHEN 'm_const' THEN 'purchase'
           ELSE CASE WHEN e.event_id % 11 = 0 THEN 'ERRO_API' ELSE e.event_type END
         END AS pred_label
  FROM events e
  CROSS JOIN (VALUES ('LLM', 'm_cycle'), ('ML', 'm_value'), ('ML', 'm_const'), ('LLM', 'm_gap')) m(kind, model)
)"""


def sql_scores(source: str, groups: str, true: str = "true_label", pred: str = "pred_label") -> str:
    """CTE ``scores``: per (groups, label) support, predicted, tp, precision, recall and f1."""
    return f"""truths AS (SELECT {groups}, {true} AS label, count(*) AS support,
    sum(CASE WHEN {true} = {pred} THEN 1 ELSE 0 END) AS tp FROM {source} GROUP BY ALL),
guesses AS (SELECT {groups}, {pred} AS label, count(*) AS predicted FROM {source} GROUP BY ALL),
both_sides AS (SELECT {groups}, label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted,
    coalesce(tp, 0) AS tp FROM truths FULL JOIN guesses USING ({groups}, label)),
scores AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS p,
    CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS r,
    CASE WHEN support + predicted > 0 THEN 2 * CAST(tp AS DOUBLE) / (support + predicted) ELSE 0 END AS f1
    FROM both_sides)"""


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as generation logs: one log per user, numbered in time order."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return number_rows(events, ["user_id"], ["ts", "event_id"], "gen")


GENERATIONS = """generations AS (
  SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gen
  FROM events
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as search runs: brand is the model, price the time, size the score."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("run_id"),
        F.col("p_brand").alias("model"),
        F.col("p_type").alias("strategy"),
        F.col("p_retailprice").alias("runtime_s"),
        F.when(F.col("p_size") % 10 == 0, -1).otherwise(F.col("p_size")).cast("double").alias("score"),
    )


RUNS = """runs AS (
  SELECT p_partkey AS run_id, p_brand AS model, p_type AS strategy, p_retailprice AS runtime_s,
         CAST(CASE WHEN p_size % 10 = 0 THEN -1 ELSE p_size END AS DOUBLE) AS score
  FROM part
)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a human review sheet; unlabelled ones have blank answers."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    labels = table(spark, sf_dir, "labels")
    joined = documents.join(labels, "doc_id", "left")
    rating = F.when(F.col("n_chars") % 6 == 5, "n/d").otherwise((1 + F.col("n_chars") % 5).cast("string"))
    return joined.select(
        "doc_id",
        "lang",
        "text",
        F.when(F.col("quality") == 1, "Sim").when(F.col("quality") == 0, "Não").alias("consistent"),
        rating.alias("realism"),
        F.when(F.col("toxic") == 1, " s ").when(F.col("toxic") == 0, "não").alias("leakage"),
        F.when(F.col("quality").isNotNull(), F.col("quality").cast("string")).alias("complexity"),
    )


GRADED = """graded AS (
  SELECT d.doc_id, d.lang, d.text,
         CASE l.quality WHEN 1 THEN 'Sim' WHEN 0 THEN 'Não' END AS consistent,
         CASE WHEN d.n_chars % 6 = 5 THEN 'n/d' ELSE CAST(1 + d.n_chars % 5 AS VARCHAR) END AS realism,
         CASE l.toxic WHEN 1 THEN ' s ' WHEN 0 THEN 'não' END AS leakage,
         CAST(l.quality AS VARCHAR) AS complexity
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts as free-form answers, some of which name a label on the last line."""
    labels = F.array(*[F.lit(label) for label in LABELS])
    label = F.get(labels, ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    raw = (
        F.when(F.col("role") == "system", F.lit(None).cast("string"))
        .when(F.col("turn") % 4 == 0, F.concat("text", F.lit("\nCategoria: "), label, F.lit("\n  ")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("**"), F.lower(label), F.lit("**. ")))
        .when(F.col("turn") % 4 == 2, F.concat("text", F.lit("\nseria "), label, F.lit(" ou elogio?")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"), label.alias("label"))


_LABEL_LIST = "[" + ", ".join(f"'{label}'" for label in LABELS) + "]"
RAW_ANSWERS = f"""raw_answers AS (
  SELECT conv_id, turn, {_LABEL_LIST}[1 + (conv_id + turn) % 6] AS label,
         CASE WHEN role = 'system' THEN NULL
              WHEN turn % 4 = 0 THEN text || chr(10) || 'Categoria: ' || {_LABEL_LIST}[1 + (conv_id + turn) % 6] || chr(10) || '  '
              WHEN turn % 4 = 1 THEN '**' || lower({_LABEL_LIST}[1 + (conv_id + turn) % 6]) || '**. '
              WHEN turn % 4 = 2 THEN text || chr(10) || 'seria ' || {_LABEL_LIST}[1 + (conv_id + turn) % 6] || ' ou elogio?'
              ELSE text END AS raw
  FROM conversations
)"""


def sql_strip(value: str) -> str:
    return f"regexp_replace({value}, '{EDGE_SPACE}', '', 'g')"


def sql_clean_answer(value: str) -> str:
    """The cleaned label of a raw answer, as one SQL expression."""
    last = f"coalesce([y for y in [{sql_strip('x')} for x in string_split({value}, chr(10))] if y <> ''][-1], '')"
    answer = f"regexp_replace({last}, '(?i)^categoria[:{SPACE}]*', '')"
    answer = sql_strip(f"lower(regexp_replace({answer}, '{PUNCTUATION}', '', 'g'))")
    exact = " ".join(f"WHEN {answer} = '{label.lower()}' THEN '{label}'" for label in LABELS)
    inside = " ".join(f"WHEN contains({answer}, '{label.lower()}') THEN '{label}'" for label in LABELS)
    return f"CASE WHEN {value} IS NULL THEN 'ERRO_API' {exact} {inside} ELSE 'NAO_MAPEADO' END"


ERROR_MESSAGES = [
    "Error 429: Too Many Requests",
    "timeout while waiting",
    "Cliente Gemini não inicializado.",
    "could not generate text",
]


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of attempts per user; a purchase is a success."""
    messages = F.array(*[F.lit(m) for m in ERROR_MESSAGES])
    error = F.when(F.col("event_type") != "purchase", F.get(messages, (F.col("event_id") % 4).cast("int")))
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", error.alias("error"))


_MESSAGE_LIST = "[" + ", ".join(f"'{m}'" for m in ERROR_MESSAGES) + "]"
ATTEMPTS = f"""attempts AS (
  SELECT user_id, ts, event_id, value,
         CASE WHEN event_type <> 'purchase' THEN {_MESSAGE_LIST}[1 + event_id % 4] END AS error
  FROM events
)"""


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with stratified fold numbers."""
    return stratified_folds(split_documents(spark, sf_dir), "doc_id", "lang", 5)


def sql_hash(id_col: str, seed: str) -> str:
    return f"md5(CAST({id_col} AS VARCHAR) || '{seed}')"


FOLDS = f"""folds AS (
  SELECT doc_id, text, lang,
         CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY {sql_hash('doc_id', 'folds-42')}) - 1) * 5.0
              / count(*) OVER (PARTITION BY lang)) AS BIGINT) AS fold
  FROM documents
)"""

SPLIT = f"""split AS (
  SELECT doc_id, text, lang,
         CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {sql_hash('doc_id', 'split-42')})
                   <= round(CAST(0.8 AS DOUBLE) * count(*) OVER (PARTITION BY lang))
              THEN 'train' ELSE 'holdout' END AS part
  FROM documents
)"""
