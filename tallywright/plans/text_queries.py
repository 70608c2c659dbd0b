"""Queries: scalar functions, filters, lookups, n-grams and TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attempts as att
from ..functions import labels as lab
from ..functions import params as par
from ..functions import text as tx
from ..operators import features, filters
from ..operators.encoding import label_codes, label_index, label_name
from ..operators.joins import cross_prompt_model, dimension_lookup
from ..operators.sampling import row_ids
from . import derived
from .derived import GRADED, RAW_ANSWERS, RUNS, sql_clean_answer, sql_strip
from .prompts import MODELS, PROMPTS
from .registry import query, rounded, six, sql_text, table, whole


def sql_preprocess(value: str) -> str:
    no_links = f"regexp_replace(coalesce({value}, ''), '{tx.URL}', '', 'g')"
    no_digits = f"regexp_replace({no_links}, '{tx.DIGITS}', '', 'g')"
    return f"regexp_replace(lower({sql_strip(no_digits)}), '{tx.PUNCTUATION}', '', 'g')"


def sql_flatten(value: str) -> str:
    return sql_strip(f"regexp_replace(translate({value}, chr(10) || chr(13) || '|', '  /'), ' +', ' ', 'g')")


@query("preprocess_text", f"SELECT doc_id, {sql_preprocess('text')} AS text_processed FROM documents")
def preprocess_text(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", tx.preprocess_text("text").alias("text_processed"))


STOP_WORDS = ["the", "and", "que", "des", "les", "der", "die", "und", "los", "las", "con", "une", "avec", "ein"]
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


@query(
    "token_filter",
    f"""SELECT doc_id, array_to_string([w for w in string_split_regex({sql_preprocess('text')}, '[{tx.SPACE}]+')
  if regexp_matches(w, '{tx.LETTERS_ONLY}') AND length(w) > 2 AND NOT list_contains({_STOP_SQL}, w)], ' ') AS tokens
FROM documents""",
)
def token_filter(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", tx.token_filter(tx.preprocess_text("text"), STOP_WORDS).alias("tokens"))


@query("flatten_text", f"SELECT conv_id, turn, {sql_flatten('text')} AS flat FROM conversations")
def flatten_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.flatten_text("text").alias("flat"))


@query("clean_answer", f"WITH {RAW_ANSWERS} SELECT conv_id, turn, {sql_clean_answer('raw')} AS answer FROM raw_answers")
def clean_answer(spark, sf_dir):
    return derived.raw_answers(spark, sf_dir).select("conv_id", "turn", lab.clean_answer("raw").alias("answer"))


_CALLS = "(VALUES " + ", ".join(
    f"('{p['id']}', {sql_text(p['template'])}, '{m}')" for p in PROMPTS for m in MODELS
) + ") c(prompt_id, template, model_id)"


@query("cross_prompt_model", f"SELECT doc_id, prompt_id, model_id FROM documents CROSS JOIN {_CALLS}")
def cross(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return cross_prompt_model(documents, PROMPTS, MODELS).select("doc_id", "prompt_id", "model_id")


@query(
    "render_prompts",
    f"""SELECT doc_id, prompt_id, model_id, md5(replace(template, '{{demanda}}', text)) AS prompt_md5,
  length(replace(template, '{{demanda}}', text)) AS n_chars FROM documents CROSS JOIN {_CALLS}""",
)
def render_prompts(spark, sf_dir):
    calls = cross_prompt_model(table(spark, sf_dir, "documents").select("doc_id", "text"), PROMPTS, MODELS)
    prompts = calls.withColumn("prompt", tx.render_prompt("template", "text"))
    return prompts.select(
        "doc_id",
        "prompt_id",
        "model_id",
        F.md5("prompt").alias("prompt_md5"),
        F.length("prompt").cast("long").alias("n_chars"),
    )


@query(
    "row_ids",
    """SELECT doc_id, CASE WHEN length(CAST(n AS VARCHAR)) < 4 THEN lpad(CAST(n AS VARCHAR), 4, '0')
  ELSE CAST(n AS VARCHAR) END AS row_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS n FROM documents)""",
)
def numbered(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return row_ids(documents, ["source", "doc_id"]).select("doc_id", "row_id")


@query(
    "hit_flag",
    f"""WITH {RAW_ANSWERS} SELECT conv_id, turn,
  CAST(lower({sql_clean_answer('raw')}) = lower(label) AS INT) AS hit FROM raw_answers""",
)
def hits(spark, sf_dir):
    answers = derived.raw_answers(spark, sf_dir)
    return answers.select("conv_id", "turn", lab.hit_flag(lab.clean_answer("raw"), "label").alias("hit"))


@query(
    "yes_no_flag",
    f"""WITH {GRADED} SELECT doc_id,
  coalesce(CAST(starts_with(lower(trim(consistent)), 's') OR trim(consistent) = '1' AS INT), 0) AS consistent,
  coalesce(CAST(starts_with(lower(trim(leakage)), 's') OR trim(leakage) = '1' AS INT), 0) AS leakage,
  coalesce(CAST(starts_with(lower(trim(complexity)), 's') OR trim(complexity) = '1' AS INT), 0) AS complexity
FROM graded""",
)
def yes_no(spark, sf_dir):
    names = ["consistent", "leakage", "complexity"]
    return derived.graded(spark, sf_dir).select("doc_id", *[lab.yes_no_flag(n).alias(n) for n in names])


_EVENT_MODEL = {
    "signup": "LinearSVC",
    "error": "MultinomialNB",
    "click": "LogisticRegression",
    "view": "gemini-2.5-flash-lite",
    "purchase": "other-model",
}
_EVENT_MODEL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENT_MODEL.items()) + " END"


@query(
    "canonical_model",
    f"""SELECT event_id, CASE {_EVENT_MODEL_SQL} WHEN 'LinearSVC' THEN 'SVM' WHEN 'MultinomialNB' THEN 'NaiveBayes'
    ELSE {_EVENT_MODEL_SQL} END AS model_type,
  CASE {_EVENT_MODEL_SQL} WHEN 'LinearSVC' THEN 'SVM' WHEN 'MultinomialNB' THEN 'Naive Bayes'
    WHEN 'LogisticRegression' THEN 'Log. Reg.' WHEN 'gemini-2.5-flash-lite' THEN 'Gemini 2.5-Flash-Lite'
    ELSE {_EVENT_MODEL_SQL} END AS display_name FROM events""",
)
def canonical_model(spark, sf_dir):
    model = lab.lookup("event_type", _EVENT_MODEL)
    kind = lab.model_type(model)
    events = table(spark, sf_dir, "events")
    return events.select("event_id", kind.alias("model_type"), lab.model_display_name(kind).alias("display_name"))


_EVENT_PROMPT = {
    "signup": "zero_shot_direto",
    "error": "zero_shot_cot",
    "click": "few_shot_completo",
    "view": "meta_prompt_classificacao",
    "purchase": "Otimizado (AutoML)",
}
_EVENT_PROMPT_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENT_PROMPT.items()) + " END"


@query(
    "canonical_strategy",
    f"""WITH s AS (SELECT event_id, {_EVENT_PROMPT_SQL} AS s FROM events)
SELECT event_id, CASE WHEN lower(s) LIKE '%cot%' THEN 'Zero-Shot-CoT' WHEN lower(s) LIKE '%meta%' THEN 'Meta-Prompt'
    WHEN lower(s) LIKE '%few%' THEN 'Few-Shot' WHEN lower(s) LIKE '%zero%' THEN 'Zero-Shot' ELSE 'Evolucionária' END AS strategy,
  CASE s WHEN 'zero_shot_direto' THEN 'Zero-Shot' WHEN 'zero_shot_cot' THEN 'Zero-Shot-CoT' WHEN 'few_shot_completo' THEN 'Few-Shot'
    WHEN 'meta_prompt_classificacao' THEN 'Meta-Prompt' ELSE 'Evolucionário' END AS prompt_strategy FROM s""",
)
def canonical_strategy(spark, sf_dir):
    prompt = lab.lookup("event_type", _EVENT_PROMPT)
    return table(spark, sf_dir, "events").select(
        "event_id",
        lab.canonical_strategy(prompt).alias("strategy"),
        lab.prompt_strategy(prompt).alias("prompt_strategy"),
    )


_LAI = "Pedido de Acesso à Informação (LAI)"


@query(
    "canonical_label",
    f"""WITH {RAW_ANSWERS}, named AS (SELECT conv_id, turn, CASE label WHEN 'Pedido de LAI' THEN '{_LAI}' ELSE label END AS label
  FROM raw_answers)
SELECT conv_id, turn, label, CASE label WHEN '{_LAI}' THEN 'Pedido de LAI' ELSE label END AS canonical FROM named""",
)
def canonical_label(spark, sf_dir):
    label = F.when(F.col("label") == "Pedido de LAI", _LAI).otherwise(F.col("label"))
    rows = derived.raw_answers(spark, sf_dir).select("conv_id", "turn", label.alias("label"))
    return rows.withColumn("canonical", lab.canonical_label("label"))


@query("label_index", "SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS label_code FROM documents")
def indexed(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return whole(label_index(documents, "lang").select("doc_id", "lang", "label_code"), "label_code")


@query("label_name", "SELECT event_id, event_type AS label FROM events")
def named(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    codes = label_codes(events, "event_type").withColumnRenamed("event_type", "label")
    coded = label_index(events, "event_type").select("event_id", F.col("label_code").alias("code"))
    return label_name(coded, codes, "code", "label").select("event_id", "label")


@query(
    "label_underscore",
    """SELECT p_partkey, '__label__' || replace(p_name, ' ', '_') AS tagged, p_name AS label FROM part""",
)
def label_underscore(spark, sf_dir):
    tagged = F.concat(F.lit("__label__"), tx.underscore_label("p_name"))
    part = table(spark, sf_dir, "part").select("p_partkey", tagged.alias("tagged"))
    return part.withColumn("label", tx.spaced_label("tagged"))


def _params_text(column):
    return F.array_join(
        F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"]))), ","
    )


def _sql_entries(keep: str, extra: str = "[]") -> str:
    return (
        "array_to_string(list_sort([split_part(e.key, '__', -1) || '=' || e.value for e in entries if list_contains("
        f"{keep}, split_part(e.key, '__', -1))] || {extra}), ',')"
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    "split_params",
    f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'LogisticRegression' WHEN p_size % 3 = 1 THEN 'NaiveBayes' ELSE 'SVM' END AS model,
  [{{'key': 'clf__C', 'value': CAST(p_size AS VARCHAR)}}, {{'key': 'clf__alpha', 'value': p_brand}},
   {{'key': 'clf__kernel', 'value': 'linear'}}, {{'key': 'min_df', 'value': p_type}}]
  || CASE WHEN p_size > 25 THEN [{{'key': 'tfidf__ngram_range', 'value': '[1,2]'}}] ELSE [] END AS entries FROM part)
SELECT p_partkey, model,
  {_sql_entries(_sql_list(par.FEATURE_KEYS), "CASE WHEN len(entries) = 4 THEN ['ngram_range=[1,1]'] ELSE [] END")} AS feature_params,
  CASE model WHEN 'LogisticRegression' THEN {_sql_entries(_sql_list(par.CLASSIFIER_KEYS['LogisticRegression']))}
    WHEN 'NaiveBayes' THEN {_sql_entries(_sql_list(par.CLASSIFIER_KEYS['NaiveBayes']))}
    ELSE {_sql_entries(_sql_list(par.CLASSIFIER_KEYS['SVM']))} END AS classifier_params
FROM p""",
)
def split_params(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fixed = F.create_map(
        F.lit("clf__C"), F.col("p_size").cast("string"), F.lit("clf__alpha"), F.col("p_brand"),
        F.lit("clf__kernel"), F.lit("linear"), F.lit("min_df"), F.col("p_type"),
    )
    ranged = F.map_concat(fixed, F.create_map(F.lit("tfidf__ngram_range"), F.lit("[1,2]")))
    model = (
        F.when(F.col("p_size") % 3 == 0, "LogisticRegression")
        .when(F.col("p_size") % 3 == 1, "NaiveBayes")
        .otherwise("SVM")
    )
    rows = part.select(
        "p_partkey", model.alias("model"), F.when(F.col("p_size") > 25, ranged).otherwise(fixed).alias("params")
    )
    return rows.select(
        "p_partkey",
        "model",
        _params_text(par.feature_params("params")).alias("feature_params"),
        _params_text(par.classifier_params("params", "model")).alias("classifier_params"),
    )


_MODEL_NAMES = ["gemini-2.5-flash-lite", "gpt-5-nano", "llama-3.1-8b-instant", "mixtral-8x7b", "deepseek-chat", "my-gpt"]


@query(
    "provider_route",
    f"""WITH m AS (SELECT event_id, {_sql_list(_MODEL_NAMES)}[1 + event_id % 6] AS model FROM events)
SELECT event_id, model, CASE WHEN starts_with(model, 'gemini') THEN 'gemini' WHEN starts_with(model, 'gpt') THEN 'openai'
  WHEN starts_with(model, 'llama') OR starts_with(model, 'mixtral') THEN 'groq'
  WHEN starts_with(model, 'deepseek') THEN 'deepseek' ELSE 'unknown' END AS provider FROM m""",
)
def provider_route(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in _MODEL_NAMES])
    model = F.get(names, (F.col("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", model.alias("model"), att.provider_route(model).alias("provider")
    )


_KIND_SQL = """CASE WHEN contains(error, 'inicializado') THEN 'not_initialised'
    WHEN contains(lower(error), 'rate') OR contains(error, '429') OR contains(lower(error), 'quota')
      OR contains(lower(error), 'too many') THEN 'rate_limit'
    WHEN error IS NOT NULL THEN 'other' END"""


@query(
    "classify_error",
    f"""WITH {derived.ATTEMPTS}
SELECT event_id, {_KIND_SQL} AS kind,
  CASE WHEN contains(error, 'inicializado') THEN 'not_initialised'
    WHEN regexp_matches(lower(error), '\\b(rate|quota|429|too many)\\b') THEN 'rate_limit'
    WHEN error IS NOT NULL THEN 'other' END AS strict_kind FROM attempts""",
)
def classify_error(spark, sf_dir):
    return derived.attempts(spark, sf_dir).select(
        "event_id",
        att.classify_error("error").alias("kind"),
        att.classify_error("error", whole_words=True).alias("strict_kind"),
    )


@query(
    "planned_backoff",
    f"""WITH {derived.ATTEMPTS}, k AS (SELECT event_id, {_KIND_SQL} AS kind, 1 + event_id % 5 AS attempt FROM attempts)
SELECT event_id, kind, attempt, CASE WHEN attempt < 5 THEN CASE kind WHEN 'rate_limit' THEN 0.5 * pow(2, attempt - 1)
  WHEN 'other' THEN CAST(0.5 AS DOUBLE) * attempt END END AS wait_s FROM k""",
)
def planned_backoff(spark, sf_dir):
    rows = derived.attempts(spark, sf_dir).select(
        "event_id", att.classify_error("error").alias("kind"), (F.col("event_id") % 5 + 1).alias("attempt")
    )
    return rows.withColumn("wait_s", att.planned_backoff("kind", "attempt", 0.5))


@query(
    "drop_null_pairs",
    """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.text IS NOT NULL AND l.quality IS NOT NULL""",
)
def drop_null_pairs(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = documents.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return filters.drop_null_pairs(joined, "text", "quality").select("doc_id", "quality")


_NOTE = "CASE event_type WHEN 'error' THEN CAST(event_id AS VARCHAR) WHEN 'view' THEN 'http://x.y/' || event_id ELSE event_type || ' #' || event_id || '!' END"


@query(
    "drop_empty_processed",
    f"""SELECT event_id, {sql_preprocess(_NOTE)} AS text_processed FROM events WHERE length({sql_preprocess(_NOTE)}) > 0""",
)
def drop_empty(spark, sf_dir):
    number = F.col("event_id").cast("string")
    note = (
        F.when(F.col("event_type") == "error", number)
        .when(F.col("event_type") == "view", F.concat(F.lit("http://x.y/"), number))
        .otherwise(F.concat("event_type", F.lit(" #"), number, F.lit("!")))
    )
    rows = table(spark, sf_dir, "events").select("event_id", note.alias("note"))
    return filters.drop_empty_processed(rows, "note").select("event_id", "text_processed")


@query("valid_scores", f"WITH {RUNS} SELECT run_id, score FROM runs WHERE score IS NOT NULL AND score <> -1")
def valid_scores(spark, sf_dir):
    return filters.valid_scores(derived.runs(spark, sf_dir).select("run_id", "score"), "score")


@query("timed_runs", "SELECT event_id, value FROM events WHERE value > 0.01")
def timed_runs(spark, sf_dir):
    return filters.timed_runs(table(spark, sf_dir, "events").select("event_id", "value"), "value")


@query(
    "high_quality_share",
    f"""WITH {GRADED} SELECT round(count(*) FILTER (TRY_CAST(realism AS DOUBLE) >= 4) * CAST(100 AS DOUBLE) / count(*), 6)
  AS high_quality_pct, count(*) AS n FROM graded""",
)
def high_quality_share(spark, sf_dir):
    rating = F.col("realism").try_cast("double")
    return derived.graded(spark, sf_dir).agg(
        six(filters.high_quality_share(rating), "high_quality_pct"), F.count(F.lit(1)).alias("n")
    )


@query(
    "dimension_lookup",
    """SELECT c.c_custkey, coalesce(n.n_name, 'unknown') AS nation FROM customer c
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) n ON c.c_nationkey = n.n_nationkey""",
)
def dimension(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 4").select("n_nationkey", F.col("n_name").alias("nation"))
    return dimension_lookup(customers, "n_nationkey", nations, "nation", "unknown").select("c_custkey", "nation")


_WORDS = f"regexp_extract_all(lower(text), '{tx.TOKEN}')"
_PAIRS = "[w[i] || ' ' || w[i + 1] for i in range(1, len(w))]"


@query(
    "ngram_tokens",
    f"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w || {_PAIRS}) AS BIGINT) AS n_terms,
  md5(array_to_string(w || {_PAIRS}, '|')) AS terms_md5 FROM t""",
)
def ngram_tokens(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms = documents.select("doc_id", tx.ngram_tokens("text", 1).alias("w"), tx.ngram_tokens("text", 2).alias("t"))
    return terms.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size("t").cast("long").alias("n_terms"),
        F.md5(F.array_join("t", "|")).alias("terms_md5"),
    )


@query(
    "term_document_frequency",
    f"""WITH t AS (SELECT doc_id, unnest([w for w in {_WORDS} if NOT list_contains({_STOP_SQL}, w)]) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM counts GROUP BY term
HAVING count(*) >= 2 AND count(*) <= CAST(0.5 AS DOUBLE) * (SELECT n FROM n)""",
)
def term_document_frequency(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = documents.count()
    counts = features.term_counts(documents, "doc_id", "text", stop_words=STOP_WORDS)
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    return stats.where((F.col("df") >= 2) & (F.col("df") <= 0.5 * n_docs))


@query(
    "tfidf_l2",
    f"""WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
w AS (SELECT doc_id, term, tf, df, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS r
  FROM counts JOIN dfs USING (term))
SELECT doc_id, term, tf, df, round(r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
)
def tfidf(spark, sf_dir):
    return rounded(features.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text"), "weight")
