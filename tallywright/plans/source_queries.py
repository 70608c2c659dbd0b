"""Queries: readers and writers, exercised on files that the tables are first written to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import LABELS
from ..functions.text import training_line
from ..operators.aggregates import population_stats, review_statistics
from ..session import scratch_path
from ..sources import delimited, runs, sinks
from ..sources.store import load_or_create
from . import derived
from .derived import GRADED, PREDICTIONS, RAW_ANSWERS, sql_clean_answer
from .evaluation import REVIEW, REVIEW_PERCENTS
from .registry import query, rounded, six, table, whole
from .text_queries import sql_flatten

_MISSING = "(" + ", ".join("'" + cell + "'" for cell in delimited.MISSING_CELLS) + ")"


@query(
    "load_labelled_text",
    f"SELECT text, lang AS label FROM documents WHERE text NOT IN {_MISSING} AND lang NOT IN {_MISSING}",
)
def load_labelled_text(spark, sf_dir):
    path = scratch_path(spark, "labelled")
    documents = table(spark, sf_dir, "documents").select(
        F.col("text").alias("Texto da Demanda"), F.col("lang").alias("Categoria")
    )
    sinks.write_results_pipe(documents, path, sep=";")
    return delimited.load_labelled_text(spark, path)


@query(
    "load_tsv_with_discovery",
    f"""SELECT doc_id AS "ID", lang AS "Categoria", {sql_flatten('text')} AS texto FROM documents""",
)
def load_tsv(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(" ID "), F.col("lang").alias("Categoria "), F.col("text").alias("Texto completo")
    )
    sinks.write_results_pipe(documents, path, sep="\t")
    rows = delimited.load_tsv_with_discovery(spark, path)
    return rows.select(F.col("ID").cast("long").alias("ID"), "Categoria", F.col("Texto completo").alias("texto"))


@query("load_sheet_sniff_delimiter", f"WITH {GRADED} SELECT {REVIEW} FROM graded")
def load_sheet(spark, sf_dir):
    path = scratch_path(spark, "sheet")
    sheet = derived.graded(spark, sf_dir).select(
        F.col("doc_id").alias("ID_Original"),
        F.col("lang").alias("Categoria_Original"),
        F.col("text").alias("Texto_Manifestacao"),
        F.col("consistent").alias("Rotulo Correto \n(Sim/Não)"),
        F.col("realism").alias("Realismo 1 a 5 \n(1-Muito Artificial)"),
        F.col("leakage").alias("Tem Vazamento (Sim/Não)\n Ex. Elogio"),
        F.col("complexity").alias("Complexidade (Sim/Não)"),
    )
    sinks.write_results_pipe(sheet, path, sep="|")
    rows = delimited.load_sheet_sniff_delimiter(spark, path)
    find = delimited.find_column
    stats = review_statistics(
        rows, find(rows, "Rotulo", "Rótulo"), find(rows, "Realismo"), find(rows, "Vazamento"), find(rows, "Complexidade")
    )
    return rounded(stats, *REVIEW_PERCENTS)


@query(
    "scan_run_results",
    """WITH b AS (SELECT p_brand, p_type, max(p_retailprice) / 1000 AS score, max(p_size) AS size, count(*) AS n
  FROM part GROUP BY ALL)
SELECT p_brand || '/' || p_type AS model, round(score, 6) AS f1, round(score / 2, 6) AS accuracy,
  CAST(-1 AS DOUBLE) AS precision, CAST(-1 AS DOUBLE) AS recall, CAST(size AS VARCHAR) AS c, 'gridsearch_optuna' AS origin FROM b
UNION ALL
SELECT p_brand || '/' || p_type, round(score / 3, 6), CAST(-1 AS DOUBLE), round(score / 4, 6),
  CASE WHEN n % 2 = 0 THEN round(score / 5, 6) ELSE CAST(-1 AS DOUBLE) END, CAST(size AS VARCHAR), 'evolutionary' FROM b""",
)
def scan_run_results(spark, sf_dir):
    root = scratch_path(spark, "outputs")
    best = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(
        (F.max("p_retailprice") / 1000).alias("score"), F.max("p_size").alias("size"), F.count(F.lit(1)).alias("n")
    )
    model = F.concat_ws("/", "p_brand", "p_type")
    params = F.struct(F.col("size").alias("C"), F.array(F.lit(1), F.lit(2)).alias("ngram_range"))
    searched = F.to_json(
        F.struct(
            model.alias("model"),
            F.lit("GridSearchCV").alias("algorithm"),
            F.col("score").alias("f1_holdout"),
            (F.col("score") / 2).alias("accuracy_holdout"),
            params.alias("best_params"),
        )
    )
    # A list counts with its first element only.
    evolved = F.to_json(
        F.array(
            F.struct(
                model.alias("Modelo"),
                params.alias("Parametros"),
                (F.col("score") / 3).alias("Holdout_F1"),
                (F.col("score") / 4).alias("Holdout_precision"),
                F.when(F.col("n") % 2 == 0, F.col("score") / 5).alias("Holdout_recall"),
            ),
            F.struct(
                F.lit("ignored").alias("Modelo"),
                params.alias("Parametros"),
                F.lit(1.0).alias("Holdout_F1"),
                F.lit(1.0).alias("Holdout_precision"),
                F.lit(1.0).alias("Holdout_recall"),
            ),
        )
    )
    run = F.concat_ws("-", F.translate("p_brand", "#", ""), F.translate("p_type", " ", "_"))
    for folder, document in (("gridsearch_optuna", searched), ("evolutionary", evolved)):
        best.select(document.alias("value"), run.alias("run")).repartition("run").write.partitionBy("run").text(
            f"{root}/{folder}"
        )
    found = runs.scan_run_results(spark, root, "part-*")
    return rounded(
        found.select(
            "model", "f1", "accuracy", "precision", "recall", F.get_json_object("params", "$.C").alias("c"), "origin"
        ),
        "f1", "accuracy", "precision", "recall",
    )


@query(
    "scan_generation_logs",
    """SELECT 'm' || (user_id % 4) AS model, event_id // 100 AS gen, round(avg(value), 6) AS avg, max(value) AS max,
  CASE WHEN user_id % 4 < 2 THEN min(value) END AS min, CASE WHEN user_id % 4 < 2 THEN count(*) END AS nevals
FROM events GROUP BY user_id % 4, event_id // 100""",
)
def scan_generation_logs(spark, sf_dir):
    root = scratch_path(spark, "logs")
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"),
        F.floor(F.col("event_id") / 100).cast("int").alias("gen"),
        "value",
    )
    stats = population_stats(events, ["model", "gen"], "value")
    for model in ("m0", "m1"):
        rows = stats.where(F.col("model") == model).select("gen", "nevals", "avg", "std", "min", "max")
        rows.write.options(sep=";", header=True, maxRecordsPerFile=100_000).csv(f"{root}/{model}/log_{model}.csv")
    for model in ("m2", "m3"):
        rows = stats.where(F.col("model") == model).select("gen", "avg", "max")
        rows.write.options(sep=",", header=True, maxRecordsPerFile=100_000).csv(f"{root}/{model}/log.csv")
    logs = runs.scan_generation_logs(spark, root, "*.csv")
    return whole(rounded(logs.select("model", "gen", "avg", "max", "min", "nevals"), "avg"), "gen", "nevals")


@query(
    "latest_run",
    """SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_run(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return runs.latest_per_key(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("latest_run_files", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def latest_run_files(spark, sf_dir):
    """The newest file of each key, found among files, read."""
    root = scratch_path(spark, "run-files")
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "event_type")
    events.repartition("kind").write.partitionBy("kind").parquet(root)
    newest = runs.latest_run(spark, root, "*.parquet", F.regexp_extract("path", "kind=([^/]+)", 1))
    paths = [r["path"] for r in newest.select("path").collect()]
    return spark.read.parquet(*paths).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "newest_run_folder",
    """SELECT 'run=' || max(replace(p_brand, '#', '')) AS run,
  (SELECT count(*) FROM part WHERE p_brand = (SELECT max(p_brand) FROM part)) AS n FROM part""",
)
def newest_run_folder(spark, sf_dir):
    """The rows of the newest run folder."""
    root = scratch_path(spark, "run-folders")
    part = table(spark, sf_dir, "part").select("p_partkey", F.translate("p_brand", "#", "").alias("run"))
    part.write.partitionBy("run").parquet(root)
    files = runs.newest_folder(spark, root, "*.parquet").select("path", "run").collect()
    rows = spark.read.parquet(*[f["path"] for f in files])
    return rows.agg(F.lit(files[0]["run"]).alias("run"), F.count(F.lit(1)).alias("n"))


def answer_records(spark, sf_dir):
    """Free-form answers in the prediction record's columns."""
    from ..functions.labels import clean_answer, hit_flag

    answers = derived.raw_answers(spark, sf_dir)
    cleaned = clean_answer("raw")
    return answers.select(
        F.concat_ws("-", "conv_id", "turn").alias("demanda_id"),
        F.col("label").alias("classificacao_real"),
        F.lit("zero_shot_cot").alias("prompt_id"),
        F.lit("gpt-5-nano").alias("modelo_id"),
        cleaned.alias("classificacao_limpa"),
        hit_flag(cleaned, "label").alias("acertou"),
        F.concat(F.lit('"quoted" | '), "label").alias("demanda_texto"),
        F.col("raw").alias("classificacao_raw"),
        (F.col("turn") / 8).alias("tempo_resposta_s"),
        F.when(F.col("raw").isNull(), "Error 429").alias("erro"),
        (1 + F.col("turn") % 5).cast("int").alias("try_count"),
    )


RECORDS = f"""SELECT conv_id || '-' || turn AS demanda_id, label AS classificacao_real, 'zero_shot_cot' AS prompt_id,
  'gpt-5-nano' AS modelo_id, {sql_clean_answer('raw')} AS classificacao_limpa,
  CAST(lower({sql_clean_answer('raw')}) = lower(label) AS INT) AS acertou, '"quoted" | ' || label AS demanda_texto,
  raw AS classificacao_raw, turn / CAST(8 AS DOUBLE) AS tempo_resposta_s, CASE WHEN raw IS NULL THEN 'Error 429' END AS erro,
  CAST(1 + turn % 5 AS INT) AS try_count FROM raw_answers"""


@query("read_results_pipe", f"WITH {RAW_ANSWERS} {RECORDS}")
def read_results_pipe(spark, sf_dir):
    path = scratch_path(spark, "results")
    sinks.write_results_pipe(answer_records(spark, sf_dir), path)
    return delimited.read_results_pipe(spark, path)


@query(
    "load_or_create",
    """SELECT p_brand AS model, coalesce(TRY_CAST(CASE WHEN max(p_size) % 2 = 0 THEN 'n/a' ELSE CAST(max(p_size) AS VARCHAR) END AS DOUBLE), 0)
  AS score, max(p_retailprice) AS runtime_seconds FROM part GROUP BY p_brand""",
)
def stored(spark, sf_dir):
    path = scratch_path(spark, "comparison")

    def build():
        best = F.max("p_size")
        return (
            table(spark, sf_dir, "part")
            .groupBy(F.col("p_brand").alias("model"))
            .agg(
                F.when(best % 2 == 0, "n/a").otherwise(best.cast("string")).alias("score"),
                F.max("p_retailprice").alias("runtime_seconds"),
            )
        )

    numeric = ["score", "runtime_seconds"]
    load_or_create(spark, path, build, numeric)
    return load_or_create(spark, path, build, numeric)


@query(
    "write_results_pipe",
    """SELECT doc_id, text, lang FROM documents""",
)
def pipe_round_trip(spark, sf_dir):
    path = scratch_path(spark, "pipe")
    sinks.write_results_pipe(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    rows = delimited.read_rows(spark, path, "|", ["doc_id", "text", "lang"])
    return whole(rows, "doc_id")


@query(
    "append_results",
    f"""WITH {PREDICTIONS} SELECT kind, item_id, model, pred_label FROM predictions""",
)
def append_results(spark, sf_dir):
    path = scratch_path(spark, "appended")
    rows = derived.predictions(spark, sf_dir).select("kind", "item_id", "model", "pred_label")
    # Every batch comes twice, as after a job that was started again.
    for batch, kind in [*enumerate(("ML", "LLM"))] * 2:
        sinks.append_results(rows.where(F.col("kind") == kind), path, "results", batch)
    return sinks.read_appended(spark, path)


@query(
    "write_delimited_json",
    """WITH s AS (SELECT p_brand AS model, p_name AS params, count(*) AS n, max(p_size) AS best FROM part GROUP BY ALL)
SELECT 'csv' AS format, * FROM s UNION ALL SELECT 'json', * FROM s""",
)
def delimited_json(spark, sf_dir):
    csv_path, json_path = scratch_path(spark, "summary-csv"), scratch_path(spark, "summary-json")
    summary = (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("model"), F.col("p_name").alias("params"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("best"))
    )
    sinks.write_delimited_json(summary, csv_path, json_path)
    schema = summary.schema
    read = [
        spark.read.schema(schema).csv(csv_path, sep=";", header=True, escape='"').withColumn("format", F.lit("csv")),
        spark.read.schema(schema).json(json_path).withColumn("format", F.lit("json")),
    ]
    return read[0].unionByName(read[1]).select("format", "model", "params", "n", "best")


@query(
    "write_fasttext_lines",
    """SELECT '__label__' || replace(lang, ' ', '_') || ' ' || replace(text, chr(10), ' ') AS line FROM documents""",
)
def fasttext_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    sinks.write_fasttext_lines(table(spark, sf_dir, "documents"), "lang", "text", path)
    return spark.read.text(path).withColumnRenamed("value", "line")
