"""Readers for the artifacts of search runs: result JSONs and generation logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import real
from ..operators.ranking import top_rows

# The fields of both result layouts, with parameters kept as JSON text.
RESULT_FIELDS = (
    "model string, algorithm string, best_params string, best_f1_train double, f1_holdout double,"
    " accuracy_holdout double, precision_holdout double, recall_holdout double, runtime_seconds double,"
    " Modelo string, Parametros string, Holdout_F1 double, Holdout_accuracy double,"
    " Holdout_precision double, Holdout_recall double"
)
MISSING_SCORE = -1.0
# Columns a generation log can have.
LOG_COLUMNS = {"gen": "int", "nevals": "int", "avg": "double", "std": "double", "min": "double", "max": "double", "time": "double"}


def _struct_fields() -> str:
    return ",".join(":".join(field.split()) for field in RESULT_FIELDS.split(","))


def _whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return (
        spark.read.text(root, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
        .select(F.col("value"), F.col("_metadata.file_path").alias("source_file"))
    )


def scan_run_results(
    spark: SparkSession, root: str, pattern: str = "final_*.json", every_element: bool = False
) -> DataFrame:
    """Every result file below ``root`` as one row, whichever of the two layouts it has.

    A file that holds a list counts with its first element or, with
    ``every_element``, gives a row for each. Missing and NaN scores are -1.
    Files are read whole because each is one small JSON document.
    """
    files = _whole_files(spark, root, pattern)
    is_list = F.col("value").rlike(r"^[\s\x{feff}]*\[")
    if every_element:
        listed = F.when(is_list, F.from_json("value", f"array<struct<{_struct_fields()}>>"))
        single = F.array(F.from_json("value", RESULT_FIELDS))
        parsed = files.select("source_file", F.explode(F.when(is_list, listed).otherwise(single)).alias("r"))
    else:
        element = F.when(is_list, F.get_json_object("value", "$[0]")).otherwise(F.col("value"))
        parsed = files.select("source_file", F.from_json(element, RESULT_FIELDS).alias("r"))

    def score(new: str, old: str):
        return F.coalesce(real(f"r.{new}"), real(f"r.{old}"), F.lit(MISSING_SCORE))

    return parsed.select(
        F.coalesce("r.model", "r.Modelo").alias("model"),
        score("f1_holdout", "Holdout_F1").alias("f1"),
        score("accuracy_holdout", "Holdout_accuracy").alias("accuracy"),
        score("precision_holdout", "Holdout_precision").alias("precision"),
        score("recall_holdout", "Holdout_recall").alias("recall"),
        F.coalesce("r.best_params", "r.Parametros").alias("params"),
        F.coalesce(real("r.runtime_seconds"), F.lit(0.0)).alias("runtime_seconds"),
        F.coalesce("r.algorithm", F.when(F.col("r.Modelo").isNotNull(), "Evolutionary"), F.lit("Grid/Optuna")).alias(
            "approach"
        ),
        F.when(F.col("source_file").contains("evolutionary"), "evolutionary")
        .otherwise("gridsearch_optuna")
        .alias("origin"),
        "source_file",
    ).where(F.col("model").isNotNull())


def log_model(path):
    """Model of a log file: ``log_<model>.csv`` names it, otherwise the folder of ``log.csv`` does."""
    by_file = F.regexp_extract(path, r"/log_([^/]+)\.csv", 1)
    by_folder = F.regexp_extract(path, r"/([^/]+)/log\.csv", 1)
    return F.when(by_file != "", by_file).otherwise(by_folder)


def scan_generation_logs(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """All generation logs below ``root``, in either layout, with the model each belongs to.

    Columns are matched by each file's own header; those a file lacks are null.
    """
    files = _whole_files(spark, root, pattern).withColumn("model", log_model(F.col("source_file")))
    files = files.where(F.col("model") != "")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    with_header = files.select("model", "source_file", lines.alias("lines")).select(
        "model",
        "source_file",
        F.get("lines", F.lit(0)).alias("header"),
        F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"),
    )
    sep = F.when(F.contains("header", F.lit(";")), ";").otherwise(",")
    cells = (
        with_header.where(F.trim("line") != "")
        .withColumn("names", F.split("header", "[;,]"))
        .withColumn("values", F.split(F.col("line"), F.concat(F.lit("["), sep, F.lit("]"))))
    )
    position = {name: F.array_position("names", name) for name in LOG_COLUMNS}
    value = {
        name: F.when(position[name] > 0, F.get("values", (position[name] - 1).cast("int"))) for name in LOG_COLUMNS
    }
    typed = [value[name].try_cast(kind).alias(name) for name, kind in LOG_COLUMNS.items()]
    return cells.select("model", "source_file", *typed)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path and modification time of every file below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "modificationTime")
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The row with the greatest ``newest`` columns per key; they must be unique together."""
    return top_rows(df, keys, [F.col(c).desc() for c in newest])


def latest_run(spark: SparkSession, root: str, pattern: str = "*", key=None) -> DataFrame:
    """Newest file per key, by default the newest log per model."""
    files = list_files(spark, root, pattern)
    key = log_model(F.col("path")) if key is None else key
    return latest_per_key(files.withColumn("key", key).where("key <> ''"), ["key"], ["modificationTime", "path"])


def newest_folder(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """The files of the run folder directly below ``root`` that sorts last by name: ``path, modificationTime, run``.

    Run folders carry their time in the name, so the last name is the newest run.
    """
    prefix = F.lit(root.rstrip("/").split("/")[-1])
    files = list_files(spark, root, pattern)
    below = F.element_at(F.split("path", F.concat(F.lit("/\\Q"), prefix, F.lit("\\E/"))), -1)
    named = files.withColumn("run", F.split(below, "/"))
    named = named.where(F.size("run") > 1).withColumn("run", F.get("run", F.lit(0)))
    newest = named.agg(F.max("run").alias("run"))
    return named.join(F.broadcast(newest), "run", "left_semi").select("path", "modificationTime", "run")
