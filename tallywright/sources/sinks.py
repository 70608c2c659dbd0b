"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import training_line


def write_results_pipe(df: DataFrame, path: str, sep: str = "|", mode: str = "errorifexists") -> None:
    """Quote-all delimited text with a header; cells keep their line breaks and spaces."""
    (
        df.write.mode(mode)
        .options(
            sep=sep,
            header=True,
            quoteAll=True,
            quote='"',
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
        .csv(path)
    )


def append_results(df: DataFrame, path: str, job: str | None = None, batch: int | str = 0) -> None:
    """Add a batch of results to a stored table, once.

    Rows are written to a folder of their own; a manifest entry named after
    ``job`` and ``batch`` then makes them part of the table. A repeated batch
    finds its entry and adds nothing; a batch that was cut short has no entry and
    is not read. Without a job every call is a batch of its own. Read the table
    with ``read_appended``.
    """
    spark = df.sparkSession
    name = f"{uuid.uuid4().hex if job is None else job}@{batch}"
    if not name.replace("@", "").replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"a batch's name may hold letters, digits, - and _ only: {name!r}")
    system, entry = _at(spark, f"{path}/_manifest/{name}")
    if system.exists(entry):
        return
    part = f"part={uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{part}")
    # The entry appears whole; if another writer was faster, its rows count and not these.
    _, draft = _at(spark, f"{path}/_manifest/.{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(part.encode()))
    out.close()
    system.rename(draft, entry)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that the manifest names."""
    entries = spark.read.text(f"{path}/_manifest/*", wholetext=True).select("value").collect()
    return spark.read.option("mergeSchema", True).parquet(*sorted(f"{path}/{e['value']}" for e in entries if e["value"]))


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_delimited_json(df: DataFrame, csv_path: str, json_path: str) -> None:
    """A summary as ``;`` delimited text and as JSON records."""
    (
        df.write.options(
            sep=";",
            header=True,
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        ).csv(csv_path)
    )
    df.write.option("ignoreNullFields", False).json(json_path)


def write_fasttext_lines(df: DataFrame, label: str, text: str, path: str) -> None:
    """One ``__label__<label> <text>`` line per row."""
    df.select(training_line(F.col(label), F.col(text)).alias("value")).write.text(path)
