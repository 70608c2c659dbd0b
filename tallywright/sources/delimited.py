"""Readers for messy delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import flatten_text
from .records import split_records

# Headers that stand for the text and the label column.
HEADER_ALIASES = {
    "Texto da Demanda": "text",
    "Texto da Manifestação": "text",
    "demanda_texto": "text",
    "Categoria": "label",
    "classificacao_real": "label",
}
# Cells that common readers take for missing.
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Column order and types of the prediction record.
PREDICTION_COLUMNS = {
    "demanda_id": "string",
    "classificacao_real": "string",
    "prompt_id": "string",
    "modelo_id": "string",
    "classificacao_limpa": "string",
    "acertou": "int",
    "demanda_texto": "string",
    "classificacao_raw": "string",
    "tempo_resposta_s": "double",
    "erro": "string",
    "try_count": "int",
}

_CORRUPT = "_bad_line"


def _options(sep: str, multi_line: bool) -> dict:
    return {
        "sep": sep,
        "header": True,
        "quote": '"',
        "escape": '"',
        "multiLine": multi_line,
        "encoding": "UTF-8",
        # Every column must be parsed, or the field count of a line is not checked.
        "columnPruning": False,
    }


def read_header(spark: SparkSession, path: str, sep: str, multi_line: bool = True) -> list[str]:
    """Column names as in the file's first record, without a byte-order mark."""
    names = spark.read.options(**_options(sep, multi_line)).csv(path).columns
    return [name.lstrip("\ufeff") for name in names]


def read_rows(
    spark: SparkSession, path: str, sep: str, names: Sequence[str], multi_line: bool = True
) -> DataFrame:
    """All columns as strings. Lines with too many fields are skipped, short ones padded with null."""
    columns = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _CORRUPT]])
    if multi_line:
        records = split_records(spark, path, sep).where("place > 1 AND record != ''")
        options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
        rows = records.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    else:
        options = _options(sep, multi_line) | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
        rows = spark.read.options(**options).schema(schema).csv(path)
    # Only lines with an unexpected field count carry their raw text; count their fields outside quotes.
    unquoted = F.regexp_replace(_CORRUPT, '"(?:[^"]|"")*"', "")
    fields = F.size(F.split(unquoted, "\\" + sep if sep in "|" else sep))
    kept = rows.where(F.col(_CORRUPT).isNull() | (fields <= len(names)))
    return kept.select(*[F.col(c).alias(name) for c, name in zip(columns, names)])


def _missing_to_null(name: str):
    return F.when(~F.col(name).isin(MISSING_CELLS), F.col(name)).alias(name)


def load_labelled_text(
    spark: SparkSession,
    path: str,
    separators: Sequence[str] = (";", "|", "\t", ","),
    multi_line: bool = True,
) -> DataFrame:
    """Clean ``text, label`` rows of a delimited file.

    The first separator that yields two columns is used. Known headers are
    renamed; failing that, the first two columns are taken by position. Rows
    without a text or a label are dropped.

    ``multi_line`` lets quoted cells span lines; such files are read in splits
    like others, with a shuffle that puts records together.
    """
    for sep in separators:
        names = read_header(spark, path, sep, multi_line)
        if len(names) >= 2:
            break
    else:
        raise ValueError(f"no separator of {list(separators)} splits {path} into two columns")
    renamed = [HEADER_ALIASES.get(name, name) for name in names]
    rows = read_rows(spark, path, sep, names, multi_line)
    if "text" in renamed and "label" in renamed:
        chosen = rows.select(
            F.col(f"`{names[renamed.index('text')]}`").alias("text"),
            F.col(f"`{names[renamed.index('label')]}`").alias("label"),
        )
    else:
        chosen = rows.toDF(*[f"c{i}" for i in range(len(names))]).select(
            F.col("c0").alias("text"), F.col("c1").alias("label")
        )
    return chosen.select(_missing_to_null("text"), _missing_to_null("label")).dropna()


def load_tsv_with_discovery(
    spark: SparkSession, path: str, text_header: str = "Texto da Demanda", multi_line: bool = True
) -> DataFrame:
    """Tab-separated rows with trimmed headers and a flattened text column.

    The text column is ``text_header`` or else the first whose header contains "texto".
    """
    headers = read_header(spark, path, "\t", multi_line)
    if len(headers) < 2:
        raise ValueError(f"{path} is not tab-separated")
    names = [h.strip() for h in headers]
    found = [n for n in names if n == text_header] or [n for n in names if "texto" in n.lower()]
    if not found:
        raise ValueError(f"no text column among {names}")
    rows = read_rows(spark, path, "\t", names, multi_line)
    return rows.withColumn(found[0], flatten_text(f"`{found[0]}`"))


def load_sheet_sniff_delimiter(spark: SparkSession, path: str, separators: Sequence[str] = (",", "|", ";")) -> DataFrame:
    """A sheet whose separator is the first that gives two columns; header cells are flattened to one line."""
    for sep in separators:
        names = read_header(spark, path, sep)
        if len(names) >= 2:
            break
    else:
        raise ValueError(f"no separator of {list(separators)} splits {path} into two columns")
    flat = [name.replace("\n", " ").replace("\r", "").strip() for name in names]
    return read_rows(spark, path, sep, flat)


def find_column(df: DataFrame, *parts: str) -> str:
    """The first column whose name contains one of ``parts``."""
    for name in df.columns:
        if any(part in name for part in parts):
            return name
    raise ValueError(f"no column like {parts} among {df.columns}")


def read_results_pipe(spark: SparkSession, path: str, separators: Sequence[str] = ("|", "\t")) -> DataFrame:
    """A fully quoted result table with the columns of the prediction record."""
    for sep in separators:
        names = read_header(spark, path, sep)
        if len(names) >= 2:
            break
    else:
        raise ValueError(f"no separator of {list(separators)} splits {path} into two columns")
    rows = read_rows(spark, path, sep, names)
    typed = []
    for name, kind in PREDICTION_COLUMNS.items():
        if name not in names:
            typed.append(F.lit(None).cast(kind).alias(name))
        elif kind == "string":
            typed.append(F.when(F.col(name) != "", F.col(name)).alias(name))
        else:
            typed.append(F.col(name).try_cast(kind).alias(name))
    return rows.select(*typed)


