"""Integer codes for labels, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import number_rows
from .sizing import join_key_stats


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """One row per distinct label with its code: the position in sorted order, from 0.

    Numbered over the distinct labels only, in parts if there are many.
    """
    distinct = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    numbered = number_rows(distinct, [], [label], "_place")
    return numbered.withColumn("label_code", (F.col("_place") - 1).cast("int")).drop("_place")


def label_index(df: DataFrame, label: str) -> DataFrame:
    """Add ``label_code`` to every labelled row."""
    return join_key_stats(df, label_codes(df, label), [label], "n_rows").drop("n_rows")


def label_name(df: DataFrame, codes: DataFrame, code: str, label: str) -> DataFrame:
    """Turn codes back into labels with the table that ``label_codes`` made."""
    names = codes.select(F.col("label_code").alias(code), label, "n_rows")
    return join_key_stats(df, names, [code], "n_rows").drop("n_rows")
