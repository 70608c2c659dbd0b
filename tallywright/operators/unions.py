"""Stacking result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import model_type
from .ranking import top_rows


def union_results(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column some table lacks is null there."""
    first, *others = tables
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def registry_key(run: str, model: str, origin: str) -> Column:
    return F.concat_ws("__", F.col(run), model_type(model), F.col(origin))


def registry_merge(tables: Sequence[DataFrame], key: str, written_at: Sequence[str]) -> DataFrame:
    """Union of keyed tables in which the last write of a key wins.

    ``written_at`` orders the writes and must be unique per key within a table;
    later tables win over earlier ones.
    """
    ranked = [table.withColumn("_source", F.lit(i)) for i, table in enumerate(tables)]
    newest_first = [F.col("_source").desc(), *[F.col(c).desc() for c in written_at]]
    return top_rows(union_results(*ranked), [key], newest_first).drop("_source")
