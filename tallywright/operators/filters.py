"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import real
from ..functions.text import preprocess_text


def drop_null_pairs(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    return df.dropna(subset=[text, label])


def drop_empty_processed(df: DataFrame, text: str = "text", out: str = "text_processed") -> DataFrame:
    """Add the preprocessed text and drop the rows of which nothing is left."""
    return df.withColumn(out, preprocess_text(text)).where(F.length(out) > 0)


def valid_scores(df: DataFrame, score: str) -> DataFrame:
    """Drop rows whose score is missing, NaN or the -1 sentinel."""
    return df.where(real(score) != -1)


def timed_runs(df: DataFrame, runtime: str, above: float = 0.01) -> DataFrame:
    """Keep runs whose time was measured."""
    return df.where(real(runtime) > above)


def high_quality_share(rating: Column, good: float = 4) -> Column:
    """Percent of all rows rated ``good`` or better; unreadable ratings count as rows only."""
    return F.try_divide(F.count(F.when(real(rating) >= good, 1)) * F.lit(100.0).cast("double"), F.count(F.lit(1)))
