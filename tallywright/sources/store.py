"""Stored aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import real


def load_or_create(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], numeric: Sequence[str] = ()
) -> DataFrame:
    """The table stored at ``path``, built and stored first if there is none.

    Columns named in ``numeric`` become doubles; what is not a number becomes 0.
    """
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        build().write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
    for name in numeric:
        stored = stored.withColumn(name, F.coalesce(real(F.col(name).try_cast("double")), F.lit(0.0)))
    return stored
