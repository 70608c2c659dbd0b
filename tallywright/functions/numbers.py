"""Numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def real(value: str | Column) -> Column:
    """The number, with NaN read as missing: for Spark NaN is the largest number, but it must never win."""
    column = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(column), column)
