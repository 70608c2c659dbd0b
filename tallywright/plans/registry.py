"""Named queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its oracle SQL where one exists."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(column: str | Column, name: str | None = None) -> Column:
    """A double rounded to six digits for comparison."""
    column = F.col(column) if isinstance(column, str) else column
    rounded = F.round(column.cast("double"), 6)
    return rounded.alias(name) if name else rounded


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: six(name) for name in names})


def whole(df: DataFrame, *names: str) -> DataFrame:
    """Integer columns as BIGINT, as the oracle returns them."""
    return df.withColumns({name: F.col(name).cast("long") for name in names})


def sql_text(value: str) -> str:
    """A SQL string literal; line breaks are spelled chr(10) so that it stays on one line."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
