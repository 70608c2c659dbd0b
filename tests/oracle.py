"""Run a query and its SQL on the same tables and compare the results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, float):
        return f"f{value + 0.0:.6f}"
    return f"{type(value).__name__[0]}{value}"


def normal(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark_df, connection, sql: str) -> str | None:
    """None if equal, otherwise what differs."""
    cursor = connection.execute(sql)
    expected_columns = [c[0] for c in cursor.description]
    expected = normal(cursor.fetchall(), expected_columns)
    if sorted(spark_df.columns) != sorted(expected_columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(expected_columns)}"
    actual = normal([tuple(r) for r in spark_df.collect()], spark_df.columns)
    if len(actual) != len(expected):
        return f"{len(actual)} rows, expected {len(expected)}"
    for a, e in zip(actual, expected):
        if a != e:
            return f"{a} != {e}"[:1500]
    return None
