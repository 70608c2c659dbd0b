"""Row numbers and running values that stay parallel inside a hot group.

A window sorts each group in one task. Where a group is too large for that, it
is cut into cells along its order, the window runs inside each cell, and one
small per-cell table carries the value over from the cells before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

MAX_GROUP_ROWS = 200_000


def seeded_hash(id_col: str | Column, seed: str) -> Column:
    """A reproducible shuffle key: md5 over the id and a seed, as 32 hex digits."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(column.cast("string"), F.lit(seed)))


def hash_bucket(hash_col: str | Column, digits: int = 4) -> Column:
    """The leading hex digits as a number; buckets follow the order of the hash."""
    column = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    return F.conv(F.substring(column, 1, digits), 16, 10).cast("int")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows per group. ``order`` must end in a unique key.

    Spark limits each map task to ``k`` rows per group before the shuffle
    (WindowGroupLimit), so a hot group never travels whole.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= k).drop("_rn")


def with_cells(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS
) -> tuple[DataFrame, bool]:
    """Add ``_cell``, a number that rises along ``order`` inside each group; one cell holds about ``max_group_rows`` rows at most.

    ``order`` must end in a unique column. Returns the frame and whether any
    group had to be cut; if none, ``_cell`` is 0. Otherwise the rows are range
    partitioned by group and order, which spreads a large group over as many
    cells as it has rows for, whatever its values are, and written, because a
    second evaluation might draw the bounds elsewhere. Any bounds give the same
    results.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    if not total or largest <= max_group_rows:
        return df.withColumn("_cell", F.lit(0)), False
    cells = 2 * -(-total // max_group_rows)
    ranged = df.repartitionByRange(cells, *keys, *order).withColumn("_cell", F.spark_partition_id())
    return written(ranged, "cells"), True


def carry_over(rows: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-cell values to the rows; both sides are hash-partitioned on (keys, cell)."""
    return rows.join(heads, [*keys, "_cell"])


def number_cells(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Exact row numbers per group over a frame that already has ordered ``_cell`` values."""
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        df.groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order)))
    numbered = carry_over(local, heads, keys).withColumn(out, F.col("_offset") + F.col("_local"))
    return numbered.drop("_offset", "_local", "_cell")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "row_number",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """``row_number()`` per group in ascending ``order``, with hot groups spread over tasks."""
    celled, cut = with_cells(df, keys, order, max_group_rows)
    if cut:
        return number_cells(celled, keys, order, out)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    include_current: bool = True,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Largest ``value`` so far per group, with or without the row itself."""
    last = Window.currentRow if include_current else -1
    celled, cut = with_cells(df, keys, order, max_group_rows)
    if not cut:
        span = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumn(out, F.max(value).over(span))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        celled.groupBy(*keys, "_cell")
        .agg(F.max(value).alias("_m"))
        .select(*keys, "_cell", F.max("_m").over(before).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    local = celled.withColumn("_inside", F.max(value).over(inside))
    return carry_over(local, heads, keys).withColumn(out, F.greatest("_before", "_inside")).drop(
        "_before", "_inside", "_cell"
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """``lag(value)`` per group; null on a group's first row."""
    celled, cut = with_cells(df, keys, order, max_group_rows)
    if not cut:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    heads = (
        celled.groupBy(*keys, "_cell")
        .agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
        .select(*keys, "_cell", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_cell")).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    local = celled.withColumn("_inside", F.lag(value).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    return (
        carry_over(local, heads, keys)
        .withColumn(out, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_inside")))
        .drop("_before", "_inside", "_first", "_cell")
    )
