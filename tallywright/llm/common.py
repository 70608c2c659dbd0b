"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

#: The white space that separates words: space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` (strings) holds at most ``max_bytes`` in each part.

    A value longer than that makes a part of its own.
    """
    if not batch.num_rows:
        return
    values = batch.column(column)
    lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def released() -> None:
    """Give back to the system what a worker has freed: workers outlive their stage, and stages share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The slices of all batches; memory goes back to the system after every batch."""
    for whole in batches:
        yield from slices(whole, column, max_bytes)
        del whole
        released()


def byte_texts(values: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, with null read as empty."""
    return [v if v is not None else b"" for v in values.cast(pa.binary()).to_pylist()]


def prefix_sums(rows: DataFrame, key: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Add the sum of ``value`` over all smaller keys. ``key`` is a unique integer, dense enough for blocks.

    Two levels of windows: one inside blocks of keys, one over block totals, so
    that no task sees more than a block or a ``block``-th of the rows.
    """
    before = (Window.unboundedPreceding, -1)
    blocks = rows.withColumn("_block", F.floor(F.col(key) / block))
    inner = F.sum(value).over(Window.partitionBy("_block").orderBy(key).rowsBetween(*before))
    totals = blocks.groupBy("_block").agg(F.sum(value).alias("_total"))
    outer = F.sum("_total").over(Window.orderBy("_block").rowsBetween(*before))
    bases = totals.select("_block", F.coalesce(outer, F.lit(0)).alias("_base"))
    summed = blocks.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(bases, "_block")
    return summed.withColumn(out, F.col("_base") + F.col("_inner")).drop("_block", "_inner", "_base")


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs``, written once with a number per row, and the column's name, which is none of its own."""
    column = "row_number"
    while column in docs.columns:
        column += "_"
    return written(docs.withColumn(column, F.monotonically_increasing_id()), name), column


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a short ASCII string, byte by byte and bit by bit."""
    bit = "lambda c, z: xor(c >> 1, CASE c & 1 WHEN 1 THEN 3988292384 ELSE 0 END)"
    byte = f"lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), {byte}), 4294967295)"
