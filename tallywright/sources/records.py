"""Records of delimited files whose quoted cells span lines, read by many tasks.

Files are read as lines, in splits, as Spark reads any text. Whether a line
begins inside a quoted cell depends on all lines before it, but each line only
has four ways to act on that state: keep it, flip it, or end inside or outside
a cell whatever came before. The state before a line therefore follows from the
last line that fixed it and the parity of the flips since. This is worked out
inside each split by a window, over the splits by a second one, and the two are
put together; a record is the run of lines from one that begins outside.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _ends_inside(line: Column, sep: str, began_inside: bool) -> Column:
    """Whether a line ends inside a quoted cell, if it began inside or outside one."""
    s = re.escape(sep)
    # A quoted cell closes at a quote that is not doubled; what follows up to the separator belongs to it.
    cell = r'"(?:[^"]|"")*+"(?!")' + f"[^{s}]*"
    if began_inside:
        # Go on behind the end of the open cell, or stay inside.
        rest = F.regexp_extract(line, rf'^(?:[^"]|"")*+"(?!")([^{s}]*(?:{s}.*)?)$', 1)
        closes = F.regexp_like(line, F.lit(r'^(?:[^"]|"")*+"(?!")'))
        return ~closes | F.when(closes, _ends_inside(F.concat(F.lit("x"), rest), sep, False)).otherwise(False)
    bare = F.regexp_replace(line, rf"(?<=^|{s}){cell}(?=$|{s})", "x")
    return F.regexp_like(bare, F.lit(rf'(?:^|{s})"'))


def _state_before(rows: DataFrame, keys: list[str], order: str, fixed: str, flips: str) -> DataFrame:
    """Add ``_last``, the last row that fixed the state (its value and running flips), and ``_flips`` before each row."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("_through", F.sum(flips).over(through))
    mark = F.when(F.col(fixed).isNotNull(), F.struct(F.col(order).alias("at"), F.col(fixed).alias("value"), F.col("_through").alias("flips")))
    return running.withColumn("_last", F.max(mark).over(before)).withColumn("_flips", F.coalesce(F.sum(flips).over(before), F.lit(0)))


def split_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``file, place, record`` of every record of the files at ``path``; ``place`` ascends within a file.

    Lines end in ``\\n``; a ``\\r`` before the end of a record is dropped. Files
    of any size are read in splits; only a single record must fit in memory.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    # Only lines with a quote act on the state.
    quoted = F.contains("value", F.lit('"'))
    ends = [F.when(quoted, _ends_inside(F.rtrim("value", F.lit("\r")), sep, inside)) for inside in (False, True)]
    acts = lines.withColumn("_out", ends[0]).withColumn("_in", ends[1])
    acts = acts.withColumn("fixed", F.when(F.col("_out") == F.col("_in"), F.col("_out").cast("int")))
    flip = (F.col("_out") & ~F.col("_in")).cast("int")
    acts = acts.withColumn("flip", F.coalesce(flip, F.lit(0))).drop("_out", "_in")
    inside = _state_before(acts, ["file", "split"], "line", "fixed", "flip")

    # What a whole split does to the state, and so the state in which each split begins.
    whole = acts.groupBy("file", "split").agg(
        F.max_by(F.struct("fixed", "line"), F.when(F.col("fixed").isNotNull(), F.col("line"))).alias("f"),
        F.sum("flip").alias("flip"),
    )
    after = inside.where("fixed IS NOT NULL").groupBy("file", "split").agg(F.max_by("_through", "line").alias("fixed_through"))
    splits = whole.join(after, ["file", "split"], "left").select(
        "file",
        "split",
        F.when(F.col("f").isNotNull(), (F.col("f.fixed") + F.col("flip") - F.col("fixed_through")) % 2).alias("fixed"),
        "flip",
    )
    begun = _state_before(splits, ["file"], "split", "fixed", "flip").select("file", "split", _state(F.lit(0)).alias("begin"))
    placed = inside.join(begun, ["file", "split"])
    placed = placed.select("file", "split", "line", "value", (_state(F.col("begin")) == 0).alias("starts"))

    # Number the records; the lines of one share their number.
    upto = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    counts = placed.groupBy("file", "split").agg(F.count_if("starts").alias("n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    numbered = placed.withColumn("own", F.count_if("starts").over(upto)).join(bases, ["file", "split"])
    numbered = numbered.withColumn("place", F.col("base") + F.col("own"))
    records = numbered.groupBy("file", "place").agg(F.array_sort(F.collect_list(F.struct("split", "line", "value"))).alias("lines"))
    text = F.rtrim(F.array_join(F.col("lines.value"), "\n"), F.lit("\r"))
    return records.select("file", "place", text.alias("record"))


def _state(begin: Column) -> Column:
    """The state before a row: 1 inside a quoted cell."""
    since = F.col("_last.value") + F.col("_flips") - F.col("_last.flips")
    return F.coalesce(since, begin + F.col("_flips")) % 2
