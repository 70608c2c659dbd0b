"""Global shuffle into shards in two passes.

Pass one scatters the rows over memory-sized buckets by a seeded hash. Pass two
applies a Fisher-Yates permutation to each bucket and writes it. A bucket's
place in the global order is the number of rows in the buckets before it, so a
row's position, and with it shard and slot, is known without a further sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, written
from .common import load, prefix_sums, whole_text

BUCKET_BYTES = 16 << 20


def text_bytes(text: str | Column = "text") -> Column:
    return F.octet_length(whole_text(text)).cast("long") + 1


def permutations(counts: DataFrame, seed: int, tasks: int) -> DataFrame:
    """A Fisher-Yates permutation of 0..n-1 per bucket, as an array.

    The generator's state depends on the partition and on the order in it, so
    both are fixed here: the same counts and tasks give the same permutations.
    """
    placed = counts.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    order = F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(seed))
    return placed.select("bucket", "base", order.alias("order"))


def scattered(docs: DataFrame, id_col: str, text_col: str, seed: int, bucket_bytes: int) -> DataFrame:
    """Pass one: every row as a struct ``record`` with its ``bucket``.

    Buckets hold ``bucket_bytes`` on average. Rows that are equal in id and text
    share a bucket. Where such copies swell a bucket to several times its size,
    its rows are spread over more buckets by arrival. Equal rows are
    exchangeable, but the order of the other rows of such a bucket then depends
    on the layout of the input's files too.
    """
    total = docs.agg(F.coalesce(F.sum(text_bytes(text_col)), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / bucket_bytes))
    content = F.xxhash64(F.col(text_col))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
        F.col(id_col).alias("id"),
        content.alias("content"),
        text_bytes(text_col).alias("size"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), content), F.lit(buckets)).alias("bucket"),
    )
    sizes = rows.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    swollen = sizes.where(F.col("bytes") - F.col("largest") > 4 * bucket_bytes)
    swollen = written(swollen.select("bucket", F.ceil(F.col("bytes") / bucket_bytes).alias("pieces")), "swollen")
    if swollen.isEmpty():
        return rows
    arrival = rows.withColumn("arrival", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    piece = F.pmod("arrival", F.coalesce("pieces", F.lit(1)))
    spread = arrival.join(swollen, "bucket", "left").withColumn("bucket", F.col("bucket") + piece * buckets)
    return written(spread.drop("arrival", "pieces"), "scattered")


def shuffle_into_shards(
    docs: DataFrame,
    path: str,
    shards: int = 8,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    tasks: int = 64,
) -> DataFrame:
    """Write all rows in a uniformly random order into ``shards`` folders under ``path`` and read them back.

    Shard sizes differ by at most one row. A shard is a run of the global
    order, so each bucket is written once, to one shard or two. Files hold the
    whole input row as the struct ``record`` (so no column name can clash), its
    ``size`` in bytes, and ``slot``, the place in the shard. The order depends
    on ids, texts, ``seed``, ``bucket_bytes`` and ``tasks`` only.

    Defined results: null ids and null texts are values like others; repeated
    rows keep a place each; an empty table gives no rows.
    """
    rows = scattered(docs, id_col, text_col, seed, bucket_bytes)
    counts = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Written, so that it has no partitioning of its own to which the rows would be shuffled once more.
    plan = written(permutations(prefix_sums(counts, "bucket", "n", "base"), seed, tasks), "bucket-orders")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("id", "content")) - 1
    placed = rows.withColumn("rank", rank).join(plan.hint("merge"), "bucket")
    position = F.col("base") + F.get("order", F.col("rank"))
    placed = placed.select("record", "size", position.alias("position"))
    start = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    shard = F.expr(f"cast((position * {shards}) div {max(total, 1)}L as int)")
    final = placed.withColumn("shard", shard).withColumn("slot", F.col("position") - start).drop("position")
    final.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    spark = docs.sparkSession
    return spark.read.schema(final.schema).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    shards = shuffle_into_shards(load(spark, sf_dir), scratch_path(spark, "shards"))
    text = whole_text(F.col("record.text"))
    return shards.select(
        F.col("record.doc_id").alias("doc_id"),
        "size",
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
