"""Reproducible splits, folds and samples.

Rows are shuffled by md5(id || seed), so membership depends only on the id and
the seed. Splits and folds are intervals of that hash per label: the interval
ends are found from counts, and then every row is assigned where it is, without
moving its text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flatten_text
from ..session import written
from .ranking import hash_bucket, number_cells, number_rows, seeded_hash, top_rows
from .sizing import SMALL_ROWS, join_key_stats

# The review sheet's columns to fill in.
REVIEW_COLUMNS = [
    "Rotulo Correto (Sim/Não)",
    "Realismo 1 a 5 \n(1-Muito Artificial 2- Artificial 3- Regular 4- Natural 5- Muito Natural)",
    "Tem Vazamento (Sim/Não)\n Ex. Elogio, Denúncia ",
    "Complexidade (Sim/Não)",
    "Obs",
]
ROWS_PER_CLASS = 8
FLAT_SAMPLE = 48
# Up to this many rows per group Spark limits a window inside each map task.
LIMIT_IN_MAP = 1_000


def _assign_by_cuts(
    df: DataFrame,
    id_col: str,
    label: str,
    seed: str,
    cut_ranks: Column,
    digits: int,
    max_rows: int,
) -> DataFrame:
    """Add ``_part``: how many of the label's cut ranks a row lies beyond.

    ``cut_ranks`` is an ascending array of ranks computed from ``_total``, the
    label's row count.
    """
    # Rows without a label are a stratum of their own; the key itself is never null.
    stratum = F.struct(F.col(label).isNull().alias("none"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("name"))
    hashed = df.withColumn("_hash", seeded_hash(id_col, seed)).withColumn("_label", stratum)
    narrow = written(hashed.select("_label", "_hash"), "strata")
    keyed = narrow.select("_label", "_hash", hash_bucket("_hash", digits).alias("_bucket"))

    running = Window.partitionBy("_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_label")
    buckets = (
        keyed.groupBy("_label", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_total", F.sum("_n").over(whole))
    )
    # The bucket that holds each cut, and the cut's rank inside it.
    at_cut = (
        buckets.withColumn("_ranks", cut_ranks)
        .withColumn(
            "_inside",
            F.filter("_ranks", lambda r: (r > F.col("_upto") - F.col("_n")) & (r <= F.col("_upto"))),
        )
        .where(F.size("_inside") > 0)
        .select(
            "_label",
            "_bucket",
            "_n",
            F.transform("_inside", lambda r: r - (F.col("_upto") - F.col("_n"))).alias("_ranks"),
        )
    )
    position = F.row_number().over(Window.partitionBy("_label", "_bucket").orderBy("_hash"))
    edges = (
        join_key_stats(keyed, at_cut, ["_label", "_bucket"], "_n", max_rows)
        .withColumn("_rn", position.cast("long"))
        .where(F.array_contains("_ranks", F.col("_rn")))
        .select("_label", F.array_repeat("_hash", F.size(F.filter("_ranks", lambda r: r == F.col("_rn")))).alias("_at"))
    )
    totals = keyed.groupBy("_label").agg(F.count(F.lit(1)).alias("_total"))
    # A label has at most as many edges as there are cuts, so this list is short.
    cuts = edges.groupBy("_label").agg(F.sort_array(F.flatten(F.collect_list("_at"))).alias("_cuts"))
    table = totals.join(cuts, "_label", "left").select(
        "_label",
        F.coalesce("_cuts", F.array().cast("array<string>")).alias("_cuts"),
        F.size(F.filter(cut_ranks, lambda r: r <= 0)).alias("_empty"),
        "_total",
    )
    assigned = join_key_stats(hashed, table, ["_label"], "_total", max_rows)
    beyond = F.size(F.filter("_cuts", lambda c: c < F.col("_hash")))
    return assigned.withColumn("_part", F.col("_empty") + beyond).drop("_cuts", "_total", "_empty", "_hash", "_label")


def stratified_split(
    df: DataFrame,
    id_col: str,
    label: str,
    holdout: float = 0.2,
    seed: str = "split-42",
    out: str = "part",
    digits: int = 4,
    max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Mark each row ``train`` or ``holdout``; the share holds within every label.

    ``id_col`` must be unique. Rows without a label are split like a label of their own.
    """
    train_rows = F.array(F.round(F.col("_total") * F.lit(1 - holdout)).cast("long"))
    split = _assign_by_cuts(df, id_col, label, seed, train_rows, digits, max_rows)
    return split.withColumn(out, F.when(F.col("_part") == 0, "train").otherwise("holdout")).drop("_part")


def stratified_folds(
    df: DataFrame,
    id_col: str,
    label: str,
    k: int = 5,
    seed: str = "folds-42",
    out: str = "fold",
    digits: int = 4,
    max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Number each row's fold from 0 to ``k - 1``; fold sizes differ by at most one row per label.

    Rows without a label are dealt like a label of their own.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    ends = F.array(*[F.ceil(F.col("_total") * j / k).cast("long") for j in range(1, k)])
    folded = _assign_by_cuts(df, id_col, label, seed, ends, digits, max_rows)
    return folded.withColumnRenamed("_part", out)


def sample_per_class(
    df: DataFrame, id_col: str, label: str | None, n: int = ROWS_PER_CLASS, seed: str = "sample-42"
) -> DataFrame:
    """Up to ``n`` rows per class in shuffled order; without a class column a flat sample."""
    if label is None or label not in df.columns:
        return sample_n(df, id_col, FLAT_SAMPLE if n == ROWS_PER_CLASS else n * 6, seed)
    classified = df.where(F.col(label).isNotNull())
    if n <= LIMIT_IN_MAP:
        chosen = top_rows(classified, [label], [seeded_hash(id_col, seed), F.col(id_col)], n)
    else:
        chosen = _first_by_hash(classified, id_col, label, n, seed)
    return chosen.orderBy(seeded_hash(id_col, seed + "-order"), id_col)


def sample_n(df: DataFrame, id_col: str, n: int, seed: str = "sample-42") -> DataFrame:
    """``n`` rows in shuffled order; ``id_col`` must be unique."""
    order = [seeded_hash(id_col, seed), F.col(id_col)]
    if n <= LIMIT_IN_MAP:
        return df.orderBy(*order).limit(n)
    chosen = _first_by_hash(df.withColumn("_all", F.lit(0)), id_col, "_all", n, seed)
    return chosen.drop("_all").orderBy(*order)


def _first_by_hash(df: DataFrame, id_col: str, label: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows of lowest hash per label, found by a cut instead of a sort of each label."""
    cut = F.array(F.least(F.col("_total"), F.lit(n).cast("long")))
    return _assign_by_cuts(df, id_col, label, seed, cut, 4, SMALL_ROWS).where("_part = 0").drop("_part")


def review_sheet(
    df: DataFrame, id_col: str, label: str, text: str, n: int = ROWS_PER_CLASS, seed: str = "sample-42"
) -> DataFrame:
    """A per-class sample with the review columns left empty."""
    chosen = sample_per_class(df, id_col, label, n, seed)
    return chosen.select(
        F.col(id_col).alias("ID_Original"),
        F.col(label).alias("Categoria_Original"),
        flatten_text(text).alias("Texto_Manifestacao"),
        *[F.lit("").alias(name) for name in REVIEW_COLUMNS],
    )


def row_ids(df: DataFrame, key: str | Sequence[str], out: str = "row_id", width: int = 4) -> DataFrame:
    """Zero-padded running number in the order of ``key`` (non-null, unique)."""
    order = [key] if isinstance(key, str) else list(key)
    numbered = number_rows(df, [], order, "_number")
    return numbered.withColumn(out, F.format_string(f"%0{width}d", F.col("_number"))).drop("_number")


def shuffled_ranks(df: DataFrame, id_col: str, label: str, seed: str, out: str = "rank") -> DataFrame:
    """Exact shuffled rank of every row within its label, computed per hash bucket."""
    hashed = df.withColumn("_hash", seeded_hash(id_col, seed)).withColumn("_cell", hash_bucket("_hash"))
    return number_cells(hashed, [label], ["_hash", id_col], out).drop("_hash")
