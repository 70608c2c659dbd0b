"""Mix sources to target weights by repeating documents.

Sizes are summed per source, each source gets a repetition rate, and each
document is emitted floor(rate) times plus once more with a probability equal
to the fraction. The draw is a hash of the document's id and a seed, so reruns
agree and no row depends on another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..operators.sizing import join_key_stats
from ..session import written
from .common import load, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEEDS = 16


def source_key(source: str | Column) -> Column:
    """A key without nulls whose order is that of code points, null last."""
    column = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("0"), column), F.lit("1"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed and the id; a null id draws like the string 'null'."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``key, source_size, rows, target`` per source.

    The ``weights`` repeat over the sources in order of code points. All sizes
    are shared out by weight; a source whose share exceeds ``max_repeats``
    times its size stops there and the excess is shared out again among the
    others, until no share exceeds its bound. Only two sums per round reach the
    driver.
    """
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranked = number_rows(per.withColumn("all", F.lit(1)), ["all"], ["key"], "place").drop("all")
    pattern = F.array(*[F.lit(w) for w in weights])
    weight = F.element_at(pattern, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = written(ranked.select("key", "source_size", "rows", weight.cast("long").alias("weight")), "sources")
    bound = F.col("source_size") * max_repeats
    total, open_weight = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    given, level = 0, 0.0
    while open_weight:
        level = float(total - given) / float(open_weight)
        above = F.lit(level) * F.col("weight") > bound
        now = table.agg(
            F.coalesce(F.sum(F.when(above, bound)), F.lit(0)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if (now[0], now[1]) == (given, open_weight):
            break
        given, open_weight = now
    target = F.least(F.lit(level) * F.col("weight"), bound.cast("double"))
    return table.select("key", "source_size", "rows", target.alias("target"))


def copies(rate: Column, chance: Column) -> Column:
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def mixing_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seeds: int = SEEDS,
) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (``doc_id, key, size``) and, per source, ``key, rows, source_size, target, rate, seed``.

    Of ``seeds`` fixed seeds each source uses the one whose draws come nearest
    to its target; this takes one pass over the narrow rows and matters only
    for sources of few documents.
    """
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"), source_key(source_col).alias("key"), word_count(F.col(text_col)).alias("size")
        ),
        "mix-sizes",
    )
    table = targets(rows, weights, max_repeats)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    table = written(table.withColumn("rate", rate), "mix-rates")
    with_rate = join_key_stats(rows, table, ["key"], "rows", stored=True)
    tried = with_rate.groupBy("key").agg(
        F.first("target").alias("target"),
        *[F.sum(F.col("size") * copies(F.col("rate"), draw(F.col("doc_id"), k))).alias(f"t{k}") for k in range(seeds)],
    )
    options = F.array(
        *[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(seeds)]
    )
    chosen = tried.select("key", F.array_min(options)["seed"].alias("seed"))
    return rows, written(table.join(chosen, "key"), "mix-plan")


def _copies(seeds: int) -> Column:
    """The copies of a row that carries ``doc_id, rate, seed``; only the source's own draw is computed."""
    chance = F.lit(None).cast("double")
    for k in reversed(range(seeds)):
        chance = F.when(F.col("seed") == k, draw(F.col("doc_id"), k)).otherwise(chance)
    return copies(F.col("rate"), chance)


def mixed_sizes(docs: DataFrame, seeds: int = SEEDS, **options) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``.

    Defined results: a null text has size 0; null sources are one source, the
    last; a source without words keeps each document once; null ids draw alike,
    as do repeated ids; an empty table gives no rows.
    """
    rows, plan = mixing_plan(docs, seeds=seeds, **options)
    joined = join_key_stats(rows, plan, ["key"], "rows", stored=True)
    taken = F.col("size") * _copies(seeds)
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(
    docs: DataFrame,
    seeds: int = SEEDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    **options,
) -> DataFrame:
    """The mixed documents: each row as often as the plan says, all columns unchanged.

    Defined results: those of ``mixed_sizes``; a null or blank text has size 0
    and is repeated like any other of its source; an empty table gives no rows;
    columns may have any names.
    """
    _, plan = mixing_plan(docs, id_col=id_col, source_col=source_col, seeds=seeds, **options)
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
        F.col(id_col).alias("doc_id"),
        source_key(source_col).alias("key"),
    )
    joined = join_key_stats(packed, plan, ["key"], "rows", stored=True).withColumn("copies", _copies(seeds))
    repeated = joined.where("copies > 0").select("record", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("record.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mixed_sizes(load(spark, sf_dir))


def sql(table: str = "documents") -> str:
    """The same result in SQL; with WITH parts, so that it can also follow other stages."""
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    u = "('0x' || substr(md5(k || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return f"""
mix_rows AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key, {words}::BIGINT AS size FROM {table}),
mix_src AS (
  SELECT key, s, CASE (row_number() OVER (ORDER BY encode(key)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT key, sum(size)::BIGINT AS s FROM mix_rows GROUP BY key)),
mix_lev AS (
  SELECT key, 3.0 * s / w AS r,
    ((SELECT sum(s) FROM mix_src) - coalesce(sum(3 * s) OVER (ORDER BY 3.0 * s / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY 3.0 * s / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lam
  FROM mix_src),
mix_lam AS (SELECT lam FROM mix_lev WHERE lam <= r ORDER BY r, key LIMIT 1),
mix_tgt AS (
  SELECT key, s, least((SELECT lam FROM mix_lam) * w, (3 * s)::DOUBLE) AS target FROM mix_src),
mix_rate AS (SELECT key, s, target, CASE WHEN s > 0 THEN target / s ELSE 1.0 END::DOUBLE AS rate FROM mix_tgt),
mix_try AS (
  SELECT key, k, abs(sum(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)) - any_value(target)) AS off
  FROM (SELECT m.*, g.k, r.rate, r.target, {u} AS u
        FROM mix_rows m JOIN mix_rate r USING (key), (SELECT unnest(range({SEEDS})) AS k) g)
  GROUP BY key, k),
mix_seed AS (SELECT key, k FROM (SELECT key, k, row_number() OVER (PARTITION BY key ORDER BY off, k) AS n FROM mix_try) WHERE n = 1),
mix AS (
  SELECT doc_id, key, size, s, target, (floor(rate) + CASE WHEN {u} < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM mix_rows JOIN mix_rate USING (key) JOIN mix_seed USING (key))"""


SQL = f"WITH {sql()} SELECT doc_id, size, s AS source_size, target, (size * copies)::BIGINT AS taken FROM mix"
