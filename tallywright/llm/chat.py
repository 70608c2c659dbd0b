"""Collapse cumulative snapshots of conversations, then render what is left.

Logs often hold a conversation several times, each snapshot a few turns longer.
Every turn gets a hash of its number, role and text; the running sum of these
hashes is a rolling hash of each turn prefix. A conversation whose full hash is
a proper prefix of another one goes (anti-join), of equal ones the smallest id
stays. Hashes and sums are narrow rows; texts are shuffled once, to be rendered.

A conversation is cut into parts of consecutive turn numbers. Sums inside a
part and sums over parts make the running sum, so that a very long conversation
is no single group anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .common import load

PART_TURNS = 256
UNKNOWN = "unknown"
LOW = 0xFFFFFFFF
SUMS = ["n", "s0", "s1", "s2", "s3"]


def _keys(turns: DataFrame, part_turns: int) -> DataFrame:
    """``conv, conv_id, part, turn, role, text, h0, h1`` with nulls replaced; other columns are not read."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1))
    role, text = F.coalesce("role", F.lit(UNKNOWN)), F.coalesce("text", F.lit(""))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"),
        "conv_id",
        turn.alias("turn"),
        role.alias("role"),
        text.alias("text"),
    )
    return rows.select(
        "*",
        F.floor(F.col("turn") / part_turns).alias("part"),
        *[F.xxhash64(F.lit(seed), "turn", "role", "text").alias(f"h{seed}") for seed in (0, 1)],
    )


def _sums() -> list[Column]:
    """Sums of 32-bit pieces; as longs they cannot overflow below 2^31 turns."""
    pieces = [p for h in ("h0", "h1") for p in (F.col(h).bitwiseAND(LOW), F.shiftrightunsigned(F.col(h), 32))]
    return [F.lit(1).cast("long"), *pieces]


def prefix_hashes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation ``conv, conv_id, k0, k1`` of all its turns, and the distinct ``k0, k1`` of all proper prefixes."""
    rows = turns.select("conv", "conv_id", "part", "turn", "h0", "h1").distinct()
    rows = written(rows.withColumns(dict(zip(SUMS, _sums()))), "turn-hashes")
    parts = rows.groupBy("conv", "part").agg(*[F.sum(c).alias(f"p_{c}") for c in SUMS])
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        "conv",
        "part",
        *[F.coalesce(F.sum(f"p_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in SUMS],
        F.sum("p_n").over(Window.partitionBy("conv")).alias("turns"),
    )
    inner = Window.partitionBy("conv", "part").orderBy("turn", "h0", "h1").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("conv", "part", *[F.sum(c).over(inner).alias(f"r_{c}") for c in SUMS])
    running = running.join(bases, ["conv", "part"]).select(
        "turns", *[(F.col(f"b_{c}") + F.col(f"r_{c}")).alias(c) for c in SUMS]
    )
    hashes = [F.xxhash64(F.lit(seed), *SUMS).alias(f"k{seed}") for seed in (0, 1)]
    prefixes = running.where(F.col("n") < F.col("turns")).select(*hashes).distinct()
    whole = rows.groupBy("conv").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS])
    return whole.select("conv", "conv_id", F.col("n").alias("n_turns"), *hashes), prefixes


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv, conv_id, n_turns, n_copies`` of the conversations that stay."""
    whole, prefixes = prefix_hashes(turns)
    first = F.min(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id", "conv", "n_turns")).alias("first")
    distinct = whole.groupBy("k0", "k1").agg(first, F.count(F.lit(1)).alias("n_copies"))
    kept = distinct.join(prefixes, ["k0", "k1"], "left_anti")
    return written(kept.select("first.conv", "first.conv_id", "first.n_turns", "n_copies"), "maximal")


def collapse_and_render(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Rendered maximal conversations: ``conv_id, part, n_turns, n_copies, rendered``.

    ``turns`` has ``conv_id, turn, role, text``. One row per conversation and
    run of ``part_turns`` turn numbers (``part`` counts from 0), so most
    conversations are one row; ``n_turns`` counts the whole conversation,
    ``n_copies`` the logged conversations with exactly its turns.

    Defined results: rows that repeat conversation, turn, role and text count
    once; turns with the same number are ordered by their hash; a null turn
    sorts last; a null role renders as "unknown", a null text as empty; rows
    without ``conv_id`` form one conversation; an empty table gives no rows.
    """
    rows = _keys(turns, part_turns)
    kept = maximal_conversations(rows)
    wanted = rows.select("conv", "part").distinct().join(kept, "conv")
    wanted = written(wanted, "wanted-parts")
    piece = F.struct("turn", "h0", "h1", "role", "text")
    texts = rows.select("conv", "part", piece.alias("piece")).join(wanted, ["conv", "part"])
    parts = texts.groupBy("conv", "part").agg(
        F.array_sort(F.collect_set("piece")).alias("pieces"),
        *[F.first(c).alias(c) for c in ("conv_id", "n_turns", "n_copies")],
    )

    def render(x: Column) -> Column:
        return F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"], F.lit("<|im_end|>\n"))

    return parts.select(
        "conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("pieces", render), "").alias("rendered")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(load(spark, sf_dir, "conversations"))


SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '{UNKNOWN}') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n_turns, list(md5(turn || ':' || role || ':' || text) ORDER BY turn) AS l FROM t GROUP BY conv_id),
p AS (
  SELECT DISTINCT array_to_string(l[1:k], ',') AS s FROM (SELECT l, n_turns, unnest(range(1, n_turns)) AS k FROM c)),
m AS (
  SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies
  FROM (SELECT *, array_to_string(l, ',') AS s FROM c) WHERE s NOT IN (SELECT s FROM p) GROUP BY s)
SELECT m.conv_id, t.turn // {PART_TURNS} AS part, m.n_turns, m.n_copies,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM m JOIN t ON m.conv_id = t.conv_id GROUP BY m.conv_id, t.turn // {PART_TURNS}, m.n_turns, m.n_copies
"""
