"""Repair the structure of damaged conversations by cheapest edits.

A conversation of n rows is a lattice of (n + 1) x 4 nodes: how many rows are
done, and which roles may follow. Keeping, re-roling, deleting and inserting are
arcs with integer costs. The auction algorithm finds a shortest path: a path
grows from the origin along the arc of least cost plus price, and shrinks where
its last node's price can rise to that sum. The prices it ends with are dual
feasible, so exactly the arcs whose cost equals the price difference lie on
shortest paths; among these tight arcs the least letter is followed.

Conversations are cut into segments of consecutive rows. A segment is a small
matrix of costs between its first and last states; matrices are multiplied in a
tree (least sum instead of sum of products), costs to the end and entry states
come back down, and each segment is traced on its own. So a very long
conversation is no single group, except where its lines are hashed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..operators.sizing import join_key_stats
from ..session import written
from .common import SPACES, crc32_sql, load, shuffle_tasks

SEGMENT_ROWS, TREE_WIDTH = 64, 64
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
# Nothing yet, after "system", after "user", after "assistant".
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or re-roled row leads to, and its role.
FILLED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a kept row leads to, by its role's initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEVER = 1 << 40
#: What is left to pay at the end of a conversation.
DONE = (0, NEVER, NEVER, 0)
MUST_GO = "-"


def arcs_of(codes: str, ends: tuple[int, ...], last: bool) -> list[list[tuple[str, int, int]]]:
    """(letter, cost, node) of every node; node 4 * row + state, the sink last.

    ``codes`` has a character per row: the role's initial, as a capital where
    the row is truncated, or ``-`` where it must go. ``ends`` are the costs that
    follow each last state. Rows are inserted before a row, and after the last
    row only if the conversation ends there, so that no insertion counts twice.
    """
    n = len(codes)
    sink, arcs = 4 * (n + 1), []
    for i in range(n + 1):
        for state in range(4):
            out = []
            if i < n:
                code = codes[i]
                out.append(("D", DELETE, 4 * (i + 1) + state))
                if code != MUST_GO:
                    extra = TRUNCATED if code.isupper() else 0
                    kept = KEPT.get((state, code.lower()))
                    if kept is not None:
                        out.append(("K", extra, 4 * (i + 1) + kept))
                    out.append(("R", REROLE + extra, 4 * (i + 1) + FILLED[state]))
            elif ends[state] < NEVER:
                out.append(("", ends[state], sink))
            if i < n or last:
                out.append(("I", INSERT, 4 * i + FILLED[state]))
            arcs.append(out)
    return [*arcs, []]


def first_prices(codes: str, ends: tuple[int, ...]) -> list[int]:
    """Feasible prices: every row that must go or is truncated costs a deletion at least."""
    prices, left = [], min(ends)
    for code in ["k", *reversed(codes)]:
        left += DELETE * (code == MUST_GO or code.isupper())
        prices.append(left)
    return [p for p in reversed(prices) for _ in range(4)] + [0]


def auction(arcs: list, prices: list[int], origin: int, bound: int) -> int | None:
    """Length of a shortest path from ``origin`` to the last node, None if it is above ``bound``; raises ``prices``."""
    sink, path = len(arcs) - 1, [origin]
    while True:
        node = path[-1]
        least, to = NEVER, -1
        for _, cost, head in arcs[node]:
            if cost + prices[head] < least:
                least, to = cost + prices[head], head
        if prices[node] < least:
            # Contraction. A price above the bound cannot be on a path that counts.
            prices[node] = least
            if len(path) > 1:
                path.pop()
            elif least > bound:
                return None
        elif to == sink:
            return prices[origin]
        else:
            path.append(to)


def trace(arcs: list, prices: list[int], origin: int) -> tuple[str, int]:
    """Letters of the least shortest path from ``origin``, and its last node before the sink."""
    sink, reaches = len(arcs) - 1, reaching(arcs, prices)
    letters, node = [], origin
    while True:
        letter, head = min((x, head) for x, cost, head in arcs[node] if reaches[head] and prices[node] == cost + prices[head])
        if head == sink:
            return "".join(letters), node
        letters.append(letter)
        node = head


@lru_cache(maxsize=20_000)
def solve(codes: str, ends: tuple[int, ...], last: bool, entry: int) -> tuple[str, int, int] | None:
    """(letters, cost inside the segment, last state) from state ``entry``; None without a path."""
    arcs, prices = arcs_of(codes, ends, last), first_prices(codes, ends)
    # No shortest path pays more than deleting all rows and inserting a pair, besides what follows.
    worst = max((e for e in ends if e < NEVER), default=0)
    total = auction(arcs, prices, entry, DELETE * len(codes) + 2 * INSERT + worst)
    if total is None:
        return None
    letters, node = trace(arcs, prices, entry)
    return letters, total - ends[node % 4], node % 4


@lru_cache(maxsize=2_000)
def costs_between(codes: str, last: bool) -> list[int]:
    """The 16 costs from each first state to each last state."""
    found = [NEVER] * 16
    for to in range(4):
        ends = tuple(0 if state == to else NEVER for state in range(4))
        arcs, prices = arcs_of(codes, ends, last), first_prices(codes, ends)
        reaches = reaching(arcs)
        for origin in range(4):
            if reaches[origin]:
                # Prices stay feasible, so each origin goes on where the one before stopped.
                found[4 * origin + to] = auction(arcs, prices, origin, NEVER)
    return found


def reaching(arcs: list, prices: list[int] | None = None) -> list[bool]:
    """Which nodes reach the last one, over tight arcs only if ``prices`` are given."""
    sink = len(arcs) - 1
    found = [False] * sink + [True]
    for row in range(sink - 4, -1, -4):
        # Insertions stay in a row of nodes, so a row is looked at until nothing changes.
        for _ in range(3):
            for node in range(row, row + 4):
                found[node] = found[node] or any(
                    found[head] and (prices is None or prices[node] == cost + prices[head]) for _, cost, head in arcs[node]
                )
    return found


def then(costs: list[int], ends: list[int]) -> list[int]:
    """Costs to the end from each first state of a segment, given those from its last states."""
    return [min(min(costs[4 * a + b] + ends[b] for b in range(4)), NEVER) for a in range(4)]


def _fold_costs(parts: list[list[int]]) -> list[int]:
    total = parts[0]
    for part in parts[1:]:
        total = [min(min(total[4 * a + k] + part[4 * k + b] for k in range(4)), NEVER) for a in range(4) for b in range(4)]
    return total


def _spread_ends(given: list[int], parts: list[list[int]]) -> list[list[int]]:
    found = []
    for part in reversed(parts):
        found.append(given)
        given = then(part, given)
    return found[::-1]


def _fold_moves(parts: list[list[int]]) -> list[int]:
    return [_spread_entry([state], [*parts, []])[-1][0] for state in range(4)]


def _spread_entry(given: list[int], parts: list[list[int]]) -> list[list[int]]:
    found, state = [], given[0]
    for part in parts:
        found.append([state])
        state = part[state] if part and state >= 0 else -1
    return found


Fold = Callable[[list[list[int]]], list[int]]


def _levels(base: DataFrame, fold: Fold) -> list[DataFrame]:
    """``conv, seg, value`` folded in groups of neighbours until each conversation has one row."""
    levels = [written(base, "tree")]
    while levels[-1].agg(F.max("seg")).first()[0] > 0:

        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("seg")
            value = fold([[int(x) for x in v] for v in group["value"]])
            return pd.DataFrame({"conv": group["conv"][:1], "seg": group["up"][:1], "value": [value]})

        parents = levels[-1].withColumn("up", F.floor(F.col("seg") / TREE_WIDTH)).groupBy("conv", "up")
        levels.append(written(parents.applyInPandas(run, "conv string, seg long, value array<long>"), "tree"))
    return levels


def _handed_down(levels: list[DataFrame], first: tuple[int, ...], spread: Callable) -> DataFrame:
    """``conv, seg, given`` of the lowest level: what comes from the neighbours, from ``first`` at the top."""
    given = levels[-1].select("conv", "seg", F.array(*[F.lit(x).cast("long") for x in first]).alias("given"))
    for level in reversed(levels[:-1]):

        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("seg")
            parts = [[int(x) for x in v] for v in group["value"]]
            found = spread([int(x) for x in group["given"].iloc[0]], parts)
            return pd.DataFrame({"conv": group["conv"], "seg": group["seg"], "given": found})

        above = given.withColumnRenamed("seg", "up")
        children = level.withColumn("up", F.floor(F.col("seg") / TREE_WIDTH)).join(above, ["conv", "up"])
        given = written(
            children.groupBy("conv", "up").applyInPandas(run, "conv string, seg long, given array<long>"), "tree-down"
        )
    return given


def _mapped(segments: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``conv, seg`` and what ``function`` gives for each row."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [function(row) for row in frame.itertuples(index=False)]
            found = pd.DataFrame(rows, columns=names)
            found.insert(0, "seg", frame["seg"].to_numpy())
            found.insert(0, "conv", frame["conv"].to_numpy())
            yield found

    return segments.mapInPandas(run, f"conv string, seg long, {schema}")


def _moves(row) -> tuple[list[int]]:
    found = [solve(row.codes, tuple(int(x) for x in row.ends), row.last, state) for state in range(4)]
    return ([-1 if f is None else f[2] for f in found],)


def _edits(row) -> tuple[str, int, int, int]:
    letters, cost, _ = solve(row.codes, tuple(int(x) for x in row.ends), row.last, int(row.entry))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(row.initials, row.initials[1:]))
    return letters, int(row.entry), cost, illegal


def cheapest_edits(segments: DataFrame) -> DataFrame:
    """``conv, seg, letters, entry, cost, illegal`` for stored segments ``conv, seg, codes, initials``."""
    lasts = segments.groupBy("conv").agg(F.max("seg").alias("last_seg"))
    marked = written(segments.join(lasts, "conv").withColumn("last", F.col("seg") == F.col("last_seg")), "segments")
    ends = F.array(*[F.lit(x).cast("long") for x in DONE]).alias("ends")
    fields = ["conv", "seg", "codes", "initials", "last"]
    ready = marked.where("last_seg = 0").select(*fields, ends, F.lit(START).alias("entry"))
    cut = marked.where("last_seg > 0").select(*fields)
    if not cut.isEmpty():
        costs = _mapped(cut, lambda r: (costs_between(r.codes, r.last),), "value array<long>")
        ends = _handed_down(_levels(costs, _fold_costs), DONE, _spread_ends).withColumnRenamed("given", "ends")
        ended = written(cut.join(ends, ["conv", "seg"]), "segment-ends")
        moves = _mapped(ended, _moves, "value array<long>")
        entry = _handed_down(_levels(moves, _fold_moves), (START,), _spread_entry)
        entry = entry.select("conv", "seg", F.get("given", 0).cast("int").alias("entry"))
        ready = ready.unionByName(ended.join(entry, ["conv", "seg"]))
    return _mapped(ready, _edits, "letters string, entry int, cost long, illegal long")


def _text(column: str, given: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" ")).alias(given)


def damaged(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, text, copy`` after the damage that the rows' hashes decide."""
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.concat(_text("conv_id", "a"), F.lit(":"), _text("turn", "b")).alias("name"),
        _text("role", "role"),
        _text("text", "text"),
    ).withColumn("kind", F.crc32(F.col("name").cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("kind != 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        copies.alias("copy"),
    )


def found_faults(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows as ``conv, pos, role, text``, stored, and narrow ones ``conv, turn, pos, seg, initial, fault``."""
    ordered = rows.withColumn("order", F.coalesce("turn", F.lit(-(1 << 63)))).withColumn("id", F.monotonically_increasing_id())
    stored = written(number_rows(ordered, ["conv"], ["order", "role", "text", "id"], "pos").drop("order", "id", "copy"), "turns")
    solid = F.rtrim("text", F.lit(SPACES))
    narrow = written(
        stored.select(
            "conv", "turn", "pos", "role",
            F.floor((F.col("pos") - 1) / segment_rows).alias("seg"),
            F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
            (solid == "").alias("blank"),
            (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"),
        ),
        "turn-marks",
    )
    keys = ["conv", "role", "digest"]
    repeated = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).where("n > 1")
    later = join_key_stats(narrow.select(*keys, "pos"), repeated, keys, "n").where("pos > first")
    later = later.select("conv", "pos", F.lit(True).alias("again"))
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    marks = narrow.join(later, ["conv", "pos"], "left")
    return stored, written(marks.select("conv", "turn", "pos", "seg", initial.alias("initial"), fault.alias("fault")), "faults")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its rows in order, each segment's edits ahead of its rows."""
    conv = digest = state = letters = None
    audit, at, empty = [], 0, True

    def result():
        names = ["conv", "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (conv, "".join(audit), digest.hexdigest())], names)

    def line(role, text):
        nonlocal empty
        if not empty:
            digest.update(b"\n")
        digest.update(f"{role}:{text}".encode())
        empty = False

    def insertions():
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            state, at = FILLED[state], at + 1
            line(ROLES[state], "")

    for batch in batches:
        for row in batch.to_pylist():
            if row["conv"] != conv:
                if conv is not None:
                    yield result()
                conv, digest, audit, empty = row["conv"], hashlib.sha256(), [], True
            if row["letters"] is not None:
                letters, state, at = row["letters"], row["entry"], 0
                audit.append(letters)
            else:
                letter, at = letters[at], at + 1
                if letter == "K":
                    state = KEPT[state, row["role"][0]]
                    line(row["role"], row["text"])
                elif letter == "R":
                    state = FILLED[state]
                    line(ROLES[state], row["text"])
            insertions()
    if conv is not None:
        yield result()


def repair(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per ``conv_id`` of ``turns`` (``conv_id, turn, role, text``), damaged first and repaired by cheapest edits.

    ``gaps, blank, duplicate, truncated, illegal, cost`` as numbers, ``audit``
    the letters of the edits (K keep, R re-role, D delete, I insert) and
    ``repaired_sha256`` the hash of the repaired lines.

    Defined results: a null role, text or part of a row's name reads as one
    space; null turns come first; rows of one turn are ordered by role, then
    text; rows without ``conv_id`` form one conversation; a conversation that
    loses all rows has zeros, no letters and the hash of nothing; an empty
    table gives no rows; other columns are ignored.
    """
    rows, marks = found_faults(damaged(turns), segment_rows)
    code = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper("initial"))
    piece = F.struct("pos", F.coalesce(code, "initial").alias("code"), "initial")
    segments = marks.groupBy("conv", "seg").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    segments = written(
        segments.select(
            "conv", "seg", F.array_join("pieces.code", "").alias("codes"), F.array_join("pieces.initial", "").alias("initials")
        ),
        "segments",
    )
    edits = written(cheapest_edits(segments), "edits")
    # Neighbours across segments.
    one = segments.select("conv", (F.col("seg") + 1).alias("seg"), F.substring("initials", -1, 1).alias("before"))
    pair = F.concat("before", F.substring("initials", 1, 1))
    across = segments.join(one, ["conv", "seg"]).select("conv", "seg", (~pair.isin("su", "ua", "au")).cast("long").alias("across"))
    paid = edits.join(across, ["conv", "seg"], "left").groupBy("conv").agg(
        F.sum("cost").alias("cost"), F.sum(F.col("illegal") + F.coalesce("across", F.lit(0))).alias("illegal")
    )
    counts = marks.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")],
    )
    ahead = edits.select("conv", (F.col("seg") * segment_rows + 1).alias("pos"), F.lit(0).alias("kind"), "letters", "entry")
    lines = ahead.unionByName(rows.select("conv", "pos", F.lit(1).alias("kind"), "role", "text"), allowMissingColumns=True)
    dealt = lines.repartition(shuffle_tasks(turns.sparkSession), "conv").sortWithinPartitions("conv", "pos", "kind")
    rendered = dealt.mapInArrow(_rendered, "conv string, audit string, repaired_sha256 string")
    ids = turns.select(
        F.col("conv_id"), F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv")
    ).distinct()
    joined = ids.join(counts, "conv", "left").join(paid, "conv", "left").join(rendered, "conv", "left")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(load(spark, sf_dir, "conversations"))


def _step(cost: str, letter: str, line: str | None, rest: str) -> str:
    """SQL: an edit ahead of the best edits ``rest``."""
    text = f"{rest}.t" if line is None else f"{line} || CASE {rest}.t WHEN '' THEN '' ELSE chr(10) || {rest}.t END"
    return f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a, 't': {text}}}"


def _options(state: int) -> str:
    """SQL: the best edits from ``state`` that start with the row ``x`` itself; ``s0`` to ``s3`` follow it."""
    extra = f"CASE fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END"
    filled = FILLED[state]
    stays = [_step(f"{REROLE} + {extra}", "R", f"('{ROLES[filled]}:' || text)", f"s{filled}")]
    for (start, initial), to in KEPT.items():
        if start == state:
            kept = _step(extra, "K", "(role || ':' || text)", f"s{to}")
            stays.append(f"CASE WHEN initial = '{initial}' THEN {kept} END")
    delete = _step(str(DELETE), "D", None, f"s{state}")
    return f"list_min([{delete}, " + ", ".join(f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {x} END" for x in stays) + "])"


def _insert(role: str, rest: str) -> str:
    return _step(str(INSERT), "I", f"'{role}:'", rest)


_NONE, _END = f"{{'c': {NEVER}::BIGINT, 'a': '', 't': ''}}", "{'c': 0::BIGINT, 'a': '', 't': ''}"
_PAIR = f"{{'c': {2 * INSERT}::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}}"
_HALF = f"{{'c': {INSERT}::BIGINT, 'a': 'I', 't': 'assistant:'}}"
_KIND = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
SQL = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_KIND} % 20 AS kind FROM conversations),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, (VALUES (0), (1)) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS solid FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM p),
x AS (
  SELECT conv_id, turn, pos, role, text, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair,
    CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated'
      ELSE 'none' END AS fault FROM n),
r AS (
  SELECT conv_id, max(pos) AS pos, {_END} AS s0, {_NONE} AS s1, {_NONE} AS s2, {_END} AS s3, false AS done FROM x GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos - 1, list_min([n0, {_insert('user', 'b2')}]), list_min([n1, {_insert('user', 'b2')}]), b2,
    list_min([n3, {_insert('user', 'n2')}]), pos = 1
  FROM (SELECT *, list_min([n2, {_insert('assistant', 'n3')}]) AS b2 FROM (
    SELECT r.conv_id, r.pos, {_options(0)} AS n0, {_options(1)} AS n1, {_options(2)} AS n2, {_options(3)} AS n3
    FROM (SELECT conv_id, pos, done, s0, CASE WHEN s1.c >= {NEVER} THEN {_PAIR} ELSE s1 END AS s1,
      CASE WHEN s2.c >= {NEVER} THEN {_HALF} ELSE s2 END AS s2, s3 FROM r) r
    JOIN x ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.pos = r.pos WHERE NOT r.done))),
b AS (SELECT conv_id, s0.c AS cost, s0.a AS audit, sha256(s0.t) AS sha FROM r WHERE done),
t AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
    count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
"""
