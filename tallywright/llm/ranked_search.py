"""Ranked lexical search with range-maximum tables over posting lists.

Documents are dealt into shards. A shard holds, for every term that an item
asks for, the list of its documents with the integer impact of the term on each.
A sparse table per list answers which document of a range has the highest
impact. A search keeps intervals of documents: the sum of the lists' highest
impacts in an interval bounds the score of each of its documents. The best
intervals are taken first; their document of highest impact is scored exactly
and splits the interval in two. Intervals whose bound is below the k-th best
score so far are never opened.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import top_rows
from ..operators.sizing import is_small, join_key_stats
from ..session import written
from .common import byte_texts, load, slices

#: Maximal runs of ASCII digits, letters and all other code points, as UTF-8 bytes after lower-casing A-Z.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
#: Postings a shard aims at, and items that are searched for in one group.
SHARD_POSTINGS = 600_000
BLOCK_ITEMS = 256
#: Intervals opened at a time, at first and at most.
FIRST_OPEN, MOST_OPEN = 16, 512
SLICE_BYTES = 4 << 20
LAST = (1 << 63) - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            terms, counts, ends, totals = [], [], [0], []
            for text in byte_texts(batch.column("text")):
                found = Counter(TERM.findall(text.lower()))
                terms.extend(found)
                counts.extend(found.values())
                ends.append(len(terms))
                totals.append(found.total())
            pairs = pa.StructArray.from_arrays(
                [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["term", "tf"]
            )
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(totals, pa.int64()), lists], ["row", "id", "n", "terms"]
            )


def term_counts(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id, n, terms``: a number per row, its id, all its terms with repeats, and the distinct ones with their counts."""
    named = table.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )
    return named.mapInArrow(_counted, "row long, id long, n long, terms array<struct<term: string, tf: long>>")


class Postings:
    """The posting lists of a shard: entries sorted by term and document, with one sparse table of maxima."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, term))
        term, self.doc, self.impact, self.n_docs = term[order], doc[order], impact[order], n_docs
        self.key = term * n_docs + self.doc
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        longest = int(np.diff(self.start).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for i in range(1, longest.bit_length()):
            self.log[1 << i :] = i
        best = np.arange(len(doc), dtype=np.int32)
        table, span = [best], 1
        while 2 * span <= longest:
            # Entries near the end of a list look into the next one; no range that is asked for reaches there.
            last = table[-1]
            other = np.concatenate([last[span:], last[-span:]])
            table.append(np.where(self.impact[last] >= self.impact[other], last, other))
            span *= 2
        self.table = np.stack(table)

    def highest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of highest impact in each range [low, high) and that impact, which is 0 for empty ranges."""
        filled = high > low
        a, b = np.where(filled, low, 0), np.where(filled, high, 1)
        level = self.log[b - a]
        x, y = self.table[level, a], self.table[level, b - (1 << level)]
        best = np.where(self.impact[x] >= self.impact[y], x, y)
        return best, np.where(filled, self.impact[best], 0)

    def search(self, terms: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``k`` best, equal scores by ascending ``ids``; only scores above 0."""
        low, high = self.start[terms][None, :], self.start[terms + 1][None, :]
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        best, value = self.highest(low, high)
        bound = value.sum(axis=1)
        split = self.doc[best[np.arange(1), value.argmax(axis=1)]]
        floor, size = 1, FIRST_OPEN
        while True:
            live = bound >= floor
            if not live.any():
                return found, scores
            if not live.all():
                low, high, bound, split = low[live], high[live], bound[live], split[live]
            if len(bound) > size:
                order = np.argpartition(-bound, size - 1)
                now, rest = order[:size], order[size:]
            else:
                now, rest = np.arange(len(bound)), np.empty(0, np.int64)
            target = terms * self.n_docs + split[now][:, None]
            at = np.searchsorted(self.key, target)
            hit = self.key[np.minimum(at, len(self.key) - 1)] == target
            score = np.where(hit, self.impact[np.minimum(at, len(self.key) - 1)], 0).sum(axis=1)
            found, scores = np.concatenate([found, split[now]]), np.concatenate([scores, score])
            order = np.lexsort((ids[found], -scores))[:k]
            found, scores = found[order], scores[order]
            if len(scores) == k:
                floor = max(floor, int(scores[-1]))
            below, above = np.concatenate([low[now], at + hit]), np.concatenate([at, high[now]])
            best, value = self.highest(below, above)
            sums = value.sum(axis=1)
            good = np.nonzero(sums >= floor)[0]
            picked = self.doc[best[good, value[good].argmax(axis=1)]] if len(good) else np.empty(0, np.int64)
            low, high = np.concatenate([low[rest], below[good]]), np.concatenate([high[rest], above[good]])
            bound, split = np.concatenate([bound[rest], sums[good]]), np.concatenate([split[rest], picked])
            size = min(2 * size, MOST_OPEN)


def _search_group(k: int):
    def run(group: pa.Table) -> pa.Table:
        columns = {c: group.column(c).to_numpy() for c in ("row", "term_no", "score", "is_item")}
        ids = pa.compute.fill_null(group.column("id"), LAST).to_numpy()
        asks = columns["is_item"]
        names, term = np.unique(columns["term_no"], return_inverse=True)
        has = ~asks
        out = {"item": [], "row": [], "id": [], "score": []}
        if has.any():
            rows, first, doc = np.unique(columns["row"][has], return_index=True, return_inverse=True)
            doc_ids = ids[has][first]
            # Neighbours share their strongest term and are of like length, so that intervals have tight bounds.
            impact = columns["score"][has]
            by_doc = np.lexsort((term[has], -impact, doc))
            strongest = term[has][by_doc][np.searchsorted(doc[by_doc], np.arange(len(rows)))]
            total = np.bincount(doc, weights=impact)
            place = np.empty(len(rows), np.int64)
            place[np.lexsort((doc_ids, total, strongest))] = np.arange(len(rows))
            moved = np.argsort(place)
            lists = Postings(term[has], place[doc], impact, len(names), len(rows))
            items = columns["row"][asks]
            order = np.argsort(items, kind="stable")
            wanted, starts = np.unique(items[order], return_index=True)
            for item, terms in zip(wanted, np.split(term[asks][order], starts[1:])):
                terms = terms[lists.start[terms + 1] > lists.start[terms]]
                if len(terms):
                    docs, scores = lists.search(terms, doc_ids[moved], k)
                    out["item"].append(np.full(len(docs), item))
                    out["row"].append(rows[moved[docs]])
                    out["id"].append(doc_ids[moved[docs]])
                    out["score"].append(scores)
        return pa.table({c: pa.array(np.concatenate([np.empty(0, np.int64), *parts]), pa.int64()) for c, parts in out.items()})

    return run


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shard_postings: int = SHARD_POSTINGS,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` highest-scoring documents of each item.

    The index covers all documents; of its lists, those that an item asks for
    are built. Items are searched for in blocks of ``block_items``, each against
    every shard.

    Defined results: null and empty texts have no terms, are not counted and
    match nothing; a repeated document row ranks as often as it occurs; equal
    scores go by ascending id, a null id last; a repeated or null item id is
    searched for once per row; items or documents that are empty tables give no
    rows. Ids are integers.
    """
    counted = written(term_counts(docs, id_col, text_col), "search-terms")
    n_docs, n_terms = counted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = written(
        term_counts(items, item_col, item_text_col).select("row", "id", F.inline("terms")).drop("tf"), "search-items"
    )
    n_items = asked.select("row").distinct().count()
    blocks = max(-(-n_items // block_items), 1)
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    words = asked.select("term", block).groupBy("term").agg(F.collect_set("block").alias("blocks"))
    words = written(words.withColumn("term_no", F.monotonically_increasing_id()), "search-words")

    held = counted.select("row", "id", "n", F.inline("terms"))
    if is_small(words):
        hits = held.join(F.broadcast(words.select("term", "term_no")), "term")
    else:
        frequency = held.join(words.select("term"), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        hits = join_key_stats(held, frequency.join(words.select("term", "term_no"), "term"), ["term"], "df")
    hits = written(hits.select("row", "id", "n", "term_no", "tf"), "search-hits")
    # The weight of a term; its impact on a document is an integer.
    frequency = hits.groupBy("term_no").agg(F.count(F.lit(1)).alias("df"))
    ratio = F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weighted = written(
        frequency.select("term_no", "df", F.floor(1000 * F.log(ratio)).cast("long").alias("w"))
        .where("w > 0")
        .join(words.select("term_no", "blocks"), "term_no"),
        "search-weights",
    )
    postings = join_key_stats(hits, weighted, ["term_no"], "df", stored=True)
    length = F.expr(f"100 - 50 + ((50 * n * {n_docs}L) div {max(n_terms, 1)}L)")
    postings = postings.withColumn("m", length).withColumn("score", F.expr("w * ((1000000000L * tf) div (1000 * tf + 20 * m))"))
    total = weighted.agg(F.coalesce(F.sum(F.col("df") * F.size("blocks")), F.lit(0))).first()[0]
    shards = max(-(-total // (shard_postings * blocks)), 1)
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    found = postings.select(shard, F.explode("blocks").alias("block"), "row", "id", "term_no", "score", F.lit(False).alias("is_item"))
    wanted = asked.join(words.select("term", "term_no"), "term").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        block, "row", "id", "term_no", F.lit(0).cast("long").alias("score"), F.lit(True).alias("is_item"),
    )
    groups = found.unionByName(wanted).repartition(max(shards * blocks, 1), "shard", "block").groupBy("shard", "block")
    best = groups.applyInArrow(_search_group(k), "item long, row long, id long, score long")
    order = [F.col("score").desc(), F.col("id"), F.col("row")]
    ranked = top_rows(best, ["item"], order, k)
    names = asked.select(F.col("row").alias("item"), F.col("id").alias("item_id")).distinct()
    place = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return (
        ranked.withColumn("rank", place)
        .join(names, "item")
        .select("item_id", "rank", F.nullif("id", F.lit(LAST)).alias("doc_id"), "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(load(spark, sf_dir), load(spark, sf_dir, "benchmark"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTERS}') AS t FROM documents),
s AS (SELECT count(*)::BIGINT AS big_n, coalesce(sum(len(t)), 0)::BIGINT AS big_l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTERS}')) AS term
  FROM benchmark),
f AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, big_n),
i AS (SELECT item_id, doc_id,
    w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))) AS impact
  FROM q JOIN f USING (term) JOIN p USING (term), s),
r AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM i GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= {TOP}
"""
