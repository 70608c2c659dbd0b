"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles gives two signature values, the smallest and
the largest hash, so half as many hash evaluations fill a signature. Signatures
are cut into bands; documents that agree in a band meet in a bucket.

Candidates never multiply within a bucket:

1. documents with equal shingle sets are one class from the start,
2. each class is checked against the smallest class of its buckets,
3. in ROUNDS rounds, classes outside their bucket's largest component are checked
   against some member of that component, another one in each round,
4. classes of buckets that still hold several components are joined exactly:
   two sets that are similar enough share one of their rarest shingles (prefix
   filter), early enough for the rest to suffice (positional filter), and
   classes of one component are not compared.

The rounds only save work: step 4 finds every link that is left in a bucket.
Bands say little about sets of few shingles, so these take part in step 4
whether or not they share a bucket with any other.

Every link is confirmed on the full sets; components come from the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from ..session import small_batches, written
from .common import byte_texts, load, numbered, sliced
from .components import component_labels, labelled, with_links
from .segments import NO_ID, gram_hashes, identified, mixed, split_documents

SHINGLE_WORDS = 5
PERCENT = 75
#: 30 bands of 4 values: a pair with i of u shingles in common shares no band with the probability
#: (1 - (i (i - 1) / (u (u - 1))) ** 2) ** 30, once in 73,000 times for 33 of 44, in 90,000 for large sets at 0.75.
BANDS, BAND_VALUES = 30, 4
#: Links of sets with fewer shingles do not depend on bands.
SMALL_SET = 32
ROUNDS = 1
SLICE_BYTES = 1 << 20
BASE_SCHEMA = "doc_id long, twin long, row long, n_shingles long, d0 long, d1 long, bands array<long>"


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; a text of fewer words is one shingle, one without words has none."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.fromiter((xxh3_64_intdigest(w) for x in words for w in x), np.uint64, int(counts.sum()))
    grams = gram_hashes(codes, size)
    stops = np.cumsum(counts)
    sets = []
    for n, stop in zip(counts.tolist(), stops.tolist()):
        if n >= size:
            sets.append(np.unique(grams[stop - n : stop - size + 1]))
        else:
            sets.append(mixed(gram_hashes(codes[stop - n : stop], n) + np.uint64(n)) if n else np.empty(0, np.uint64))
    return sets


class MinMax:
    """Band keys from the smallest and largest value under each permutation."""

    def __init__(self, bands: int, values: int, seed: int = 11):
        draws = np.random.default_rng(seed)
        n = bands * values // 2
        self.bands, self.values = bands, values
        self.factors = draws.integers(0, 1 << 64, n, np.uint64) | np.uint64(1)
        self.offsets = draws.integers(0, 1 << 64, n, np.uint64)
        self.weights = draws.integers(0, 1 << 64, values, np.uint64) | np.uint64(1)
        self.salts = draws.integers(0, 1 << 64, bands, np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per (non-empty) set: smallest and largest value of each permutation, side by side."""
        every = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.empty((len(sets), 2 * len(self.factors)), np.uint64)
        for k, (factor, offset) in enumerate(zip(self.factors, self.offsets)):
            values = every * factor + offset
            out[:, 2 * k] = np.minimum.reduceat(values, starts)
            out[:, 2 * k + 1] = np.maximum.reduceat(values, starts)
        return out

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        rows = self.signatures(sets).reshape(len(sets), self.bands, self.values)
        return mixed((mixed(rows) * self.weights).sum(axis=2, dtype=np.uint64) + self.salts).view(np.int64)


def _sketches(rows: DataFrame, size: int, bands: int, values: int) -> DataFrame:
    """Per document the number of shingles, a 128-bit digest of the set, and the band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinMax(bands, values)
        for batch in sliced(batches, "text", SLICE_BYTES):
            sets = shingle_sets(byte_texts(batch.column("text")), size)
            digests = [xxh3_128_intdigest(s.tobytes()) for s in sets]
            halves = [np.array([(d >> k) & ((1 << 64) - 1) for d in digests], np.uint64).view(np.int64) for k in (0, 64)]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = [None] * len(sets)
            if full:
                for i, row in zip(full, hashing.keys([sets[i] for i in full])):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "twin", "row")],
                    pa.array([len(s) for s in sets], pa.int64()),
                    *map(pa.array, halves),
                    pa.array([k if k is not None else [] for k in keys], pa.list_(pa.int64())),
                ],
                names=["doc_id", "twin", "row", "n_shingles", "d0", "d1", "bands"],
            )

    return rows.mapInArrow(sketch, BASE_SCHEMA)


def _sets_of(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` for the documents of ``wanted`` (``node, doc_id, twin``)."""
    maybe, _ = split_documents(rows, wanted)
    texts = maybe.join(wanted, ["doc_id", "twin"]).select("node", "text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            sets = [s.view(np.int64) for s in shingle_sets(byte_texts(batch.column("text")), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    return texts.mapInArrow(shingles, "node long, shingles array<long>").dropDuplicates(["node"])


def similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return shared * 100 >= (a + b - shared) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose sets are similar enough; sizes that rule it out are not compared."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"), F.size("shingles").alias("nu"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"), F.size("shingles").alias("nv"))
    sizes = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent
    both = pairs.join(left, "u").join(right, "v")
    shared = F.when(sizes, F.size(F.array_intersect("su", "sv"))).otherwise(0)
    return both.where(similar(shared, F.col("nu"), F.col("nv"), percent)).select("u", "v")


def _prefix_pairs(open_nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may be similar: they share a shingle of their prefixes.

    ``open_nodes`` has ``node, label``. Shingles are ordered by how few of the
    open sets hold them; two sets similar by ``percent`` share one of the first
    n - ceil(n * percent / 100) + 1. A shingle's most frequent component is not
    compared with itself, nor is any other.
    """
    rows = sets.join(open_nodes, "node").select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    rows = written(rows, "open-shingles")
    counts = written(rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")), "open-counts")
    ranked = rows.join(counts, "s").withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("df", "s")))
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    kept = ranked.where((F.col("at") <= reach) & (F.col("df") > 1))
    prefix = written(kept.select("s", "node", "label", "n", (F.col("n") - F.col("at")).alias("after")), "prefixes")
    per_label = prefix.groupBy("s", "label").agg(F.count(F.lit(1)).alias("k"))
    major = per_label.groupBy("s").agg(F.max(F.struct("k", "label"))["label"].alias("major"), F.count(F.lit(1)).alias("labels"))
    major = written(major.where("labels > 1").drop("labels"), "mixed-shingles")
    mixed_rows = prefix.join(major, "s")
    minor = mixed_rows.where("label != major").select("s", *[F.col(c).alias(f"{c}_u") for c in ("node", "label", "n", "after")])
    every = mixed_rows.select("s", *[F.col(c).alias(f"{c}_v") for c in ("node", "label", "n", "after")])
    # For the first shingle that two sets share, it and all that follow must be enough for the intersection.
    enough = (F.least("after_u", "after_v") + 1) * (100 + percent) >= (F.col("n_u") + F.col("n_v")) * percent
    sizes = F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent
    same = minor["s"] == every["s"]
    pairs = minor.join(every, same & (F.col("label_u") != F.col("label_v")) & sizes & enough)
    pairs = pairs.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _open_keys(named: DataFrame) -> DataFrame:
    """Keys of buckets (``key, label``) that hold several components."""
    return named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("key")


def _open_pairs(buckets: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Each class outside its bucket's largest component, with one member of that component."""
    named = written(labelled(buckets.select("key", "node"), labels, "node", "label"), "open-members")
    order = F.struct(F.xxhash64(F.lit(turn), "key", "node").alias("draw"), "node")
    parts = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("some"))
    largest = parts.groupBy("key").agg(F.max(F.struct("n", "label", "some")).alias("major"), F.count(F.lit(1)).alias("k"))
    largest = written(largest.where("k > 1").select("key", "major"), "open-buckets")
    pairs = named.join(largest, "key").where(F.col("label") != F.col("major.label"))
    other = F.col("major.some.node")
    return pairs.select(F.least("node", other).alias("u"), F.greatest("node", other).alias("v")).distinct()


def _links(buckets: DataFrame, sets: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """Component labels from the links among the members of buckets (``key, node, leader``) and among ``short`` (``node``)."""
    others = buckets.where("node != leader")
    first = others.groupBy("node").agg(F.min("leader").alias("leader"))
    pairs = first.select(F.col("leader").alias("u"), F.col("node").alias("v"))
    links = written(_confirmed(pairs, sets, percent), "links-first")
    labels = written(component_labels(links), "labels-first")

    for turn in range(ROUNDS):
        pairs = written(_open_pairs(buckets, labels, turn), "pairs-round")
        if pairs.isEmpty():
            break
        found = written(_confirmed(pairs, sets, percent), "links-round")
        if found.isEmpty():
            break
        labels = written(with_links(labels, found), "labels-round")

    named = labelled(buckets.select("key", "node"), labels, "node", "label")
    open_keys = _open_keys(named)
    in_open = named.join(open_keys, "key", "left_semi").select("node", "label")
    in_open = in_open.unionByName(labelled(short, labels, "node", "label").select("node", "label"))
    open_nodes = written(in_open.distinct(), "open-nodes")
    if not open_nodes.isEmpty():
        pairs = written(_prefix_pairs(open_nodes, sets, percent), "pairs-third")
        labels = written(with_links(labels, _confirmed(pairs, sets, percent)), "labels-third")
    return labels


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    band_values: int = BAND_VALUES,
    row_col: str | None = None,
) -> DataFrame:
    """Components of documents linked by the similarity of their shingle sets.

    Two documents are linked if the intersection of their sets of distinct
    ``shingle_words``-word shingles is at least ``percent`` of the union.
    Returns ``doc_id, n_shingles, component_id, kept, row`` per input row;
    ``component_id`` is the smallest id reachable and ``kept`` marks its row,
    exactly one of a component. ``row_col`` names a column of unique row numbers.

    Defined results: a null text is empty; documents without words are linked
    with nothing; a null id counts as the largest and is returned as null; of
    rows that repeat a component's smallest id the first stays; an empty table
    gives no rows. Ids must be integers. Other columns are not read.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = identified(docs, id_col, text_col)
    sketches = _sketches(identified(docs, id_col, text_col, row.alias("row")), shingle_words, bands, band_values)
    with small_batches(docs.sparkSession):
        base = written(sketches, "sketches")
    place = F.struct("doc_id", "row", "twin")
    classes = base.where("n_shingles > 0").groupBy("d0", "d1").agg(
        F.min(place).alias("place"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "d0", "d1", "place.*", "n", "bands")
    classes = written(classes, "classes")
    members = classes.select("node", F.explode("bands").alias("key"))
    leaders = members.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n"))
    leaders = written(leaders.where("n > 1").drop("n"), "buckets")
    buckets = written(members.join(leaders, "key"), "members")
    # A set similar to one of fewer than SMALL_SET shingles has fewer than SMALL_SET * 100 / percent.
    short = classes.where(F.col("n") * percent < SMALL_SET * 100).select("node")
    compared = buckets.select("node").unionByName(short).distinct()
    wanted = written(classes.join(compared, "node", "left_semi").select("node", "doc_id", "twin"), "compared")
    with small_batches(docs.sparkSession):
        sets = written(_sets_of(rows, wanted, shingle_words), "shingle-sets")
    labels = _links(buckets, sets, short, percent)

    named = labelled(classes.select("node", "d0", "d1", "doc_id", "row"), labels, "node", "label")
    named = written(named, "class-labels")
    smallest = named.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    of_class = written(named.join(written(smallest, "component-ids"), "label").select("d0", "d1", "first"), "class-components")
    result = base.select("doc_id", "row", "n_shingles", "d0", "d1")
    linked = result.where("n_shingles > 0").join(of_class, ["d0", "d1"])
    alone = result.where("n_shingles = 0").withColumn("first", F.struct("doc_id", "row"))
    every = linked.unionByName(alone).withColumn("component_id", F.col("first.doc_id"))

    def shown(name: str) -> Column:
        return F.when(F.col(name) != int(NO_ID), F.col(name))

    return every.select(
        shown("doc_id").alias("doc_id"),
        "n_shingles",
        shown("component_id").alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        "row",
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each component, all columns unchanged.

    Defined results: those of ``near_duplicates``; null and blank texts are
    linked with nothing, so all of them stay; an empty table gives no rows;
    columns may have any names.
    """
    rows, row = numbered(docs, "near-rows")
    dropped = near_duplicates(rows, row_col=row, **options).where("not kept").select(F.col("row").alias(row))
    return rows.join(written(dropped, "near-dropped"), row, "left_anti").drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir)).drop("row")


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(l) < {SHINGLE_WORDS} THEN array_to_string(l, ' ')
    ELSE array_to_string(l[i:i + {SHINGLE_WORDS - 1}], ' ') END AS g
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - {SHINGLE_WORDS - 2}, 2))) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
