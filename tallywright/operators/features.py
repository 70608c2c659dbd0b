"""Term counts, document frequencies and TF-IDF as long tables (document, term, weight)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import counted, ngram_tokens
from . import docblocks
from .sizing import SMALL_ROWS

#: Rows of a block that are made at once.
ROWS_AT_ONCE = 50_000


def term_counts(
    df: DataFrame,
    doc_id: str,
    text: str,
    max_n: int = 1,
    stop_words: Sequence[str] = (),
    binary: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """How often each term occurs in each document (once at most if ``binary``).

    ``doc_id`` is unique. Terms are counted inside the document's row, so no
    text is shuffled. ``carry`` names further columns of the document to keep.
    """
    counts = F.inline(counted(ngram_tokens(text, max_n, stop_words)))
    terms = df.select(doc_id, *carry, counts)
    return terms.withColumn("tf", F.lit(1).cast("long")) if binary else terms


def document_frequency(
    counts: DataFrame, n_docs: int, min_df: int | float = 1, max_df: int | float = 1.0
) -> DataFrame:
    """Documents per term, cut to ``min_df``..``max_df`` (an int is a count, a float a share)."""
    low = min_df if isinstance(min_df, int) else min_df * n_docs
    high = max_df if isinstance(max_df, int) else max_df * n_docs
    return (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .where((F.col("df") >= F.lit(low)) & (F.col("df") <= F.lit(high)))
    )


def smooth_idf(df: Column, n_docs: int | Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return F.log((n + 1).cast("double") / (df + 1).cast("double")) + 1.0


def tfidf(
    df: DataFrame,
    doc_id: str,
    text: str,
    max_n: int = 1,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    stop_words: Sequence[str] = (),
    binary: bool = False,
    use_idf: bool = True,
    norm: str | None = "l2",
    max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """(document, term, tf, df, weight) for every term of every document.

    Documents are held in the blocks of ``docblocks.py``, of up to ``max_rows``
    documents: a term is exchanged once for each block, for its document
    frequency, not once for each document, and a document's norm is added up
    inside its block.
    """
    if norm not in (None, "l1", "l2"):
        raise ValueError(f"unknown norm {norm!r}")
    weighting = docblocks.Weighting(min_df, max_df, binary, use_idf, norm, tuple(stop_words))
    rows = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.lit("all").alias("label"), F.lit(1).alias("fold"))
    # No document is of fold 0, so that all count.
    problem = [docblocks.Problem(max_n, 0, 1.0)]
    plan, _, blocks = docblocks.in_blocks(rows, "doc", "text", "label", "fold", problem, "softmax", weighting, block_rows=max_rows)
    found = blocks.select("payload", "names").mapInArrow(_weights(plan), "doc string, term string, tf long, df long, weight double")
    return found.select(F.col("doc").cast(df.schema[doc_id].dataType).alias(doc_id), "term", "tf", "df", "weight")


def _weights(plan: docblocks.Plan):
    """Rows of a block's documents and terms."""

    def rows_of(payload: bytes, names: bytes) -> Iterator[pa.RecordBatch]:
        block, kept = docblocks.Block(payload, plan), pickle.loads(names)
        docs, n, norm = pa.array(kept["docs"], pa.string()), len(block.y), plan.weighting.norm
        scales = [plan.scale(section["df"], section["words"])[:, 0] for section in block.sections]
        sizes = np.zeros(n)
        for section, scale in zip(block.sections, scales):
            owner = np.repeat(np.arange(n), section["sizes"])
            value = section["tf"] * scale[section["index"]]
            sizes += np.bincount(owner, value * value if norm == "l2" else value, n)
        sizes = np.sqrt(sizes) if norm == "l2" else sizes if norm else np.ones(n)
        for section, scale, listed in zip(block.sections, scales, kept["terms"]):
            terms = docblocks._unpacked(listed).column("name").cast(pa.string()).combine_chunks()
            owner = np.repeat(np.arange(n), section["sizes"])
            for low in range(0, len(owner), ROWS_AT_ONCE):
                some, index, tf = (x[low : low + ROWS_AT_ONCE] for x in (owner, section["index"], section["tf"]))
                columns = {
                    "doc": docs.take(pa.array(some)),
                    "term": terms.take(pa.array(index)),
                    "tf": pa.array(tf.astype(np.int64)),
                    "df": pa.array(section["df"][index, 0].astype(np.int64)),
                    "weight": pa.array(tf * scale[index] / sizes[some]),
                }
                yield pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, names in zip(batch.column("payload"), batch.column("names")):
                yield from rows_of(payload.as_py(), names.as_py())

    return run
