"""Repeated byte strings, found with suffix arrays by external induced sorting.

Documents are cut into content-defined segments (``segments``) and equal
segments are collapsed. What is left of a route's segments is written, one
after the other, to a scratch file of the shard's task; ``induced`` sorts its
suffixes with disk-backed queues and carries the common prefixes along. Two
neighbours that share a window's length are a repeated window.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import segments
from .common import load
from .induced import ROUND, sort_suffixes

WINDOW, GRAM = 200, 50
SHARD_BYTES = 3 << 19
HOT_ROUTE = 2_000
PLACES = ("doc_id", "twin", "start", "windows", "copies")


def repeated_in_shard(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Windows of a shard's segments that occur at least twice in it, as runs; collapsed copies are left out."""
    places, lengths = [], []
    with tempfile.TemporaryFile() as file:
        for batch in batches:
            contents = batch.column("bytes").to_pylist()
            places.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in PLACES]))
            lengths.extend(map(len, contents))
            # Bytes become the symbols 1 to 256; 0 ends a segment.
            for content in contents:
                file.write((np.frombuffer(content, np.uint8).astype(np.int16) + 1).tobytes())
                file.write(b"\0\0")
        if not lengths:
            return
        file.flush()
        text = np.asarray(np.memmap(file, np.int16, "r"))
        order, shared = sort_suffixes(text, window)
        repeated = np.zeros(len(text), bool)
        for a in range(0, len(text), ROUND):
            b = min(len(text), a + ROUND)
            long = shared[a:b] >= window
            repeated[order[a:b][long]] = True
            repeated[order[np.arange(a, b)[long] - 1]] = True
    doc, twin, start, _, copies = np.concatenate(places, axis=1)
    sizes = np.array(lengths) + 1
    first = np.cumsum(sizes) - sizes
    at = np.flatnonzero(repeated)
    segment = np.searchsorted(first, at, side="right") - 1
    single = copies[segment] == 1
    at, segment = at[single], segment[single]
    head = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(segment, prepend=-1) != 0))
    if len(head):
        own = segment[head]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[own]),
                pa.array(twin[own]),
                pa.array(start[own] + at[head] - first[own]),
                pa.array(np.diff(np.append(head, len(at)))),
            ],
            names=["doc_id", "twin", "start", "windows"],
        )


def remove_repeated_strings(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
    hot_route: int = HOT_ROUTE,
) -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that also starts anywhere else.

    Texts are UTF-8 bytes; matches never cross documents; overlapping
    occurrences count. Returns ``doc_id, n_bytes, n_removed, n_spans, kept``
    (the remaining bytes) per input row. ``gram``, ``shard_bytes`` and
    ``hot_route`` change the way of the work, never the result.

    Defined results: a null text has no bytes; texts shorter than a window stay;
    rows that repeat id and text are rows of their own, so all their windows
    occur twice; null ids are kept as null; an empty table gives no rows. Ids
    must be integers. Other columns are not read.
    """
    shape = segments.Shape("byte", window, gram)
    rows = segments.identified(docs, id_col, text_col)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return repeated_in_shard(batches, window)

    runs = segments.repeated_windows(rows, shape, "strings", segments.all_copies, index, shard_bytes, hot_route)
    cleaned = segments.remove_windows(rows, runs, shape)
    return cleaned.withColumnRenamed("n_units", "n_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated_strings(load(spark, sf_dir))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
