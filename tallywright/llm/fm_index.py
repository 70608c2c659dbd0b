"""Repeated word windows, found with an FM-index per shard.

Documents are cut into content-defined segments (``segments``), equal segments
are collapsed, and each shard of segments gets a compressed FM-index: the
Burrows-Wheeler transform of its words in a wavelet tree of bit vectors. Every
segment is then streamed through the index by backward search. For each end
position this gives the matching statistic, the length of the longest match
that also occurs elsewhere, up to the window; windows that reach the threshold
are reported, and of each only the earliest occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import segments
from .common import load
from .quality import suffix_ranks

WINDOW, GRAM = 20, 5
SHARD_BYTES = 4 << 20
HOT_ROUTE = 20_000
QUERY_BLOCK = 1 << 18


class BitVector:
    """Packed bits with a directory for the number of ones before a position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]])

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Ranks of symbols in a sequence, by one bit vector for each bit of a symbol (the levelwise layout)."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.vectors, self.zeros = [], []
        starts = np.zeros(size, np.int64)
        every = np.arange(size)
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            vector = BitVector(bits)
            zeros = len(bits) - int(bits.sum())
            self.vectors.append(vector)
            self.zeros.append(zeros)
            ones = vector.ones(starts)
            starts = np.where((every >> level) & 1, zeros + ones, starts - ones)
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.starts = starts

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        for level, vector, zeros in zip(range(self.levels - 1, -1, -1), self.vectors, self.zeros):
            ones = vector.ones(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i - self.starts[symbol]


class FmIndex:
    """Backward search over sequences of codes, each followed by an end mark of its own.

    ``words`` are codes from 0; ``lengths`` are the sequences' lengths.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        n_marks = len(lengths)
        stops = np.cumsum(lengths)
        text = np.insert(words + n_marks, stops, np.arange(n_marks))
        order = np.empty(len(text), np.int64)
        order[suffix_ranks(text, np.full(len(text), len(text)))[-1]] = np.arange(len(text))
        last = text[order - 1]  # the symbol before each suffix; all marks become symbol 0
        symbols = np.where(last < n_marks, 0, last - n_marks + 1)
        size = int(words.max()) + 2
        counts = np.bincount(words + 1, minlength=size)
        counts[0] = n_marks
        self.first = np.cumsum(counts) - counts
        self.after = self.first + counts
        self.tree = WaveletTree(symbols, size)

    def matches(self, words: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics for each of ``ends`` (positions in ``words``): length, at most ``longest``, and interval.

        The length is that of the longest match ending there that occurs at
        least twice; the interval's start names the match where it reaches ``longest``.
        """
        length = np.zeros(len(ends), np.int64)
        interval = np.full(len(ends), -1)
        active = np.arange(len(ends))
        symbol = words[ends] + 1
        low, high = self.first[symbol], self.after[symbol]
        for step in range(1, longest + 1):
            twice = high - low > 1
            active, low, high = active[twice], low[twice], high[twice]
            length[active] = step
            if step == longest or not len(active):
                break
            symbol = words[ends[active] - step] + 1
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = self.first[symbol] + self.tree.rank(symbol, high)
        interval[active] = low
        return length, interval



def later_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Windows of a shard's segments that also start earlier, as runs."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    shard = pa.Table.from_batches(batches)
    split = [b.split(b" ") for b in shard["bytes"].to_pylist()]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    codes = pa.array([w for x in split for w in x], pa.binary()).dictionary_encode().indices
    words = codes.to_numpy(zero_copy_only=False).astype(np.int64)
    index = FmIndex(words, lengths)
    counts = lengths - window + 1
    segment = np.repeat(np.arange(len(split)), counts)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = (np.cumsum(lengths) - lengths)[segment] + offset + window - 1
    interval = np.concatenate(
        [index.matches(words, ends[a : a + QUERY_BLOCK], window)[1] for a in range(0, len(ends), QUERY_BLOCK)]
    )
    hit = np.flatnonzero(interval >= 0)
    segment, offset, interval = segment[hit], offset[hit], interval[hit]
    doc, twin, base = (shard[c].to_numpy() for c in ("doc_id", "twin", "start"))
    start = base[segment] + offset
    order = np.lexsort((start, twin[segment], doc[segment], interval))
    same = interval[order][1:] == interval[order][:-1]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
    first = order[head]
    later = np.zeros(len(hit), bool)
    later[order] = (
        (doc[segment[order]] != doc[segment[first]])
        | (twin[segment[order]] != twin[segment[first]])
        | (start[order] != start[first])
    )
    segment, start = segment[later], start[later]
    if not len(segment):
        return
    head = np.flatnonzero((np.diff(segment, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(doc[segment[head]]),
            pa.array(twin[segment[head]]),
            pa.array(start[head]),
            pa.array(np.diff(np.append(head, len(segment)))),
        ],
        names=["doc_id", "twin", "start", "windows"],
    )


def remove_repeated_windows(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
    hot_route: int = HOT_ROUTE,
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier.

    Earlier means a smaller id, or the same document and an earlier start.
    Returns ``doc_id, n_words, n_removed, n_spans, kept_text`` per input row,
    the kept words joined by one space. ``gram``, ``shard_bytes`` and
    ``hot_route`` change the way of the work, never the result.

    Defined results: a null text has no words; texts shorter than a window stay;
    a null id counts as the largest; rows with the same id are ordered by a hash
    of their text, and rows with the same id and text do not count as earlier
    than each other; an empty table gives no rows. Ids must be integers. Other
    columns are not read.
    """
    shape = segments.Shape("word", window, gram)
    rows = segments.identified(docs, id_col, text_col)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return later_windows(batches, window)

    runs = segments.repeated_windows(
        rows, shape, "windows", segments.later_copies, index, shard_bytes, hot_route
    )
    cleaned = segments.remove_windows(rows, runs, shape)
    return cleaned.select(
        "doc_id", F.col("n_units").alias("n_words"), "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_text")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated_windows(load(spark, sf_dir))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(l[i:i + {WINDOW - 1}], ' ')) AS s
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - {WINDOW - 2})) AS i FROM w WHERE len(l) >= {WINDOW})),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM f WHERE n > 1),
k AS (
  SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS p FROM w) u
  LEFT JOIN r ON r.doc_id = u.doc_id AND r.p = u.p WHERE r.p IS NULL GROUP BY u.doc_id)
SELECT w.doc_id, len(l)::BIGINT AS n_words, (len(l) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
