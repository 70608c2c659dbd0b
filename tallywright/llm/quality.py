"""Quality rules from a suffix array of each text's words.

The suffix arrays of many documents are built together with numpy: suffixes are
sorted by document and first word, then by twice as many words in each round,
and only ties are sorted again. The rank tables of the rounds give the longest
common prefix of neighbouring suffixes. Its intervals are the maximal repeated
substrings; a document is judged by the share of words that the union of their
spans covers and by the longest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, byte_texts, load, released, sliced, slices

SYMBOLS = "#*$%&|<>"
WINDOW = 8
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Limits:
    """A text fails below ``min_words``, above a share of words in repeats, or with too long a repeat.

    ``base_percent`` and ``min_words`` are the base rule; ``max_percent`` and
    ``max_repeat`` (words) are the verdict on maximal repeats.
    """

    min_words: int = 20
    base_percent: int = 30
    max_percent: int = 25
    max_repeat: int = 60


def suffix_ranks(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Rank tables: in table k two positions have the same rank if their first 2^k words are equal.

    ``words`` are codes, different in different documents; ``ends`` is the end
    of each position's document. In the last table all ranks differ and order
    the suffixes.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    in_order = words[order]
    first = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    starts = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    sizes = np.diff(np.append(starts, n))
    active = order[np.repeat(sizes > 1, sizes)]
    tables, width = [rank.astype(np.int32)], 1
    while len(active):
        beyond = active + width
        following = np.where(beyond < ends[active], rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + following
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        group = rank[active]
        index = np.arange(len(active))
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_part = np.concatenate([[True], key[1:] != key[:-1]])
        group_start = np.maximum.accumulate(np.where(new_group, index, 0))
        part_start = np.maximum.accumulate(np.where(new_part, index, 0))
        rank = rank.copy()
        rank[active] = group + part_start - group_start
        tables.append(rank.astype(np.int32))
        parts = np.flatnonzero(new_part)
        sizes = np.diff(np.append(parts, len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        width *= 2
    return tables


def repeat_lengths(words: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """For each position, how many words from there also start elsewhere in its document; 0 if fewer than ``least``.

    This is the larger of the longest common prefixes with the two neighbours
    in the suffix array, that is the highest interval that holds the suffix.
    """
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    tables = suffix_ranks(words, ends)
    order = np.empty(n, np.int64)
    order[tables[-1]] = np.arange(n)
    left, right = order[:-1], order[1:]
    known = min(least.bit_length() - 1, len(tables) - 1)
    near = tables[known][left] == tables[known][right]
    left, right = left[near], right[near]
    common = np.zeros(len(left), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < n) & (b < n)
        table = tables[k]
        common += np.where(inside & (table[np.minimum(a, n - 1)] == table[np.minimum(b, n - 1)]), 1 << k, 0)
    common[common < least] = 0
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def _measure(batch: pa.RecordBatch, limits: Limits) -> dict[str, np.ndarray]:
    """The measures of one slice of documents."""
    texts = byte_texts(batch.column("text"))
    strings = [t.decode() for t in texts]
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    stops = np.cumsum(counts)
    starts = stops - counts
    document = np.repeat(np.arange(len(texts)), counts)
    codes = pa.array(list(chain.from_iterable(split)), pa.binary()).dictionary_encode().indices
    codes = codes.to_numpy(zero_copy_only=False).astype(np.int64)
    longest = repeat_lengths(document * (len(codes) + 1) + codes, stops[document], WINDOW)
    at = np.flatnonzero(longest)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + longest[at], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    in_repeats = covered[stops] - covered[starts]
    longest_of = np.zeros(len(texts), np.int64)
    np.maximum.at(longest_of, document[at], longest[at])
    lines = [[x for x in s.split("\n") if x.strip(SPACES)] for s in strings]
    failed = (counts < limits.min_words) | (100 * in_repeats > limits.base_percent * counts)
    bad = (100 * in_repeats > limits.max_percent * counts) | (longest_of > limits.max_repeat)
    return {
        "n_words": counts,
        "word_chars": np.array([len(s) - sum(map(s.count, SPACES)) for s in strings], np.int64),
        "n_symbols": np.array([sum(map(s.count, SYMBOLS)) for s in strings], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": in_repeats,
        "longest_repeat": longest_of,
        "base_failed": failed,
        "kept": ~failed & ~bad,
    }


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, "
    "base_failed boolean, kept boolean"
)


def measure_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """One row per document: ``doc_id``, its measures, ``base_failed`` and the verdict ``kept``.

    ``n_repeat_words`` counts the words in the union of all maximal repeats of 8
    or more words (the first occurrence included), which are the words in
    8-word windows found twice or more; ``longest_repeat`` is the longest.

    Defined results: a null text is the empty one and fails for want of words;
    repeated rows and null ids give a row each; an empty table gives no rows; a
    long text is measured whole. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {MEASURES}"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            found = {k: pa.array(v) for k, v in _measure(batch, limits).items()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found.values()], names=["doc_id", *found])

    return rows.mapInArrow(measure, schema)


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` whose text passes, all columns unchanged.

    Defined results: as in ``measure_quality``; a null or short text goes,
    repeated rows stay or go together, an empty table gives no rows.
    """
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = pa.RecordBatch.from_arrays([whole.column(place)], names=["text"])
            kept = [pa.array(_measure(part, limits)["kept"]) for part in slices(texts, "text", SLICE_BYTES)]
            if kept:
                yield whole.filter(pa.chunked_array(kept).combine_chunks())
            del whole, texts
            released()

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_quality(load(spark, sf_dir)).drop("longest_repeat")


def _windows(size: int) -> str:
    return f"""
  SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM q_words WHERE len(w) >= {size})"""


def sql(table: str = "documents", limits: Limits = Limits()) -> str:
    """The same measures and verdicts in SQL, as WITH parts that end in ``quality``."""
    return f"""
q_words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
q_win AS ({_windows(WINDOW)}),
q_dup AS (SELECT doc_id, s FROM q_win GROUP BY doc_id, s HAVING count(*) > 1),
q_rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM q_win JOIN q_dup USING (doc_id, s)) GROUP BY doc_id),
q_long AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, s FROM ({_windows(limits.max_repeat + 1)}) GROUP BY doc_id, s HAVING count(*) > 1)),
q_line AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM q_words)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
q_all AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(q_line.n, 0)::BIGINT AS n_dup_lines, coalesce(q_rep.n, 0)::BIGINT AS n_repeat_words,
    q_long.doc_id IS NOT NULL AS too_long
  FROM q_words LEFT JOIN q_line USING (doc_id) LEFT JOIN q_rep USING (doc_id) LEFT JOIN q_long USING (doc_id)),
q_base AS (
  SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.base_percent} * n_words AS base_failed FROM q_all),
quality AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT too_long AND 100 * n_repeat_words <= {limits.max_percent} * n_words AS kept
  FROM q_base)"""


SQL = f"WITH {sql()} SELECT * FROM quality"
