"""Score texts by online logistic context mixing.

A text is read as its tokens: lower-cased words joined by one space, then an end
byte. Its bytes are coded as symbols of five bits, common ones as one symbol. For
each of a few context lengths the training texts give counts of what followed; on
the path to a symbol they predict its bits. The predictions meet in the logistic
domain under weights that the number of known contexts selects and that every
coded symbol refines. The sum of the logarithms is the text's probability.

Contexts live in a table that grows with the corpus. Documents are dealt into
blocks of some MB. A block sends its distinct contexts with their own counts to
the parts that contexts are dealt into; the parts add up and send back the
corpus' counts of just these contexts; then the block is scored on its own.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .common import byte_texts, crc32_sql, load, slices

#: Symbols of context of each predictor, from 1 in steps of 2.
ORDERS = (1, 3, 5)
BLOCK_BYTES, SEGMENT, LANES = 4 << 20, 2048, 1024
#: Bytes of text for each part that contexts and words are dealt into.
PART_BYTES = 16 << 20
#: First weight, step of the weights, added to counts.
WEIGHT, STEP, ADDED = 0.35, 0.02, 0.2
#: Bound of the mix, so that no bit costs without end.
MOST = np.float32(15)
#: Symbols have five bits. These bytes are one symbol, all others an escape and two more. The last one ends a text.
PLAIN, BITS = b"abcdefghijklmnopqrstuvwxyz .,\xc3\n", 5
SYMBOLS, END = 1 << BITS, 10
BASE_ADDED = 0.1


PACKED = "block long, ids array<long>, held array<boolean>, sizes array<long>, data binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its documents' ids, sizes and compressed bytes."""
    block, texts, ids, held, size = TaskContext.get().partitionId() << 32, [], [], [], 0

    def row():
        # Training texts first, so that their symbols are one run.
        nonlocal texts, ids, held
        texts, ids, held = zip(*sorted(zip(texts, ids, held), key=lambda r: r[2]))
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        columns = [[block], [list(ids)], [list(held)], [[len(t) for t in texts]], [data]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PACKED.split(", ")])

    for whole in batches:
        for batch in slices(whole, "text", BLOCK_BYTES):
            columns = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), byte_texts(batch.column("text"))
            for doc_id, out, text in zip(*columns):
                text = b" ".join(text.lower().split()) + b"\n"
                if texts and size + len(text) > BLOCK_BYTES:
                    yield row()
                    block, texts, ids, held, size = block + 1, [], [], [], 0
                texts.append(text)
                ids.append(doc_id)
                held.append(out)
                size += len(text)
    if texts:
        yield row()


def _texts(row: dict) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(row["data"])
    ends = np.cumsum(row["sizes"]).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of all texts in a row as codes, the distinct words, and each text's number of words."""
    coded = pa.array(b"".join(texts).split(), pa.binary()).dictionary_encode()
    sizes = np.array([t.count(b" ") + 1 if len(t) > 1 else 0 for t in texts], np.int64)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, sizes


#: Per byte, its own symbol, or the escape.
CODE = np.full(256, SYMBOLS - 1, np.uint8)
CODE[list(PLAIN)] = np.arange(len(PLAIN))


class Stream:
    """The symbols of a block's documents and, for each order, dense numbers of the strings that end at each symbol."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        own = CODE[data]
        escaped = np.nonzero(own == SYMBOLS - 1)[0]
        counts = np.ones(len(data), np.uint8)
        counts[escaped] = 3
        self.symbols = np.repeat(own, counts)
        at = escaped + 2 * np.arange(len(escaped))
        self.symbols[at + 1], self.symbols[at + 2] = data[escaped] >> 5, data[escaped] & (SYMBOLS - 1)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(self.sizes)
        ends += 2 * np.searchsorted(escaped, ends)
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.lengths = ends - self.starts

    def keys(self, order: int, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The ``order`` symbols before each position of ``at``, whose document begins at ``first``, with the order on top."""
        key = np.full(len(at), order, np.int64)
        for back in range(order, 0, -1):
            # What precedes a document is its own end, which no text holds elsewhere.
            before = np.where(at - back >= first, self.symbols[np.maximum(at - back, 0)], PLAIN.index(END))
            key = key * SYMBOLS + before
        return key

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each order: (order, number of (context, symbol) at each position, a position of each, its context's key).

        Strings of two symbols more are numbered from the numbers of the shorter
        ones by marking a table, without sorting. A context's numbers are
        neighbours.
        """
        size = len(self.symbols)
        last_two = self.symbols.astype(np.int32)
        last_two[1:] += self.symbols[:-1].astype(np.int32) * SYMBOLS
        last_two[self.starts] = PLAIN.index(END) * SYMBOLS + self.symbols[self.starts].astype(np.int32)
        before, number, shorter = np.zeros(size, np.int32), None, 0
        places = np.arange(size, dtype=np.int32)
        for order in ORDERS:
            if number is not None:
                before[2:] = number[:-2]
                # A document starts in a context of its own.
                before[self.starts] = shorter
                before[np.minimum(self.starts + 1, self.starts + self.lengths - 1)] = shorter
            key = before * np.int32(SYMBOLS**2)
            key += last_two
            marks = np.zeros((shorter + 1) * SYMBOLS**2, bool)
            marks[key] = True
            marked = np.flatnonzero(marks)
            shorter = len(marked)
            # Only marked places are ever written or read.
            numbers = np.empty(len(marks), np.int32)
            numbers[marked] = np.arange(shorter, dtype=np.int32)
            number = numbers[key]
            position = np.empty(shorter, np.int64)
            position[number] = places
            first = self.starts[np.searchsorted(self.starts, position, side="right") - 1]
            yield order, number, position, self.keys(order, position, first)


SENT = "part long, block long, data binary"
BACK = "block long, tokens long, known long, data binary"


def _blobs(part: np.ndarray, word_part: np.ndarray, parts: np.ndarray, pairs, counts, words: list[bytes], word_counts) -> list[bytes]:
    """Pairs and words, sorted by part, as compressed bytes for each of ``parts``; a context is stored once with its symbols."""
    compress = zstandard.ZstdCompressor(level=1).compress
    cuts = [np.searchsorted(x, np.append(parts, parts[-1] + 1)) for x in (part, word_part)]
    out = []
    for i in range(len(parts)):
        own, mine = slice(*cuts[0][i : i + 2]), slice(*cuts[1][i : i + 2])
        context = pairs[own] >> BITS
        heads = np.nonzero(np.diff(context, prepend=-1))[0]
        arrays = (
            np.diff(context[heads], prepend=0),
            np.diff(np.append(heads, len(context))).astype(np.int8),
            (pairs[own] & (SYMBOLS - 1)).astype(np.int8),
            counts[own],
            b" ".join(words[mine]) if mine.stop > mine.start else None,
            word_counts[mine],
        )
        out.append(compress(pickle.dumps(arrays, protocol=5)))
    return out


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Pairs, counts and rows; words, counts and rows of what ``_blobs`` made."""
    decompress = zstandard.ZstdDecompressor().decompress
    pairs, counts, sizes, words, word_counts, word_sizes = [], [], [], [], [], []
    for data in table.column("data").to_pylist():
        steps, n, symbols, count, joined, word_count = pickle.loads(decompress(data))
        pairs.append((np.repeat(np.cumsum(steps), n) << BITS) + symbols)
        counts.append(count)
        sizes.append(len(symbols))
        words += [] if joined is None else joined.split(b" ")
        word_counts.append(word_count)
        word_sizes.append(len(word_count))
    row, word_row = (np.repeat(np.arange(table.num_rows), x) for x in (sizes, word_sizes))
    return np.concatenate(pairs), np.concatenate(counts), row, words, np.concatenate(word_counts), word_row


def _gathered(parts: int):
    """A block's distinct (context, symbol) pairs and words with their training counts, dealt into parts by context and word."""

    def of_block(row: dict) -> pa.RecordBatch:
        texts, held = _texts(row), np.array(row["held"], bool)
        stream = Stream(texts)
        trained = int(stream.lengths[~held].sum())
        pairs, counts = [], []
        for _, number, position, own in stream.pairs():
            counts.append(np.bincount(number[:trained], minlength=len(position)).astype(np.int32))
            pairs.append(own * SYMBOLS + stream.symbols[position])
        pairs, counts = np.concatenate(pairs), np.concatenate(counts)
        # A multiplicative hash spreads the contexts.
        part = (((pairs >> BITS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) % parts
        order = np.argsort((part << int(pairs.max()).bit_length()) + pairs)
        pairs, counts, part = pairs[order], counts[order], part[order]
        codes, names, sizes = _words(texts)
        words = [*names.to_pylist(), b"\n"]
        known = np.bincount(codes[: int(sizes[~held].sum())], minlength=len(names))
        word_counts = np.append(known, np.count_nonzero(~held)).astype(np.int32)
        word_part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
        # Sorted words compress well on their way.
        by_word = pa.compute.array_sort_indices(pa.array(words, pa.binary())).to_numpy()
        order = by_word[np.argsort(word_part[by_word], kind="stable")]
        word_part, word_counts = word_part[order], word_counts[order]
        to = np.union1d(part, word_part)
        blobs = _blobs(part, word_part, to, pairs, counts, [words[i] for i in order.tolist()], word_counts)
        columns = [pa.array(to), pa.array(np.full(len(to), row["block"])), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield of_block(batch.slice(i, 1).to_pylist()[0])

    return run


def _answered(table: pa.Table) -> pa.Table:
    """The corpus' counts of a part's contexts and words, for each block that asked.

    A block asks for a context once, so no context has more rows than there are
    blocks, each of which has many thousand contexts.
    """
    pairs, counts, row, words, word_counts, word_row = _unpacked(table)
    names, at = np.unique(pairs, return_inverse=True)
    total = np.bincount(at, weights=counts).astype(np.int64)
    names, total = names[total > 0], total[total > 0]
    context = pairs >> BITS
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (context[1:] != context[:-1]) | (row[1:] != row[:-1])
    context, row = context[fresh], row[fresh]
    low, high = np.searchsorted(names, context << BITS), np.searchsorted(names, (context + 1) << BITS)
    sizes = high - low
    every = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
    rows = np.arange(table.num_rows)

    places = {}
    at = np.array([places.setdefault(w, len(places)) for w in words], np.int64)
    word_total = np.bincount(at, weights=word_counts, minlength=len(places)).astype(np.int64)
    found = np.nonzero(word_total[at] > 0)[0] if len(at) else at
    known = [words[i] for i in found]
    blobs = _blobs(np.repeat(row, sizes), word_row[found], rows, names[every], total[every], known, word_total[at][found])
    first = rows == 0
    return pa.table(
        {
            "block": table.column("block"),
            # What the part adds to the numbers of all tokens and of all distinct words.
            "tokens": pa.array(np.where(first, word_total.sum(), 0)),
            "known": pa.array(np.where(first, np.count_nonzero(word_total), 0)),
            "data": pa.array(blobs, pa.binary()),
        }
    )


class Table:
    """Stretched predictions of the bits of each string of a block: one row per (longest context, symbol), orders side by side."""

    def __init__(self, stream: Stream, both: np.ndarray, counts: np.ndarray):
        """``both, counts``: the corpus' counts of the block's contexts, by context and symbol, in order."""
        rows, numbers = [], []
        for order, number, position, own in stream.pairs():
            own = own * SYMBOLS + stream.symbols[position]
            # Keys of an order are the numbers from ``order * SYMBOLS ** order`` on.
            low, high = np.searchsorted(both, [x * SYMBOLS ** (order + 1) for x in (order, order + 1)])
            paths = np.concatenate([own, both[low:high]])
            n = np.concatenate([np.zeros(len(own)), counts[low:high].astype(np.float64)])
            sorted_by = np.argsort(paths)
            paths, n = paths[sorted_by], n[sorted_by]
            table, before = np.empty((len(n), BITS), np.float32), None
            for depth in range(BITS + 1):
                node = paths >> (BITS - depth)
                group = np.cumsum(np.concatenate([[0], node[1:] != node[:-1]]))
                taken = np.bincount(group, weights=n)[group]
                if depth:
                    table[:, depth - 1] = np.log((taken + ADDED) / (before - taken + ADDED))
                before = taken
            back = np.empty(len(n), np.int64)
            back[sorted_by] = np.arange(len(n))
            rows.append(table[back[: len(own)]])
            numbers.append(number)
        # The longest string has the others as its ends. ``position`` is one place of each.
        self.numbers = number
        self.rows = np.stack([r[n[position]] for r, n in zip(rows, numbers)], axis=1)


def log2_of(stream: Stream, table: Table) -> np.ndarray:
    """Base-2 logarithm of each document's probability.

    A document is coded in segments of SEGMENT symbols, many side by side; each
    starts with the same weights, contexts reach across segments.
    """
    parts = -(-stream.lengths // SEGMENT)
    owner = np.repeat(np.arange(len(parts)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = stream.starts[owner] + nth * SEGMENT
    lengths = np.minimum(stream.lengths[owner] - nth * SEGMENT, SEGMENT)
    by_length = np.argsort(-lengths, kind="stable")
    gates, orders = len(ORDERS) + 1, len(ORDERS)
    total = np.zeros(len(owner))
    rows = table.rows.reshape(len(table.rows), -1)
    known = np.count_nonzero(table.rows[:, :, 0], axis=1)
    for first in range(0, len(owner), LANES):
        lanes = by_length[first : first + LANES]
        start, length, n = starts[lanes], lengths[lanes], len(lanes)
        weights = np.full((n * gates, orders * BITS), WEIGHT, np.float32)
        row_base = np.arange(n) * gates
        active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        found = np.zeros(n)
        for step in range(int(length[0])):
            a = int(active[step])
            number = table.numbers.take(start[:a] + step)
            inputs, row = rows.take(number, axis=0), known.take(number)
            row += row_base[:a]
            weight = weights.take(row, axis=0)
            each = weight * inputs
            mix = each[:, :BITS].copy()
            for order in range(1, orders):
                mix += each[:, order * BITS : (order + 1) * BITS]
            # A bit's probability is 1 / (1 + odds against it).
            against = np.exp(-np.minimum(np.maximum(mix, -MOST), MOST))
            whole = against + 1
            product = whole[:, 0].copy()
            for bit in range(1, BITS):
                product *= whole[:, bit]
            found[:a] -= np.log2(product)
            against /= whole
            against *= STEP
            inputs.reshape(a, orders, BITS)[...] *= against[:, None, :]
            inputs += weight
            weights[row] = inputs
        total[lanes] = found
    return np.bincount(owner, weights=total, minlength=len(parts))


RAW = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, bits double, size long, tokens long, known long"


def _scored(docs: pa.Table, given: pa.Table) -> pa.Table:
    row = docs.to_pylist()[0]
    texts = _texts(row)
    stream = Stream(texts)
    pairs, totals, _, words, counts, _ = _unpacked(given)
    order = np.argsort(pairs)
    bits = log2_of(stream, Table(stream, pairs[order], totals[order]))
    codes, names, sizes = _words(texts)
    asked = pa.concat_arrays([names, pa.array([b"\n"], pa.binary())])
    found = pa.compute.index_in(asked, value_set=pa.array(words, pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False)
    # A word without a count adds nothing here.
    logs = np.append(np.log10(counts + BASE_ADDED), 0.0)[found]
    unknown = math.log10(BASE_ADDED)
    ends = np.cumsum(sizes)
    known = np.concatenate([[0], np.cumsum(found[codes] >= 0)])
    n = sizes + 1
    n_known = known[ends] - known[ends - sizes] + int(found[-1] >= 0)
    every, end = logs[codes], float(logs[-1])
    base = [
        math.fsum([*every[b - size : b].tolist(), end]) + unknown * missing
        for b, size, missing in zip(ends.tolist(), sizes.tolist(), (n - n_known).tolist())
    ]
    first = np.arange(len(texts)) == 0
    return pa.table(
        {
            "doc_id": pa.array(row["ids"], pa.int64()),
            "held_out": pa.array(row["held"], pa.bool_()),
            "n_tokens": pa.array(n, pa.int64()),
            "n_known": pa.array(n_known, pa.int64()),
            "logs": pa.array(base, pa.float64()),
            "bits": pa.array(bits),
            "size": pa.array(stream.sizes),
            **{c: pa.array(np.where(first, pa.compute.sum(given.column(c)).as_py(), 0)) for c in ("tokens", "known")},
        }
    )


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_of: int = 10) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every document.

    A document is held out if the CRC-32 of its id as text is a multiple of
    ``held_out_of``; counts come from all others. ``base_score`` adds the
    logarithms of smoothed token shares, ``score`` is the mixed model's log10
    probability of the lower-cased words joined by spaces, and their end.

    Defined results: a null or empty text is the end token alone; a null id
    reads as an empty text; repeated rows are each trained on and scored; without
    training documents all tokens are unknown; an empty table gives no rows.
    """
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % held_out_of == 0).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    packed = written(named.mapInArrow(_packed, PACKED), "lm-blocks")
    size = packed.agg(F.coalesce(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")), F.lit(0))).first()[0]
    parts = max(-(-size // PART_BYTES), 1)
    sent = packed.mapInArrow(_gathered(parts), SENT)
    back = sent.groupBy("part").applyInArrow(_answered, BACK)
    raw = written(packed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scored, RAW), "lm-scores")
    n_tokens, n_words = raw.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    whole = math.log10(n_tokens + BASE_ADDED * (n_words + 1))
    return raw.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("bits") * math.log10(2)).alias("score"),
        (-F.col("bits") / F.col("size")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir))


#: What SQL can state: all but the mixed model's score.
BASE_SQL = rf"""
WITH d AS (
  SELECT doc_id, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 10 = 0 AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+'), ' ') AS t FROM documents),
w AS (SELECT doc_id, held_out, unnest(t) AS token FROM d),
c AS (SELECT token, count(*) AS c FROM w WHERE NOT held_out GROUP BY token),
s AS (SELECT coalesce(sum(c), 0)::BIGINT AS big_n, count(*) AS big_v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(big_n) AS train_tokens,
  sum(log10((coalesce(c, 0) + {BASE_ADDED}) / (big_n + {BASE_ADDED} * (big_v + 1)))) AS base_score
FROM w LEFT JOIN c USING (token), s GROUP BY doc_id, held_out
"""
