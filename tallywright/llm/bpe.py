"""Byte-level BPE, encoding by a monoid tree reduction.

Encodings of neighbouring byte strings can be joined: only tokens near the seam
change. A string is halved until the halves are short, the halves are encoded
by plain merging, and neighbours are joined by re-encoding a window around the
seam. The window grows until its first and last tokens are stable against the
tokens outside: two tokens are stable neighbours if encoding their joint bytes
gives the two tokens again, and a sequence in which all neighbours are stable
is the encoding of its bytes. So the result is exactly that of plain merging,
in time that grows with n log n instead of n squared.

A text is first cut by the vocabulary's pattern; no token spans a match, so
matches join without a window.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, released, sliced

LEAF = 8
MEMORY_WORDS, MEMORY_CHARS = 500_000, 48
BATCH_BYTES = 8 << 20


class Memory(dict):
    """Values by word, found once; of two generations of words the older one goes when the newer one is full."""

    def __init__(self, find, most: int = MEMORY_WORDS):
        super().__init__()
        self.find, self.older, self.most = find, {}, most

    def __missing__(self, word: str) -> bytes:
        found = self.older.pop(word, None)
        if found is None:
            found = self.find(word)
        if len(word) <= MEMORY_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Bpe:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks_file: str, pattern: str, memory_words: int = MEMORY_WORDS):
        with open(ranks_file, "rb") as lines:
            pairs = (line.split() for line in lines)
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.words = Memory(self.word, memory_words)
        self.stable_pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging: the pair of lowest rank first, the leftmost of equals."""
        ranks, n = self.ranks, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n))  # part i is data[i:ends[i]], before[i] starts the one before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if middle in (0, n) or ends[middle] != end or end == middle:
                continue  # one of the two has been merged meanwhile
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := ranks.get(data[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if i > 0 and (r := ranks.get(data[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i], end))
        parts, i = [], 0
        while i < n:
            parts.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return parts

    def forget(self) -> None:
        """Drop the words and pairs of tokens that are remembered."""
        self.words.clear()
        self.words.older.clear()
        self.stable_pairs.clear()

    def stable(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when they stand side by side."""
        key = (left, right)
        found = self.stable_pairs.get(key)
        if found is None:
            if len(self.stable_pairs) >= self.words.most:
                self.stable_pairs.clear()
            found = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            self.stable_pairs[key] = found
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joint bytes of two encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            outer_left, outer_right = left[:-width], right[width:]
            window = b"".join(self.tokens[t] for t in left[-width:] + right[:width])
            inner = self.merged(window)
            first = not outer_left or self.stable(outer_left[-1], inner[0])
            last = not outer_right or self.stable(inner[-1], outer_right[0])
            if first and last:
                return outer_left + inner + outer_right
            width *= 2

    def tree(self, data: bytes) -> list[int]:
        """Merges of a string without regard to whether the vocabulary holds it whole."""
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def word(self, word: str) -> bytes:
        """Ids of one match, as little-endian 32-bit integers; a match in the vocabulary is one token."""
        data = word.encode()
        whole = self.ranks.get(data)
        return np.asarray([whole] if whole is not None else self.tree(data), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenate up the tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def shared(ranks_file: str, pattern: str, memory_words: int = MEMORY_WORDS, kept: dict = {}) -> Bpe:  # noqa: B006 - one for each worker, on purpose
    """The worker's own encoder and decoder of a vocabulary, with the words it remembers."""
    key = ranks_file, pattern, memory_words
    if key not in kept:
        kept.clear()
        kept[key] = Bpe(*key)
    return kept[key]


def encode_documents(
    docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers).

    Defined results: a null or empty text has no tokens; repeated rows and null
    ids give a row each; an empty table gives no rows; a text of any length is
    encoded whole. Only the id and the text are read, so other columns cannot
    clash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(ranks_file, pattern)
        for batch in sliced(batches, "text", BATCH_BYTES):
            ids = [bpe.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), counts, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"]
            )

    return rows.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """The rows of ``encode_documents`` with ``decoded``, the bytes of the ids.

    Defined results: a row without ids decodes to nothing; repeated rows and
    null ids give a row each; an empty table gives no rows.
    """
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(ranks_file, pattern)
        for batch in sliced(batches, "ids", BATCH_BYTES):
            texts = [bpe.decode(np.frombuffer(x, "<u4")) if x else b"" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return encoded.mapInArrow(decode, schema)


def round_trip(
    docs: DataFrame,
    ranks_file: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    memory_words: int = MEMORY_WORDS,
    forget: bool = False,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document: encoded, decoded from the ids, both hashed in place.

    A worker remembers up to twice ``memory_words`` words, with ``forget`` until the end of the task only.

    Defined results: those of ``encode_documents``; only digests leave the task.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(ranks_file, pattern, memory_words)
        for batch in sliced(batches, "text", BATCH_BYTES):
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text) if text else b""
                decoded = bpe.decode(np.frombuffer(ids, "<u4"))
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if forget:
            bpe.forget()
            released()

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(load(spark, sf_dir), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
