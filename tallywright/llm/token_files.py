"""Token ids as flat binary files with 64-bit document offsets.

Documents are sorted by id over range partitions; each task encodes its
documents and writes one pair of files:

* ``part-NNNNN.ids``: the token ids of all its documents, as little-endian
  unsigned integers (16 bits if the vocabulary allows, else 32),
* ``part-NNNNN.idx``: little-endian 64-bit integers, n doc ids followed by
  n + 1 offsets into the ids, counted from the part's first token.

A manifest (Parquet, one row per part) holds each part's number of documents
and tokens and, as prefix sums over the parts, its bases: the number of
documents and tokens before it. Readers memory-map the files and add the base.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, written
from .common import load, prefix_sums, shuffle_tasks, whole_text

PART_BYTES = 32 << 20
NO_ID = np.iinfo(np.int64).min
#: Distinct pieces and words remembered per Python worker, and the longest piece remembered.
MEMORY_PIECES, MEMORY_WORDS, MEMORY_CHARS = 400_000, 1_200_000, 64
#: Printable Latin text, which normalisation only lower-cases; and the vocabulary's words (fixed values of its file).
PLAIN = regex.compile(r"[!-~\u00a1-\u024f]+").fullmatch
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
ADDED = "<|"


class Words(dict):
    """Ids, as bytes, of single words, each encoded by the library when it is first met."""

    def __init__(self, tokenizer_file: str, dtype: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize
        self.dtype = dtype

    def library(self, text: str) -> bytes:
        return np.asarray(self.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        # Normaliser and splitter leave a lower-case ASCII word as it is: the library's model alone gives its ids.
        ids = np.asarray([t.id for t in self.tokenize(word)], self.dtype).tobytes() if word.isascii() else self.library(word)
        if len(word) <= MEMORY_CHARS:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Pieces(dict):
    """Ids, as bytes, of pieces of text between white space.

    Tokens never span white space in this vocabulary's normaliser and splitter,
    so a text's ids are those of its pieces in a row, and the ids of a piece of
    plain Latin text are those of its lower-case words. All other pieces, and
    those that may hold an added token, go to the library as they are.
    """

    def __init__(self, tokenizer_file: str, dtype: str):
        self.words = Words(tokenizer_file, dtype)

    def __missing__(self, piece: str) -> bytes:
        if PLAIN(piece) and ADDED not in piece:
            ids = b"".join(map(self.words.__getitem__, WORDS(piece.lower())))
        else:
            ids = self.words.library(piece)
        if len(piece) <= MEMORY_CHARS:
            if len(self) >= MEMORY_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def pieces_of(tokenizer_file: str, dtype: str) -> Pieces:
    """One memory per Python worker, which serves several tasks."""
    return Pieces(tokenizer_file, dtype)


def vocabulary_dtype(tokenizer_file: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else "<u4"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder; a plain path or any address that Arrow knows."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _write_part(folder: str, number: int, rows: Iterator[pa.RecordBatch], tokenizer_file: str, dtype: str, end: int):
    store, base = _store(folder)
    pieces, tail = pieces_of(tokenizer_file, dtype), np.asarray([end], dtype).tobytes()
    width, ids, lengths = np.dtype(dtype).itemsize, [], []
    own = uuid.uuid4().hex  # attempts of a task never share a file until the last, atomic, rename
    with store.open_output_stream(f"{base}/.{number:05d}-{own}.ids") as out:
        for batch in rows:
            ids.append(batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False))
            encoded = [pieces.text(t) + tail for t in batch.column("text").to_pylist()]
            lengths.append(np.fromiter((len(x) // width for x in encoded), np.int64, len(encoded)))
            out.write(b"".join(encoded))
    if not ids:
        store.delete_file(f"{base}/.{number:05d}-{own}.ids")
        return
    ids, lengths = np.concatenate(ids), np.concatenate(lengths)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    with store.open_output_stream(f"{base}/.{number:05d}-{own}.idx") as out:
        out.write(ids.astype("<i8").tobytes())
        out.write(offsets.astype("<i8").tobytes())
    for kind in ("idx", "ids"):
        store.move(f"{base}/.{number:05d}-{own}.{kind}", f"{base}/part-{number:05d}.{kind}")
    yield pa.RecordBatch.from_pydict(
        {"part": [number], "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])], "dtype": [dtype]}
    )


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_file: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Encode every text, append ``end_id``, write the files; returns the manifest.

    ``folder`` must be reachable by all executors. Tasks that are repeated write
    the same files again, under a name of their own until they are complete.

    Defined results: a null text is encoded as the empty one (just ``end_id``);
    a null id sorts first and reads back as null; rows with the same id are
    ordered by a hash of the text; an empty table gives an empty manifest.
    Only the id and the text are read, so other columns cannot clash. Ids are
    integers; others are an error.
    """
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    dtype = vocabulary_dtype(tokenizer_file)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = max(shuffle_tasks(docs.sparkSession), -(-total // part_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("split", F.spark_partition_id())
    order = [F.col("doc_id").asc_nulls_first(), "tie"]
    rows = rows.repartitionByRange(parts, *order, "split").sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _write_part(folder, TaskContext.get().partitionId(), batches, tokenizer_file, dtype, end_id)

    made = written(rows.mapInArrow(write, "part long, n_docs long, n_tokens long, dtype string"), "token-parts")
    with_tokens = prefix_sums(made, "part", "n_tokens", "token_base")
    manifest = prefix_sums(with_tokens, "part", "n_docs", "doc_base")
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    return docs.sparkSession.read.schema(manifest.schema).parquet(path)


def _mapped(store: fs.FileSystem, path: str) -> pa.Buffer:
    """The file's bytes: memory-mapped where it is local, else read."""
    if isinstance(store, fs.LocalFileSystem):
        if not os.path.getsize(path):
            return pa.py_buffer(b"")
        with pa.memory_map(path) as source:
            return source.read_buffer()
    with store.open_input_file(path) as source:
        return source.read_buffer()


def read_token_files(spark: SparkSession, folder: str, batch_docs: int = 4096) -> DataFrame:
    """One row per document in file order: ``doc_id, start, n_tokens, ids`` (ids as little-endian bytes, 32 bits each).

    ``start`` is the number of tokens of all documents before it.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    schema = "part long, doc_id long, start long, n_tokens long, ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            n, name = row["n_docs"], f"{base}/part-{row['part']:05d}"
            index = np.frombuffer(_mapped(store, f"{name}.idx"), "<i8")
            tokens = np.frombuffer(_mapped(store, f"{name}.ids"), row["dtype"])
            doc_ids, offsets = index[:n], index[n:]
            for a in range(0, n, batch_docs):
                b = min(n, a + batch_docs)
                ids = [tokens[x:y].astype("<u4").tobytes() for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b - a, row["part"])),
                        pa.array(doc_ids[a:b], mask=doc_ids[a:b] == NO_ID),
                        pa.array(offsets[a:b] + row["token_base"]),
                        pa.array(np.diff(offsets[a : b + 1])),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["part", "doc_id", "start", "n_tokens", "ids"],
                )

    spread = manifest.repartition(shuffle_tasks(spark), "part")
    return spread.mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "tokens")
    write_token_files(load(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    docs = read_token_files(spark, folder)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
