"""Documents in blocks of counted terms, and what a fit has to know of them.

A block holds documents as they are read; terms that several blocks hold are numbered by a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngram_tokens
from ..session import small_batches, written

#: Words and word pairs, and documents, that a block holds at most, about.
BLOCK_WORDS, BLOCK_ROWS = 1_500_000, 100_000
#: Terms, or numbers of shared terms, that a group holds at most, about.
TERMS, CELLS = 1_000_000, 8_000_000
#: Columns up to which all numbers are kept in double precision.
EXACT_COLUMNS = 32


@dataclass(frozen=True)
class Problem:
    """One fit: trained on the rows of all folds but ``fold``, on sequences of up to ``max_n`` words."""

    max_n: int
    fold: int
    c: float


@dataclass(frozen=True)
class Weighting:
    """How term counts become features."""

    min_df: float = 1
    max_df: float | None = None
    binary: bool = False
    use_idf: bool = True
    norm: str | None = "l2"
    stop_words: tuple[str, ...] = ()
    #: Frequencies count a term's occurrences, not its documents.
    occurrences: bool = False

    def __post_init__(self):
        if self.norm not in (None, "l1", "l2"):
            raise ValueError(f"unknown norm {self.norm!r}")

    def bounds(self, n_docs: int) -> tuple[float, float]:
        """Least and greatest document frequency; whole numbers are counts, others shares."""
        low = self.min_df if isinstance(self.min_df, int) else self.min_df * n_docs
        high = np.inf if self.max_df is None else self.max_df if isinstance(self.max_df, int) else self.max_df * n_docs
        return low, high


@dataclass(frozen=True)
class Plan:
    """What every task has to know of a fit; a few numbers per configuration."""

    loss: str
    problems: tuple[Problem, ...]
    n_classes: int
    n_train: dict[int, int]
    weighting: Weighting
    views: tuple[tuple[int, int], ...] = field(default=())
    #: Whether all numbers are kept in double precision, where that does not follow from the columns.
    exact: bool | None = None

    @property
    def view_of(self) -> np.ndarray:
        """The (max_n, fold) of each problem, as a place in ``views``."""
        return np.array([self.views.index((p.max_n, p.fold)) for p in self.problems])

    def joined(self, values: np.ndarray) -> np.ndarray:
        """Sums over the classes that share a fit; the last axis holds classes."""
        return values.sum(axis=-1, keepdims=True) if self.loss == "softmax" else values

    @property
    def c(self) -> np.ndarray:
        return np.array([p.c for p in self.problems])

    @property
    def kind(self) -> type:
        """Of stored numbers; sums are always in double precision."""
        exact = len(self.problems) * self.n_classes <= EXACT_COLUMNS if self.exact is None else self.exact
        return np.float64 if exact else np.float32

    def scale(self, df: np.ndarray, words: int | np.ndarray) -> np.ndarray:
        """Weight of a term in every view, by its document frequency per fold; 0 outside of the view's terms."""
        folds = sorted(self.n_train)
        df = df.reshape(len(df), len(folds))
        out = np.zeros((len(df), len(self.views)))
        for v, (max_n, fold) in enumerate(self.views):
            n, own = self.n_train[fold], df[:, folds.index(fold)].astype(np.float64)
            low, high = self.weighting.bounds(n)
            idf = np.log((1.0 + n) / (1.0 + own)) + 1.0 if self.weighting.use_idf else np.ones_like(own)
            out[:, v] = np.where((words <= max_n) & (own > 0) & (own >= low) & (own <= high), idf, 0.0)
        return out

    def columns(self, words: int) -> np.ndarray:
        """Places (problem x class, flat) of the problems that use terms of so many words."""
        uses = np.array([p.max_n >= words for p in self.problems])
        return np.nonzero(np.repeat(uses, self.n_classes))[0]

    def trains(self, fold: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which documents each problem is trained on."""
        return (fold[:, None] != np.array([p.fold for p in self.problems])) & (y >= 0)[:, None]


def _packed(**columns) -> bytes:
    """Columns as bytes."""
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _shrunk(value) -> bytes:
    """A pickled value, compressed: blocks are stored and shuffled."""
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out:
        out.write(pickle.dumps(value, protocol=5))
    return sink.getvalue().to_pybytes()


def _grown(data: bytes):
    return pickle.loads(pa.CompressedInputStream(pa.BufferReader(data), "zstd").read())


def _small(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _read(rows: pa.Table, words: pa.ChunkedArray, max_n: int, folds: list[int], binary: bool, occurrences: bool) -> tuple[dict, dict]:
    """Documents as counts of numbered terms, and the terms: name, hash, words, training documents per fold."""
    y, fold = (rows.column(c).to_numpy().astype(np.int64) for c in ("y", "fold"))
    lengths = rows.column("n_words").to_numpy().astype(np.int64)
    words = words.unify_dictionaries()
    names = words.chunk(0).dictionary.cast(pa.string())
    codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False).astype(np.int32) for c in words.chunks])
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    hashes = pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object))
    kinds = [(names, hashes, np.ones(len(names), np.int8))]
    places, owners = [codes], [owner]
    if max_n == 2 and len(codes) > 1:
        inside = owner[1:] == owner[:-1]
        pairs, place = np.unique(codes[:-1][inside].astype(np.int64) * len(names) + codes[1:][inside], return_inverse=True)
        first, second = pairs // len(names), pairs % len(names)
        joined = pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), " ")
        mixed = hashes[first] * np.uint64(0x9E3779B97F4A7C15) ^ (hashes[second] >> np.uint64(1))
        kinds.append((joined, mixed, np.full(len(pairs), 2, np.int8)))
        places.append((place.reshape(-1) + len(names)).astype(np.int32))
        owners.append(owner[1:][inside])
    n_terms = sum(len(k[1]) for k in kinds)
    keys = np.concatenate(owners).astype(np.int64)
    keys *= max(n_terms, 1)
    keys += np.concatenate(places)
    del places, owners, codes, owner
    keys, tf = np.unique(keys, return_counts=True)
    owner, index = (keys // max(n_terms, 1)).astype(np.int32), (keys % max(n_terms, 1)).astype(np.int32)
    trained = {f: ((y >= 0) & (fold != f))[owner] for f in folds}
    found = {f: np.bincount(index[t], tf[t] if occurrences else None, n_terms).astype(np.int64) for f, t in trained.items()}
    docs = {
        "docs": rows.column("doc").to_pylist(),
        "y": y,
        "fold": fold,
        "sizes": np.bincount(owner, minlength=len(y)),
        "index": index,
        "tf": _small(np.ones_like(tf) if binary else tf),
    }
    terms = {
        "name": pa.chunked_array([k[0] for k in kinds]),
        "hash": (np.concatenate([k[1] for k in kinds]) >> np.uint64(32)).astype(np.uint32),
        "words": np.concatenate([k[2] for k in kinds]),
        **{f"df{i}": _small(found[f]) for i, f in enumerate(folds)},
    }
    return docs, terms


def _cut(max_n: int, folds: list[int], binary: bool, occurrences: bool, block_words: int, block_rows: int):
    """Rows of documents as blocks of documents: ``cut, n_terms, docs, terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        rows, words, n_words, at_once = [], [], 0, min(500, block_rows)

        def block() -> pa.RecordBatch:
            docs, terms = _read(pa.concat_tables(rows), pa.chunked_array(words), max_n, folds, binary, occurrences)
            pa.default_memory_pool().release_unused()
            values = [number], [len(terms["hash"])], [_shrunk(docs)], [_packed(**terms)]
            kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["cut", "n_terms", "docs", "terms"])

        for batch in batches:
            for low in range(0, batch.num_rows, at_once):
                part = pa.table(batch.slice(low, at_once).to_struct_array().flatten(), names=batch.schema.names)
                found = part.column("words").combine_chunks()
                found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
                n = pc.fill_null(pc.list_value_length(found), 0)
                rows.append(part.drop_columns(["words"]).append_column("n_words", n))
                words.append(found.flatten().dictionary_encode())
                n_words += max_n * len(words[-1])
                if n_words >= block_words or sum(r.num_rows for r in rows) >= block_rows:
                    yield block()
                    rows, words, n_words, number = [], [], 0, number + 1
        if rows:
            yield block()

    return run


def _dealt(n_parts: int):
    """The terms of blocks, in groups by their hash: ``part, block, terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("terms")):
                terms = _unpacked(data.as_py())
                part = (terms.column("hash").to_numpy() % np.uint32(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
                for p in np.nonzero(np.diff(cuts))[0]:
                    places = order[cuts[p] : cuts[p + 1]]
                    some = terms.take(pa.array(places)).drop_columns(["hash"])
                    packed = _packed(place=places.astype(np.int32), **{c: some.column(c) for c in some.column_names})
                    values = [int(p)], [block], [packed]
                    kinds = pa.int64(), pa.int64(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["part", "block", "terms"])

    return run


def _numbered(n_folds: int):
    """What a group's terms are over all blocks, for each block: document frequencies, and a number where blocks share the term."""

    def run(table: pa.Table) -> pa.Table:
        tables = [_unpacked(t) for t in table.column("terms").to_pylist()]
        together = pa.concat_tables([t.select(["name"]) for t in tables]).column("name").combine_chunks().dictionary_encode()
        if isinstance(together, pa.ChunkedArray):
            together = together.unify_dictionaries().combine_chunks()
        code = together.indices.to_numpy(zero_copy_only=False)
        n = len(together.dictionary)
        words = np.concatenate([t.column("words").to_numpy() for t in tables])
        df = [np.bincount(code, np.concatenate([t.column(f"df{i}").to_numpy() for t in tables]), n).astype(np.int64) for i in range(n_folds)]
        shared = np.bincount(code, minlength=n) > 1
        kind = np.zeros(n, np.int8)
        kind[code] = words
        number = np.full(n, -1, np.int32)
        for k in (1, 2):
            mine = np.nonzero(shared & (kind == k))[0]
            number[mine] = np.arange(len(mine))
        out, low = [], 0
        for t in tables:
            own = code[low : low + t.num_rows]
            low += t.num_rows
            found = {"place": t.column("place"), "number": number[own], **{f"df{i}": _small(d[own]) for i, d in enumerate(df)}}
            out.append(_packed(**found))
        return pa.table({"block": table.column("block"), "part": table.column("part"), "terms": pa.array(out, pa.binary())})

    return run


def _built(plan: Plan):
    """Block of documents as arrays: counts by document in sections (words of a term; shared with other blocks or not)."""

    def run(cut: pa.Table, found: pa.Table) -> pa.Table:
        names = {"block": pa.int64(), "payload": pa.binary(), "names": pa.binary()}
        if not cut.num_rows:
            return pa.table({k: pa.array([], t) for k, t in names.items()})
        docs, own = _grown(cut.column("docs")[0].as_py()), _unpacked(cut.column("terms")[0].as_py())
        n_terms, n_docs, folds = own.num_rows, len(docs["y"]), sorted(plan.n_train)
        number, part = np.full(n_terms, -1, np.int32), np.zeros(n_terms, np.int64)
        df = np.zeros((n_terms, len(folds)), np.int64)
        for p, data in zip(found.column("part").to_pylist(), found.column("terms").to_pylist()):
            terms = _unpacked(data)
            place = terms.column("place").to_numpy()
            number[place], part[place] = terms.column("number").to_numpy(), p
            for i in range(len(folds)):
                df[place, i] = terms.column(f"df{i}").to_numpy()
        words = own.column("words").to_numpy()
        used = plan.scale(df, words).any(axis=1)
        owner = np.repeat(np.arange(n_docs), docs["sizes"])
        payload, listed, squares = {"y": docs["y"], "fold": docs["fold"], "sections": []}, [], np.zeros((n_docs, len(plan.views)))
        for n in (1, 2):
            for shared in (True, False):
                mine = np.nonzero(used & (words == n) & ((number >= 0) == shared))[0]
                if shared:
                    mine = mine[np.lexsort((number[mine], part[mine]))]
                place = np.full(n_terms, -1, np.int64)
                place[mine] = np.arange(len(mine))
                index = place[docs["index"]]
                here = index >= 0
                section = {
                    "words": n, "shared": shared, "df": _small(df[mine]), "index": index[here].astype(np.int32), "tf": docs["tf"][here],
                    "sizes": np.bincount(owner[here], minlength=n_docs).astype(np.int32), "part": part[mine] if shared else None,
                    "number": number[mine] if shared else None,
                }
                payload["sections"].append(section)
                listed.append(own.column("name").take(pa.array(mine)))
                if plan.weighting.norm:
                    scale, power = plan.scale(section["df"], n), int(plan.weighting.norm[1])
                    for v in range(len(plan.views)):
                        squares[:, v] += np.bincount(owner[here], (section["tf"] * scale[section["index"], v]) ** power, n_docs)
        if plan.weighting.norm:
            size = squares ** (1.0 / int(plan.weighting.norm[1]))
            payload["lengths"] = np.where(size > 0, 1.0 / np.where(size > 0, size, 1.0), 0.0)
        else:
            payload["lengths"] = np.ones_like(squares)
        kept = pickle.dumps({"docs": docs["docs"], "terms": [_packed(name=t) for t in listed]})
        values = cut.column("block")[:1], pa.array([_shrunk(payload)], pa.binary()), pa.array([kept], pa.binary())
        return pa.table(dict(zip(names, values)))

    return run


class Block:
    """Products of a block's features with numbers of its documents or terms, column by column."""

    def __init__(self, payload: bytes, plan: Plan):
        self.__dict__.update(_grown(payload))
        self.plan = plan
        self.train = plan.trains(self.fold, self.y)
        self.shape = (len(self.y), len(plan.problems), plan.n_classes)

    def view(self, column: int) -> int:
        return int(self.plan.view_of[column // self.plan.n_classes])

    def to_terms(self, section: dict, of_docs: np.ndarray, columns: Sequence[int]) -> Iterator[np.ndarray]:
        """For each column the sums over the documents of count x value / length, for each term."""
        index, n = section["index"].astype(np.intp), len(section["df"])
        for c in columns:
            values = of_docs[:, c] * self.lengths[:, self.view(c)]
            yield np.bincount(index, np.repeat(values, section["sizes"]) * section["tf"], n)

    def to_docs(self, section: dict, of_terms: np.ndarray, column: int) -> np.ndarray:
        """Sums over the documents' terms of count x value / length."""
        filled = np.nonzero(section["sizes"])[0]
        out = np.zeros(self.shape[0])
        if len(filled):
            starts = (np.cumsum(section["sizes"]) - section["sizes"])[filled]
            out[filled] = np.add.reduceat(of_terms[section["index"]] * section["tf"], starts)
        return out * self.lengths[:, self.view(column)]

    def groups(self, section: dict) -> Iterator[tuple[int, slice]]:
        """Groups of shared terms, and where the section holds them."""
        cuts = np.concatenate([[0], np.nonzero(np.diff(section["part"]))[0] + 1, [len(section["part"])]])
        for low, high in zip(cuts[:-1], cuts[1:]):
            if high > low:
                yield int(section["part"][low]), slice(low, high)


def _spread(numbers: Sequence[int], cut: DataFrame) -> DataFrame:
    """``cut, block``: numbers for blocks that a shuffle by them deals out evenly."""
    spark = cut.sparkSession
    n = _partitions(spark, len(numbers))
    wanted = -(-max(len(numbers), 1) // n)
    tried = spark.range(n * (wanted + 20) * 2).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at"))
    free = {}
    for r in tried.orderBy("id").collect():
        free.setdefault(r["at"], []).append(r["id"])
    used = [ids[turn] for turn in range(wanted) for _, ids in sorted(free.items()) if len(ids) > turn]
    named = used[: len(numbers)] if len(used) >= len(numbers) else range(len(numbers))
    return spark.createDataFrame(list(zip(numbers, named)), "cut long, block long")


def _partitions(spark, n_blocks: int) -> int:
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(min(n_blocks, most), 1)


def in_blocks(
    df: DataFrame,
    doc_id: str,
    text: str | Column,
    label: str,
    fold: str,
    problems: Sequence[Problem],
    loss: str,
    weighting: Weighting,
    block_words: int = BLOCK_WORDS,
    block_rows: int = BLOCK_ROWS,
) -> tuple[Plan, list, DataFrame]:
    """The plan, the labels in order and the stored blocks ``block, payload, names``.

    ``text`` names a text, or is an array of words. Rows without a label take
    part as documents to predict only. Documents stay
    in the partition they are read in; only terms are shuffled, once per block.
    Numbers that reach the driver: the labels, the rows per fold, the blocks.
    """
    max_n = max(p.max_n for p in problems)
    folds = sorted({p.fold for p in problems})
    known = df.where(F.col(label).isNotNull() & F.col(fold).isNotNull()).select(F.col(label).alias("label"), F.col(fold).cast("int").alias("fold"))
    counts = known.groupBy("label").agg(*[F.count_if(F.col("fold") != f).alias(f"n{f}") for f in folds]).orderBy("label").collect()
    labels = [r["label"] for r in counts]
    n_train = {f: sum(r[f"n{f}"] for r in counts) for f in folds}
    views = tuple(sorted({(p.max_n, p.fold) for p in problems}))
    plan = Plan(loss, tuple(problems), max(len(labels), 1), n_train, weighting, views)

    y = F.lit(-1)
    for code, value in enumerate(labels):
        y = F.when(F.col(label) == F.lit(value), code).otherwise(y)
    rows = df.select(
        F.col(doc_id).cast("string").alias("doc"), y.alias("y"), F.coalesce(F.col(fold).cast("int"), F.lit(-1)).alias("fold"),
        (ngram_tokens(text, 1, weighting.stop_words) if isinstance(text, str) else text).alias("words"),
    )
    cut = rows.mapInArrow(_cut(max_n, folds, weighting.binary, weighting.occurrences, block_words, block_rows), "cut long, n_terms long, docs binary, terms binary")
    with small_batches(df.sparkSession):
        cut = written(cut, "linear-cut", large_rows=True)
    sizes = {r["cut"]: r["n_terms"] for r in cut.select("cut", "n_terms").orderBy("cut").collect()}
    spread = _spread(list(sizes), cut)
    named = cut.join(F.broadcast(spread), "cut").select("block", "docs", "terms")
    n_terms, columns = sum(sizes.values()), len(problems) * plan.n_classes
    n_parts = max(-(-n_terms // TERMS), -(-n_terms * columns // (4 * CELLS)), min(len(sizes), df.sparkSession.sparkContext.defaultParallelism), 1)
    dealt = named.select("block", "terms").mapInArrow(_dealt(n_parts), "part long, block long, terms binary")
    found = dealt.groupBy("part").applyInArrow(_numbered(len(folds)), "block long, part long, terms binary")
    by_block = named.groupBy("block").cogroup(found.groupBy("block"))
    blocks = by_block.applyInArrow(_built(plan), "block long, payload binary, names binary")
    return plan, labels, written(blocks, "linear-blocks", large_rows=True)


@contextmanager
def kept(blocks: DataFrame, *more: str):
    """Blocks that stay with their partitions over all steps; lost ones are read again."""
    n_blocks = blocks.select("block").count()
    held = blocks.select("block", "payload", *more).repartition(_partitions(blocks.sparkSession, n_blocks), "block")
    held = held.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        held.count()
        yield held, n_blocks
    finally:
        held.unpersist()
