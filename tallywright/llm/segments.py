"""Content-defined segments: the exchange format for finding repeated windows.

A document is a sequence of units (words or bytes), a window is ``k`` of them
in a row. A window's anchor is the gram of ``m`` units in it with the smallest
hash, the leftmost of equals; it depends on the window's content alone, so
equal windows have equal anchors wherever they stand. A segment is a run of
windows with one anchor. So a document becomes a few rows, one per segment,
with the anchor's hash as route: windows of different routes cannot be equal,
windows of one route meet in one shard.

The work is done in this order, each step on what the one before left over:

1. count routes (narrow rows, combined in the map tasks),
2. collect the segments of routes that occur twice (route, content hash, place),
3. collapse equal segments: all but one of a group of copies need no index,
4. fetch the content of segments whose route has several distinct segments,
   and give it to an index per shard.

Filters of bounded size (bitmaps) save shuffling what cannot match; exact joins
follow them, so a full bitmap costs speed and never results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import written
from .common import byte_texts, slices

SLICE_BYTES = 2 << 20
#: Bits of a filter: 2^26 bits are 8 MB, whatever the data.
FILTER_BITS = 26
BITMAP = 32_768
NO_ID = np.iinfo(np.int64).max


#: Bits of a gram's hash that its place in the slice replaces; a slice has fewer grams than that.
PLACE_BITS = 32


@dataclass(frozen=True)
class Shape:
    """``unit`` is "word" or "byte"; windows of ``window`` units, anchors of ``gram`` units."""

    unit: str
    window: int
    gram: int

    @property
    def anchors(self) -> int:
        return self.window - self.gram + 1


def _odd_powers(n: int, base: int, _memory: dict = {}) -> np.ndarray:
    """``base`` to the power 0..n-1, modulo 2^64."""
    known = _memory.get(base)
    if known is None or len(known) < n:
        powers = np.full(max(n, 1 << 16), base, np.uint64)
        powers[0] = 1
        known = _memory[base] = np.cumprod(powers, dtype=np.uint64)
    return known[:n]


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit hash over all others."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(codes: np.ndarray, m: int) -> np.ndarray:
    """A hash of each ``m`` codes in a row: differences of prefix sums of a polynomial, shifted to the origin."""
    n = len(codes)
    if n < m:
        return np.empty(0, np.uint64)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(codes * _odd_powers(n, BASE), out=prefix[1:])
    return mixed((prefix[m:] - prefix[:-m]) * _odd_powers(n - m + 1, INVERSE))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Cut:
    """Segments of one slice of documents: for each its document, route, first window, and number of windows."""

    document: np.ndarray
    route: np.ndarray
    start: np.ndarray
    windows: np.ndarray


def cut(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, shape: Shape) -> Cut:
    """Segments of documents that lie one after the other in ``codes``; starts count from each document's own."""
    none = np.empty(0, np.int64)
    if len(codes) < shape.window:
        return Cut(none, none, none, none)
    grams = gram_hashes(codes, shape.gram)
    # The same bits give way to the place in every slice, so that equal windows have equal anchors wherever they lie.
    place = np.uint64((1 << PLACE_BITS) - 1)
    tagged = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(tagged, shape.anchors) & place).astype(np.int64)
    counts = np.maximum(stops - starts - shape.window + 1, 0)
    document = np.repeat(np.arange(len(starts)), counts)
    first = np.cumsum(counts) - counts
    window = np.arange(len(document)) - first[document] + starts[document]
    if not len(window):
        return Cut(none, none, none, none)
    anchor = anchor[window]
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])]))
    return Cut(
        document[head],
        grams[anchor[head]].view(np.int64),
        window[head] - starts[document[head]],
        np.diff(np.append(head, len(window))),
    )


@dataclass
class Slice:
    """Documents of a slice: their bytes, units as codes, and where units lie in the bytes."""

    texts: list[bytes]
    codes: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    words: list[list[bytes]] | None

    def content(self, document: int, start: int, length: int) -> bytes:
        if self.words is None:
            return self.texts[document][start : start + length]
        return b" ".join(self.words[document][start : start + length])


def opened(texts: list[bytes], shape: Shape) -> Slice:
    if shape.unit == "byte":
        words, counts = None, np.fromiter(map(len, texts), np.int64, len(texts))
        codes = BYTE_CODES[np.frombuffer(b"".join(texts), np.uint8)]
    else:
        words = [t.split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(texts))
        total = int(counts.sum())
        codes = np.fromiter((xxh3_64_intdigest(w) for x in words for w in x), np.uint64, total)
    stops = np.cumsum(counts)
    return Slice(texts, codes, stops - counts, stops, words)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (part for whole in batches for part in slices(whole, "text", SLICE_BYTES))


def identified(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``doc_id, twin, text`` and ``more``: ``twin`` tells texts of the same id apart; a null id is the largest number."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("doc_id"),
        F.xxhash64(text_col).alias("twin"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *more,
    )


def bitmap_parts(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """A bitmap of the low ``bits`` bits of a column of longs, in parts of 4 KB: ``part, bits``."""
    low = F.col(column).bitwiseAND((1 << bits) - 1)
    position = F.expr(f"bitmap_bit_position(({column} & {BITMAP - 1}) + 1)")
    return keys.groupBy(F.shiftright(low, 15).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(position).alias("bits")
    )


def bitmap_of(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """The bitmap in the driver: 2^bits / 8 bytes, however many keys there are."""
    flat = np.zeros((1 << bits) // 8, np.uint8)
    for row in bitmap_parts(keys, column, bits).collect():
        flat[row["part"] * (BITMAP // 8) : (row["part"] + 1) * (BITMAP // 8)] = np.frombuffer(row["bits"], np.uint8)
    return flat


def in_bitmap(flat: np.ndarray, keys: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    low = keys & np.int64((1 << bits) - 1)
    return (flat[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def route_counts(docs: DataFrame, shape: Shape) -> DataFrame:
    """``route, n`` of the routes that occur at least twice."""

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            piece = opened(byte_texts(batch.column("text")), shape)
            values, counts = np.unique(cut(piece.codes, piece.starts, piece.stops, shape).route, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["route", "n"])

    rows = docs.select("text").mapInArrow(routes, "route long, n long")
    return rows.groupBy("route").agg(F.sum("n").alias("n")).where("n > 1")


def repeated_segments(docs: DataFrame, shape: Shape, name: str) -> DataFrame:
    """``route, content, doc_id, twin, start, windows`` of all segments whose route occurs at least twice."""
    repeated = written(route_counts(docs, shape), f"{name}-routes").select("route")
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(repeated, "route"))
    width = 8 if shape.unit == "word" else 1

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            piece = opened(byte_texts(batch.column("text")), shape)
            found = cut(piece.codes, piece.starts, piece.stops, shape)
            wanted = np.flatnonzero(in_bitmap(bitmap.value, found.route))
            document, start, windows = found.document[wanted], found.start[wanted], found.windows[wanted]
            units = memoryview(piece.codes.tobytes() if width == 8 else b"".join(piece.texts))
            a = (piece.starts[document] + start) * width
            b = a + (windows + shape.window - 1) * width
            content = [xxh3_64_intdigest(units[x:y]) for x, y in zip(a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.route[wanted]),
                    pa.array(np.array(content, np.uint64).view(np.int64)),
                    batch.column("doc_id").take(pa.array(document)),
                    batch.column("twin").take(pa.array(document)),
                    pa.array(start),
                    pa.array(windows),
                ],
                names=["route", "content", "doc_id", "twin", "start", "windows"],
            )

    schema = "route long, content long, doc_id long, twin long, start long, windows long"
    rows = docs.mapInArrow(segments, schema)
    return written(rows.join(repeated, "route", "left_semi"), f"{name}-segments")


def distinct_segments(segments: DataFrame, name: str) -> DataFrame:
    """One row per distinct segment: ``route, content, doc_id, twin, start`` of the first occurrence, ``windows, copies``."""
    first = F.min(F.struct("doc_id", "twin", "start")).alias("first")
    rows = segments.groupBy("route", "content").agg(first, F.first("windows").alias("windows"), F.count(F.lit(1)).alias("copies"))
    return written(rows.select("route", "content", "first.*", "windows", "copies"), name)


def split_documents(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Documents that may be among ``ids`` (``doc_id, twin``), and those that certainly are not.

    The choice is made in place, with a broadcast bitmap of at most 2^bits / 8 bytes.
    """
    key = F.xxhash64("doc_id", "twin").bitwiseAND((1 << bits) - 1)
    parts = written(bitmap_parts(ids.select(key.alias("key")), "key", bits), "document-filter")
    keyed = docs.withColumn("key", key).withColumn("part", F.shiftright("key", 15).cast("int"))
    tested = keyed.join(F.broadcast(parts), "part", "left")
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast((key & {BITMAP - 1}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    tested = tested.withColumn("byte", F.coalesce(byte, F.lit(0)))
    hit = F.expr("(shiftright(byte, cast(key % 8 as int)) & 1) = 1")
    return tuple(tested.where(test).select(*docs.columns) for test in (hit, ~hit))


def fetch_contents(docs: DataFrame, wanted: DataFrame, shape: Shape, carried: list[str]) -> DataFrame:
    """The rows of ``wanted`` (``doc_id, twin, start, windows``, ``carried``) with their ``bytes``.

    Words are joined by one space. Wanted segments of a document are gathered
    into one row, which its length bounds.
    """
    piece = F.struct("start", "windows", *carried)
    lists = wanted.groupBy("doc_id", "twin").agg(F.collect_list(piece).alias("pieces"))
    maybe, _ = split_documents(docs, wanted)
    rows = maybe.join(lists, ["doc_id", "twin"]).select("doc_id", "twin", "text", "pieces")
    names = ["doc_id", "twin", "start", "windows", *carried, "bytes"]
    schema = "".join(f"{c} long, " for c in names[:-1]) + "bytes binary"

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            texts = byte_texts(batch.column("text"))
            pieces = batch.column("pieces")
            counts = pa.compute.list_value_length(pieces).to_numpy(zero_copy_only=False)
            document = np.repeat(np.arange(len(texts)), counts)
            flat = pieces.flatten()
            start, windows = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "windows"))
            words = [t.split() for t in texts] if shape.unit == "word" else None
            piece = Slice(texts, np.empty(0), np.empty(0), np.empty(0), words)
            content = [
                piece.content(d, s, n + shape.window - 1)
                for d, s, n in zip(document.tolist(), start.tolist(), windows.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(pa.array(document)) for c in ("doc_id", "twin")],
                    *[flat.field(c) for c in ("start", "windows", *carried)],
                    pa.array(content, pa.binary()),
                ],
                names=names,
            )

    return rows.mapInArrow(take, schema)


def single_windows(contents: DataFrame, shape: Shape) -> DataFrame:
    """The rows of ``contents`` cut into segments of one window each, without their bytes."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "bytes", SLICE_BYTES // 16)):
            rows = []
            for row in batch.to_pylist():
                units = row["bytes"].split(b" ") if shape.unit == "word" else row["bytes"]
                for i in range(row["windows"]):
                    window = units[i : i + shape.window]
                    content = xxh3_64_intdigest(b" ".join(window) if shape.unit == "word" else window)
                    rows.append((row["route"], content, row["doc_id"], row["twin"], row["start"] + i, 1))
            columns = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(np.array(c, np.uint64).view(np.int64) if i == 1 else c, pa.int64()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=["route", "content", "doc_id", "twin", "start", "windows"])

    schema = "route long, content long, doc_id long, twin long, start long, windows long"
    return contents.select("route", "doc_id", "twin", "start", "windows", "bytes").mapInArrow(single, schema)


def later_copies(segments: DataFrame, distinct: DataFrame) -> DataFrame:
    """Occurrences of a segment after its first one: ``doc_id, twin, start, windows``."""
    first = F.struct("doc_id", "twin", "start").alias("first")
    copied = distinct.where("copies > 1").select("route", "content", first)
    rows = segments.join(copied, ["route", "content"]).where(F.struct("doc_id", "twin", "start") != F.col("first"))
    return rows.select("doc_id", "twin", "start", "windows")


def all_copies(segments: DataFrame, distinct: DataFrame) -> DataFrame:
    """All occurrences of segments that occur twice or more: ``doc_id, twin, start, windows``."""
    copied = distinct.where("copies > 1").select("route", "content")
    rows = segments.join(copied, ["route", "content"], "left_semi")
    return rows.select("doc_id", "twin", "start", "windows")


def repeated_windows(
    docs: DataFrame,
    shape: Shape,
    name: str,
    copies: Callable[[DataFrame, DataFrame], DataFrame],
    index: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    shard_bytes: int,
    hot_route: int,
) -> DataFrame:
    """Runs of window starts to remove: ``doc_id, twin, start, windows`` (one row per run).

    ``copies`` picks occurrences of collapsed segments; ``index`` gets a shard's
    distinct segments (``doc_id, twin, start, windows, copies, bytes``) and
    yields the runs it finds. A route with more than ``hot_route`` distinct
    segments would make one large shard: its segments are cut into single
    windows, for which equal content is all there is to find, and collapsed
    like segments.
    """
    segments = repeated_segments(docs, shape, name)
    distinct = distinct_segments(segments, f"{name}-distinct")
    per_route = distinct.groupBy("route").agg(F.count(F.lit(1)).alias("kinds"), F.sum("windows").alias("total"))
    several = written(per_route.where("kinds > 1"), f"{name}-several")
    wanted = distinct.join(several.select("route", "kinds"), "route")
    contents = written(
        fetch_contents(docs, wanted, shape, ["route", "kinds", "copies"]), f"{name}-contents"
    )
    shared = contents.where(F.col("kinds") <= hot_route)
    total = shared.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    placed = shared.repartition(shards, "route").select("doc_id", "twin", "start", "windows", "copies", "bytes")
    found = placed.mapInArrow(index, "doc_id long, twin long, start long, windows long")
    runs = copies(segments, distinct).unionByName(found)
    hot = contents.where(F.col("kinds") > hot_route)
    if not hot.isEmpty():
        windows = written(single_windows(hot, shape), f"{name}-windows")
        runs = runs.unionByName(copies(windows, distinct_segments(windows, f"{name}-single")))
    return runs


def remove_windows(docs: DataFrame, runs: DataFrame, shape: Shape) -> DataFrame:
    """``doc_id, n_units, n_removed, n_spans, kept`` (bytes) per document; every unit of a run's windows goes."""
    runs = written(runs, "removed-runs")
    lists = runs.groupBy("doc_id", "twin").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    maybe, untouched = split_documents(docs, runs)
    none = F.array().cast("array<struct<start:long,windows:long>>")
    marked = maybe.join(lists, ["doc_id", "twin"], "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
    rows = marked.unionByName(untouched.select("doc_id", "text", none.alias("runs")))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            texts = byte_texts(batch.column("text"))
            results = []
            for text, found in zip(texts, batch.column("runs").to_pylist()):
                units = text.split() if shape.unit == "word" else text
                change = np.zeros(len(units) + 1, np.int64)
                for run in found:
                    change[run["start"]] += 1
                    change[run["start"] + run["windows"] + shape.window - 1] -= 1
                gone = np.cumsum(change[:-1]) > 0
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                if not spans:
                    kept = b" ".join(units) if shape.unit == "word" else units
                elif shape.unit == "word":
                    kept = b" ".join(units[i] for i in np.flatnonzero(~gone).tolist())
                else:
                    kept = np.frombuffer(units, np.uint8)[~gone].tobytes()
                results.append((len(units), int(gone.sum()), spans, kept))
            columns = list(zip(*results))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns[:3]), pa.array(columns[3], pa.binary())],
                names=["doc_id", "n_units", "n_removed", "n_spans", "kept"],
            )

    cleaned = rows.mapInArrow(remove, "doc_id long, n_units long, n_removed long, n_spans long, kept binary")
    return cleaned.withColumn("doc_id", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")))
