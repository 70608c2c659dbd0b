"""Suffix and common-prefix arrays by external induced sorting.

Suffixes are divided into L (larger than the one that follows) and S types. The
leftmost S suffixes (LMS) are sorted by recursion on a shorter string of names;
from their order a scan upwards induces all L suffixes, and a scan downwards all
S suffixes. A scan takes suffixes from a priority queue in order of their first
symbol; each suffix taken puts the one before it in the text, if it is of the
wanted type, into the queue. The queue holds tuples of position and common
prefix with the tuple before it in its bucket, in order; whole rounds of a
bucket are taken at once, and buckets that exceed the memory limit are kept in
an unnamed scratch file. The text and the results are memory-mapped files.

Common prefixes are carried along: those of two induced neighbours are one more
than the least common prefix between the suffixes that induced them. Values
stop at a cap, as only a threshold is of interest.

Symbol 0 ends a sequence. All its occurrences differ: the later one is the
smaller, and none is ever part of a common prefix.
"""

from __future__ import annotations

import tempfile
from bisect import bisect_right

import numpy as np

#: Tuples that the queues of a scan keep in memory, and names that are sorted in memory.
MEMORY_TUPLES = 4 << 20
MEMORY_NAMES = 2 << 20
ROUND = 1 << 18
#: Rounds of so many suffixes are handled one by one.
FEW = 12


def scratch_array(n: int, dtype) -> np.ndarray:
    """An array in an unnamed file of the task's temp folder; it goes with the array."""
    if not n:
        return np.empty(0, dtype)
    return np.asarray(np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,)))


class BucketQueue:
    """A priority queue of (position, prefix) tuples with symbols as priorities; ties come out in order of arrival."""

    def __init__(self, memory: int = MEMORY_TUPLES):
        self.parts: dict[int, list] = {}
        self.size, self.memory, self.file = 0, memory, None

    def push(self, symbol: int, position: np.ndarray, prefix: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append((position, prefix))
        self.size += len(position)
        if self.size > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.parts.values():
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    self.file.seek(0, 2)
                    at = self.file.tell()
                    self.file.write(part[0].tobytes())
                    self.file.write(part[1].tobytes())
                    parts[i] = (at, len(part[0]))
        self.size = 0

    def take(self, symbol: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a symbol, in order, in pieces."""
        taken = []
        for a, b in self.parts.pop(symbol, []):
            if isinstance(a, np.ndarray):
                self.size -= len(a)
                taken.append((a, b))
            else:
                self.file.seek(a)
                position = np.frombuffer(self.file.read(8 * b), np.int64)
                taken.append((position, np.frombuffer(self.file.read(2 * b), np.int16)))
        return taken


class RangeLeast:
    """Least value of any range of an array."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.rows = np.empty((n.bit_length(), n), values.dtype)
        self.rows[0] = values
        for k in range(1, len(self.rows)):
            span, m = 1 << (k - 1), n - (1 << k) + 1
            np.minimum(self.rows[k - 1, :m], self.rows[k - 1, span : span + m], out=self.rows[k, :m])

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For non-empty ranges from ``a`` up to, without, ``b``."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        return np.minimum(self.rows[level, a], self.rows[level, b - (1 << level)])


class Scan:
    """One scan: takes suffixes in order and induces the ones before them into the queue."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, symbols: int, cap: int, memory: int):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queue = BucketQueue(memory)
        self.rest = np.zeros(symbols, np.int16)  # least prefix after a bucket's last tuple, in the round that gave it
        self.round_of = np.full(symbols, -1)
        self.round = 0
        self.stack_rounds: list[int] = []  # suffix minima of the rounds' least prefixes
        self.stack_least: list[int] = []

    def _since(self, rounds: np.ndarray) -> np.ndarray:
        """Least prefix in the rounds after each of ``rounds``."""
        at = np.searchsorted(self.stack_rounds, rounds, side="right")
        return np.append(np.array(self.stack_least, np.int16), np.int16(self.cap))[at]

    def feed(self, position: np.ndarray, prefix: np.ndarray) -> None:
        """Scan suffixes in order; ``prefix`` is what each shares with the one scanned before it."""
        for a in range(0, len(position), ROUND):
            self._feed(position[a : a + ROUND], prefix[a : a + ROUND])

    def _after(self, least: int) -> None:
        """Close a round whose least prefix is ``least``."""
        while self.stack_least and self.stack_least[-1] >= least:
            self.stack_least.pop()
            self.stack_rounds.pop()
        self.stack_least.append(least)
        self.stack_rounds.append(self.round)
        self.round += 1

    def _feed_few(self, position: list[int], prefix: list[int]) -> None:
        """``_feed`` for rounds too small to be worth array operations."""
        open_least, found, least = {}, {}, self.cap
        for p, shared in zip(position, prefix):
            least = min(least, shared)
            for symbol in open_least:
                open_least[symbol] = min(open_least[symbol], shared)
            if p == 0 or not self.wanted[p - 1] or not (symbol := int(self.text[p - 1])):
                continue
            if symbol in open_least:
                value = open_least[symbol] + 1
            elif self.round_of[symbol] < 0:
                value = 0
            else:
                at = bisect_right(self.stack_rounds, self.round_of[symbol])
                since = self.stack_least[at] if at < len(self.stack_least) else self.cap
                value = min(int(self.rest[symbol]), since, least) + 1
            found.setdefault(symbol, []).append((p - 1, min(value, self.cap)))
            open_least[symbol] = self.cap
        for symbol, tuples in found.items():
            before, shared = zip(*tuples)
            self.queue.push(symbol, np.array(before, np.int64), np.array(shared, np.int16))
            self.rest[symbol], self.round_of[symbol] = open_least[symbol], self.round
        self._after(least)

    def _feed(self, position: np.ndarray, prefix: np.ndarray) -> None:
        if len(position) <= FEW:
            if len(position):
                self._feed_few(position.tolist(), prefix.tolist())
            return
        before = position - 1
        at = np.flatnonzero((before >= 0) & self.wanted[np.maximum(before, 0)])
        before = before[at]
        symbol = self.text[before].astype(np.int64)
        proper = symbol > 0
        at, before, symbol = at[proper], before[proper], symbol[proper]
        ranges = RangeLeast(prefix)
        if len(at):
            by = np.argsort(symbol, kind="stable")
            at, before, symbol = at[by], before[by], symbol[by]
            head = np.flatnonzero(np.diff(symbol, prepend=-1))
            shared = np.empty(len(at), np.int16)
            follow = np.ones(len(at), bool)
            follow[head] = False
            follow = np.flatnonzero(follow)
            shared[follow] = ranges.least(at[follow - 1] + 1, at[follow] + 1)
            own = symbol[head]
            last_round = self.round_of[own]
            earlier = np.minimum(self.rest[own], self._since(last_round))
            shared[head] = np.minimum(earlier, ranges.least(np.zeros(len(head), np.int64), at[head] + 1))
            shared = np.minimum(shared + 1, self.cap).astype(np.int16)
            shared[head[last_round < 0]] = 0
            tail = np.append(head[1:], len(at)) - 1
            ends = at[tail] + 1
            rest = np.full(len(own), self.cap, np.int16)
            open_end = np.flatnonzero(ends < len(prefix))
            rest[open_end] = ranges.least(ends[open_end], np.full(len(open_end), len(prefix)))
            self.rest[own] = rest
            self.round_of[own] = self.round
            for s, i, j in zip(own.tolist(), head.tolist(), (tail + 1).tolist()):
                self.queue.push(s, before[i:j], shared[i:j])
        self._after(int(prefix.min()))


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes."""
    n = len(text)
    smaller = np.zeros(n, bool)
    smaller[-1] = True
    smaller[:-1] = text[:-1] < text[1:]
    known = np.ones(n, bool)
    known[:-1] = text[:-1] != text[1:]
    known[text == 0] = True
    smaller[text == 0] = True
    places = np.where(known, np.arange(n), n)
    nearest = np.minimum.accumulate(places[::-1])[::-1]
    return smaller[nearest]


def run_lengths(text: np.ndarray, position: np.ndarray, cap: int) -> int:
    """How often the symbol at ``position`` repeats from there, at most ``cap``."""
    piece = text[position : position + cap]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def induce(
    text: np.ndarray, types: np.ndarray, lms: np.ndarray, lms_prefix: np.ndarray, cap: int, memory: int
) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, with the prefix each shares with the one before, from the LMS suffixes in order."""
    n, symbols = len(text), int(text.max()) + 1
    first = text[lms].astype(np.int64)
    present = np.unique(text).astype(np.int64).tolist()
    bounds = np.searchsorted(first, present), np.searchsorted(first, present, side="right")
    larger, larger_prefix = scratch_array(n, np.int64), scratch_array(n, np.int16)
    spans, done = {}, 0
    scan = Scan(text, ~types, symbols, cap, memory)
    for symbol, a, b in zip(present, *bounds):
        start, last = done, None
        while pieces := scan.queue.take(symbol):
            for position, prefix in pieces:
                larger[done : done + len(position)] = position
                larger_prefix[done : done + len(position)] = prefix
                done += len(position)
                scan.feed(position, prefix)
                last = int(position[-1])
        spans[symbol] = (start, done)
        if b > a:
            prefix = lms_prefix[a:b].copy()
            prefix[0] = 0 if last is None or symbol == 0 else seam(text, last, int(lms[a]), cap)
            scan.feed(lms[a:b], prefix)
    order, shared = scratch_array(n, np.int64), scratch_array(n, np.int16)
    end = n
    scan = Scan(text, types, symbols, cap, memory)
    for symbol in reversed(present):
        start, stop = spans[symbol]
        if symbol == 0:
            marks = np.flatnonzero(text == 0)[::-1]
            order[: len(marks)] = marks
            shared[: len(marks)] = 0
            assert end == len(marks)
            break
        last = None
        while pieces := scan.queue.take(symbol):
            for position, prefix in pieces:
                k = len(position)
                order[end - k : end] = position[::-1]
                # A suffix's prefix is the one it shares with the next smaller, which comes after it here.
                shared[end - k + 1 : end] = prefix[1:][::-1]
                if last is not None:
                    shared[end] = prefix[0]
                end -= k
                scan.feed(position, prefix)
                last = int(position[-1])
        if stop > start:
            position, prefix = larger[start:stop][::-1], larger_prefix[start:stop]
            descending = np.empty(len(position), np.int16)
            descending[1:] = prefix[1:][::-1]
            descending[0] = 0 if last is None else seam(text, last, int(position[0]), cap)
            if last is not None:
                shared[end] = descending[0]
            order[end - len(position) : end] = position[::-1]
            shared[end - len(position) : end] = prefix
            shared[end - len(position)] = 0
            end -= len(position)
            scan.feed(position, descending)
        elif last is not None:
            shared[end] = 0
    return order, shared


def seam(text: np.ndarray, a: int, b: int, cap: int) -> int:
    """Common prefix of an L and an S suffix with the same first symbol: the shorter of their runs."""
    return min(run_lengths(text, a, cap), run_lengths(text, b, cap))


def common_symbols(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes, symbol by symbol; end marks never match."""
    shared = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for step in range(cap):
        x, y = text[a[active] + step], text[b[active] + step]
        active = active[(x == y) & (x != 0)]
        if not len(active):
            break
        shared[active] += 1
    return shared


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings, 0 upwards in their order; equal substrings share a name.

    ``lms`` are their positions in text order, ``order`` in sorted order. A
    substring reaches from one LMS position to the next, both included.
    """
    length = np.empty(len(lms), np.int64)
    length[:-1] = np.diff(lms) + 1
    length[-1] = 1
    rank = np.searchsorted(lms, order)
    size = length[rank]
    a, b = order[:-1], order[1:]
    active = np.flatnonzero(size[:-1] == size[1:])
    equal = np.zeros(len(a), bool)
    step = 0
    while len(active):
        x, y = text[a[active] + step], text[b[active] + step]
        active = active[(x == y) & (x != 0)]
        step += 1
        ended = size[active] == step
        equal[active[ended]] = True
        active = active[~ended]
    names = np.empty(len(lms), np.int64)
    names[rank] = np.concatenate([[0], np.cumsum(~equal)])
    return names


def _sort_in_memory(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    from .quality import suffix_ranks

    n = len(names)
    tables = suffix_ranks(names, np.full(n, n))
    order = np.empty(n, np.int64)
    order[tables[-1]] = np.arange(n)
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(tables) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (tables[k][np.minimum(a, n - 1)] == tables[k][np.minimum(b, n - 1)])
        shared[1:] += np.where(same, 1 << k, 0)
        a, b = a + np.where(same, 1 << k, 0), b + np.where(same, 1 << k, 0)
    return order, np.minimum(shared, cap).astype(np.int16)


def sort_suffixes(
    text: np.ndarray, cap: int, memory: int = MEMORY_TUPLES, memory_names: int = MEMORY_NAMES
) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common-prefix array (at most ``cap``) of a text that ends with symbol 0."""
    types = suffix_types(text)
    is_lms = np.zeros(len(text), bool)
    is_lms[1:] = types[1:] & ~types[:-1]
    is_lms[text == 0] = True
    lms = np.flatnonzero(is_lms)
    # Any order of the LMS suffixes within their first symbol induces the order of the LMS substrings.
    by_symbol = lms[::-1][np.argsort(text[lms[::-1]], kind="stable")]
    rough, _ = induce(text, types, by_symbol, np.zeros(len(lms), np.int16), 1, memory)
    order = np.concatenate([c[is_lms[c]] for c in (rough[a : a + ROUND] for a in range(0, len(text), ROUND))])
    names = _names(text, lms, order)
    if int(names.max()) + 1 == len(names):
        sorted_lms = order
        prefix = np.zeros(len(order), np.int64)
        prefix[1:] = common_symbols(text, order[:-1], order[1:], cap)
    else:
        if len(names) <= memory_names:
            reduced, shared = _sort_in_memory(names, cap)
        else:
            reduced, shared = sort_suffixes(names, cap, memory, memory_names)
        sorted_lms = lms[reduced]
        # Equal names stand for equal symbols up to the next LMS position; the first unequal ones are compared.
        prefix = np.zeros(len(reduced), np.int64)
        same = shared[1:].astype(np.int64)
        a, b = reduced[:-1], reduced[1:]
        symbols = lms[a + same] - lms[a]
        prefix[1:] = symbols
        open_end = np.flatnonzero(symbols < cap)
        prefix[1 + open_end] += common_symbols(
            text, sorted_lms[:-1][open_end] + symbols[open_end], sorted_lms[1:][open_end] + symbols[open_end], cap
        )
        prefix = np.minimum(prefix, cap)
    return induce(text, types, sorted_lms, prefix.astype(np.int16), cap, memory)
