"""Periodic runs of words, found by internal pattern matching over dyadic blocks.

A run is a stretch of consecutive words with smallest period q and at least `times` q words that no neighbour extends.
The block of 2^k words that starts first in such a run, for the largest 2^k up to q, occurs again q words later. So every
dyadic block asks where it occurs in the window that starts one to two block lengths further on: its suffix array range
is known from the naming of blocks, and a wavelet tree over the suffix array gives the range's next place. A block's
places in such a window are one arithmetic progression; of a long one only those distances can be a new period whose
ends line up with the ends of the block's own run. Candidates are extended both ways by the names of blocks.

Blocks of one level stand for all periods up to the shortest block, since runs shorter than `least` words don't count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words
from ._arrow import map_slices, taken

#: Runs have at least so many words and so many periods.
LEAST, TIMES = 24, 3


class Names:
    """Names of all stretches of 2^k symbols: equal stretches have equal names, in lexicographic order.

    `names[k]` has one entry more than there are symbols, -1, which nothing equals. `order` is the suffix array, sorted as
    deep as the longest block.
    """

    def __init__(self, symbols: np.ndarray, longest: int):
        n = len(symbols)
        self.names: list[np.ndarray] = []
        self.first: list[np.ndarray] = []  # by level and name: where its range of the suffix array starts
        _, name, counts = np.unique(symbols, return_inverse=True, return_counts=True)
        while True:
            self.names.append(np.append(name, -1).astype(np.int32))
            self.first.append(np.append(0, np.cumsum(counts)))
            size = 1 << (len(self.names) - 1)
            if len(counts) == n or 2 * size > longest:
                break
            after = np.zeros(n, np.int64)
            after[: n - size] = name[size:] + 1
            _, name, counts = np.unique(name * np.int64(n + 1) + after, return_inverse=True, return_counts=True)
        self.order = np.argsort(self.names[-1][:n], kind="stable")

    def range(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffix array has the stretches that equal those of 2^level symbols at `at`."""
        name = self.names[level][at]
        return self.first[level][name], self.first[level][name + 1]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from places i and j (i < j) on are equal."""
        i, j = i.copy(), j.copy()
        start = j.copy()
        for k in reversed(range(len(self.names))):
            names, more = self.names[k], np.arange(len(i))
            while len(more):
                more = more[names[i[more]] == names[j[more]]]
                i[more] += 1 << k
                j[more] += 1 << k
                if k < len(self.names) - 1:
                    break  # a shorter block matches once at most
        return j - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before places i and j (i < j) are equal."""
        i, j, last = i.copy(), j.copy(), len(self.names[0]) - 1
        start = j.copy()
        for k in reversed(range(len(self.names))):
            names, size, more = self.names[k], 1 << k, np.arange(len(i))
            while len(more):
                there = np.where(i[more] >= size, i[more] - size, last)
                more = more[names[there] == names[np.maximum(j[more] - size, 0)]]
                i[more] -= size
                j[more] -= size
                if k < len(self.names) - 1:
                    break
        return start - j


class Wavelet:
    """A wavelet tree (its levels laid out as one row of bits each) over a sequence of numbers below 2^bits."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros = []
        for j in reversed(range(self.bits)):
            zero = (values >> j & 1) == 0
            self.zeros.append(np.append(0, np.cumsum(zero)).astype(np.int32))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many entries of each range [lo, hi) are less than `value`."""
        out, lo, hi = np.zeros(len(lo), np.int64), lo.astype(np.int64), hi.astype(np.int64)
        every = np.where(value >> self.bits > 0, hi - lo, -1)  # for values that all entries are less than
        for j, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, b, one = zeros[lo], zeros[hi], (value >> j & 1) == 1
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, lo - a + zeros[-1], a), np.where(one, hi - b + zeros[-1], b)
        return np.where(every >= 0, every, out)

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The entry of each range [lo, hi) with k smaller ones."""
        out, lo, hi, k = np.zeros(len(lo), np.int64), lo.astype(np.int64), hi.astype(np.int64), k.astype(np.int64)
        for j, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            out += np.where(one, 1 << j, 0)
            k -= np.where(one, b - a, 0)
            lo, hi = np.where(one, lo - a + zeros[-1], a), np.where(one, hi - b + zeros[-1], b)
        return out


def _candidates(names: Names, tree: Wavelet, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the blocks of a level, with distances that may be periods around them."""
    n, size = len(names.order), 1 << level
    at = np.arange(0, n - size + 1, size)
    lo, hi = names.range(level, at)
    at, lo, hi = (x[hi - lo > 1] for x in (at, lo, hi))
    start = tree.below(lo, hi, at + size)
    count = tree.below(lo, hi, at + 2 * size) - start
    found = []

    def occurrence(of: np.ndarray, k: int) -> np.ndarray:
        return tree.kth(lo[of], hi[of], start[of] + k)

    once = np.flatnonzero(count > 0)
    first = np.zeros(len(at), np.int64)
    first[once] = occurrence(once, 0)
    found.append((at[once], first[once] - at[once]))
    twice = np.flatnonzero(count > 1)
    second = occurrence(twice, 1)
    found.append((at[twice], second - at[twice]))
    # Three and more are a progression: its ends must be where those of the run around the block itself are.
    long = count[twice] > 2
    i, x, step, most = at[twice][long], first[twice][long], (second - first[twice])[long], count[twice][long]
    right = names.forward(x, x + step) - names.forward(i, i + step)
    left = names.backward(i, i + step) - names.backward(x, x + step)
    for gap in (right, left):
        k = gap // step
        fits = (gap % step == 0) & (k >= 0) & (k < most)
        found.append((i[fits], (x - i + k * step)[fits]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs_of(symbols: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """The runs of a sequence of numbers, as rows (start, length, period) in order of start, then period.

    `longest` bounds the length of any run (pieces between numbers that occur once).
    """
    shortest = max(0, (least // 3).bit_length() - 1)  # a block of 2^shortest symbols serves all periods up to its size
    if times < 3:
        raise ValueError("runs have three periods at least")
    n = len(symbols)
    if n < least:
        return np.zeros((0, 3), np.int64)
    names = Names(symbols, max(longest // times, 1 << shortest))
    tree = Wavelet(names.order)
    levels = range(shortest, len(names.names))
    found = [_candidates(names, tree, level) for level in levels]
    if levels:  # short periods: the first place after the block
        size = 1 << shortest
        at = np.arange(0, n - size + 1, size)
        lo, hi = names.range(shortest, at)
        at, lo, hi = (x[hi - lo > 1] for x in (at, lo, hi))
        before = tree.below(lo, hi, at + 1)
        more = before < hi - lo
        at, lo, hi, before = (x[more] for x in (at, lo, hi, before))
        distance = tree.kth(lo, hi, before) - at
        found.append((at[distance <= size], distance[distance <= size]))
    if not sum(len(f[0]) for f in found):
        return np.zeros((0, 3), np.int64)
    at, period = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    start = at - names.backward(at, at + period)
    end = at + period + names.forward(at, at + period)
    keep = end - start >= np.maximum(least, times * period)
    rows = np.stack([start, end, period], 1)[keep]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # A stretch that several periods explain has the smallest: the others are its multiples.
    rows = rows[np.append(True, (np.diff(rows[:, :2], axis=0) != 0).any(1))[: len(rows)]]
    rows[:, 1] -= rows[:, 0]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _repeating(hashes: np.ndarray, offsets: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges of words, each in one text, outside of which no run has a word.

    All stretches of `least // 3` words of a run come again in it; such stretches are at least so many in a row.
    """
    size = least // 3
    grams = _words.spans(hashes, size)
    if not len(grams):
        return []
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[: len(grams)] == doc[size - 1 :]
    key = _words.mix(grams + doc[: len(grams)].astype(np.uint64) * _words._GOLDEN)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(grams) + 2, bool)
    again[1:-1][order[1:][same]] = True
    again[1:-1][order[:-1][same]] = True
    again[1:-1] &= inside
    edge = np.flatnonzero(np.diff(again.astype(np.int8)))
    return [(a, b + size - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= least - size + 1]


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row: key, n_words, runs (start, length, period; by start, then period) and collapsed.

    Words part at the bytes 0x20 and 0x09 to 0x0D and are numbered from 0. A run has at least `least` words and `times`
    (3 or more) of its smallest period, and neither neighbour extends it with that period. `collapsed` leaves out each
    word that some run has after that run's first period, and joins the others by one space.

    A null text has no words; neither null nor empty texts have runs, and their `collapsed` is empty. Texts of any length
    are judged whole, in memory of some hundred bytes for each word of their repeating stretches. Rows are judged each on
    its own, repeated ones alike; a null key is passed on, other columns are not read, whatever they are called, and an
    empty table gives an empty result. Nothing is shuffled.
    """
    rows, kind, _, _ = taken(docs, key, text)

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, bounds = _words.buffers(batch.column(1))
            starts, ends, _ = _words.word_bounds(data, bounds)
            hashes, offsets = _words.word_hashes(data, bounds, fold=False)
            found = _runs(data, starts, ends, _repeating(hashes, offsets, least), least, times)
            doc = np.searchsorted(offsets, found[:, 0], "right") - 1
            held = np.zeros(len(starts) + 1, np.int64)
            np.add.at(held, found[:, 0] + found[:, 2], 1)
            np.add.at(held, found[:, 0] + found[:, 1], -1)
            dropped = np.cumsum(held)[:-1] > 0
            cuts = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            columns = [pa.array(found[:, 0] - offsets[doc]), pa.array(found[:, 1]), pa.array(found[:, 2])]
            runs = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(columns, names=["start", "length", "period"]))
            kept = _words.joined(data, bounds, starts, ends, offsets, ~dropped)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), runs, kept], names=["key", "n_words", "runs", "collapsed"])

        return step

    schema = f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_slices(rows, work, schema).withColumnRenamed("key", key)


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: list[tuple[int, int]], least: int, times: int) -> np.ndarray:
    """The runs of words inside `pieces`, with the words compared themselves."""
    if not pieces:
        return np.zeros((0, 3), np.int64)
    held, known = data.tobytes(), {}
    symbols, place, first = [], [], [0]
    for n, (a, b) in enumerate(pieces):
        symbols += [known.setdefault(held[x:y], len(known)) for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
        symbols.append(-1 - n)  # parts the pieces: occurs once
        place.append(a)
        first.append(len(symbols))
    found = runs_of(np.array(symbols, np.int64), max(b - a for a, b in pieces), least, times)
    piece = np.searchsorted(first, found[:, 0], "right") - 1
    found[:, 0] += np.array(place, np.int64)[piece] - np.array(first, np.int64)[piece]
    return found[np.lexsort((found[:, 2], found[:, 0]))]
