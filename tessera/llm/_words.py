"""Word and shingle hashes of whole texts, vectorised over Arrow buffers.

Words are runs of anything but the bytes 0x20 and 0x09 to 0x0D. Hashes have 64 bits and depend on the words alone,
so they agree between tasks and machines. Every step mixes its input before it adds, so that no pattern of equal
parts, however long, cancels out; what must be told exactly is compared itself by the operators, or by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
#: Parts of eight bytes that long words are hashed by at a time.
PARTS = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Masks of the first 0 to 8 bytes of a little-endian number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of texts that lie end to end start and end, and the n+1 word offsets of the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.append(True, space[:-1]) | edge[:-1]
    after = np.append(space[1:], True) | edge[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, bounds: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie end to end, and the n+1 word offsets of the texts.

    `fold` takes A-Z as a-z. A word is read eight bytes at a time; each part is mixed with its place in the word.
    """
    starts, ends, offsets = word_bounds(data, bounds)
    return range_hashes(data, starts, ends, fold), offsets


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """Hashes of ranges of bytes, none of them empty."""
    if not len(starts):
        return np.zeros(0, _U)
    size = ends - starts
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = _LOWER[data] if fold else data
    eight = np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))
    out = mix(mix(eight[starts] & _LOW[np.minimum(size, 8)]) + size.astype(_U) * _GOLDEN)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8  # parts after the first
        last = np.cumsum(more)
        rest = np.zeros(len(long), _U)
        for i in range(0, int(last[-1]), PARTS):
            part = np.arange(i, min(i + PARTS, int(last[-1])))
            word = np.searchsorted(last, part, "right")
            k = part - (last - more)[word] + 1
            at = starts[long[word]] + 8 * k
            value = eight[at] & _LOW[np.minimum(ends[long[word]] - at, 8)]
            np.add.at(rest, word, mix(mix(value) + k.astype(_U) * _GOLDEN))
        out[long] = mix(out[long] + rest)
    return out


def spans(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all ranges of `length` words of a word sequence, by where they start.

    Ranges are put together from halves of halves, each mixed before it is used.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    half, size, at, out = words, 1, 0, None
    while True:
        if length & size:
            out = half[at : at + n] if out is None else mix(out * _GOLDEN + half[at : at + n])
            at += size
        if 2 * size > length:
            return mix(out + _U(length * int(_GOLDEN) % (1 << 64)))
        half = mix(half[:-size] * _GOLDEN + half[size:])
        size *= 2


def shingle_sets(words: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingles (sorted hashes) of each text; a text of fewer words is one shingle, one without none."""
    out = []
    every = spans(words, size)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        else:
            out.append(spans(words[a:b], b - a) if b > a else np.zeros(0, _U))
    return out


def joined(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Of each text the words to keep, joined by one space; without a list of words."""
    held = ~_SPACE[data]
    if not keep.all():
        edge = np.zeros(len(data) + 1, np.int8)
        np.add.at(edge, starts[~keep], 1)
        np.add.at(edge, ends[~keep], -1)
        held &= np.cumsum(edge[:-1], dtype=np.int8) == 0
    kept = np.flatnonzero(keep)
    doc = np.searchsorted(offsets, kept, "right") - 1
    gap = ends[kept[:-1][doc[1:] == doc[:-1]]]  # a white space byte, as another word of this text follows
    out = data.copy()
    out[gap] = 0x20
    held[gap] = True
    at = np.append(0, np.cumsum(held))[bounds]
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out[held])])
