"""Benchmark decontamination: Wu-Manber search for the word windows of test items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_slices, taken

WINDOW = 10
#: Words of a block of the shift tables.
BLOCK = 3
#: Test items are searched in passes of at most this many bytes of words, so that the tables of a pass, some hundred
#: times the text, fit beside a task. Where there are more passes, so much text of documents is searched in one go.
PASS_BYTES, HELD_BYTES = 1 << 20, 64 << 20

# ASCII letters in lower case, digits and all other characters make words; the rest of ASCII parts them.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class WuManber:
    """Patterns of one length over words, sought together.

    `last` skips by the last word of a place alone, `shift` by its last block; a shift of 0 leads to the bucket of
    the patterns that end in this block, which are compared word for word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.last: dict[bytes, int] = {}
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[list[bytes], frozenset[str]]]] = {}
        for pattern, items in patterns.items():
            for j, w in enumerate(pattern):
                self.last[w] = min(self.last.get(w, length), length - 1 - j)
            for j in range(self.block, length + 1):
                key = pattern[j - self.block : j]
                self.shift[key] = min(self.shift.get(key, length), length - j)
            self.bucket.setdefault(pattern[length - self.block :], []).append((list(pattern), frozenset(items)))

    def search(self, words: list[bytes]) -> Iterable[tuple[int, frozenset[str]]]:
        """Each start of an occurrence, with the items of the pattern."""
        m, block, n = self.length, self.block, len(words)
        last, shift, far = self.last.get, self.shift.get, self.length - self.block + 1
        i = m - 1
        while i < n:
            if skip := last(words[i], m):
                i += skip
                continue
            key = tuple(words[i - block + 1 : i + 1])
            if skip := shift(key, far):
                i += skip
                continue
            place = words[i - m + 1 : i + 1]
            for pattern, items in self.bucket[key]:
                if pattern == place:
                    yield i - m + 1, items
            i += 1


#: Words of an item and the length of its windows: a pass holds pieces of items.
Piece = tuple[str, list[bytes], int]


def pieces(name: str, text: str | None, window: int, most: int) -> Iterator[Piece]:
    """An item's words in pieces of about `most` bytes at most that overlap, so that each window lies in one of them."""
    words = words_of(text)
    size = min(window, len(words))
    if not size:
        return
    start, held = 0, 0
    for i, w in enumerate(words):
        held += len(w) + 1
        if held > most and i - start >= size:
            yield name, words[start:i], size
            start = i - size + 1
            held = sum(len(x) + 1 for x in words[start : i + 1])
    yield name, words[start:], size


def searchers(held: Iterable[Piece]) -> list[WuManber]:
    """One automaton for each length of patterns: the window, and the lengths of shorter items."""
    by: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for name, words, size in held:
        for i in range(len(words) - size + 1):
            by.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(name)
    return [WuManber(patterns, size) for size, patterns in sorted(by.items())]


def _passes(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> Iterator[list[Piece]]:
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    for r in rows.toLocalIterator():
        for piece in pieces(r["i"], r["t"], window, most):
            n = sum(map(len, piece[1])) + len(piece[1])
            if held and size + n > most:
                yield held
                held, size = [], 0
            held.append(piece)
            size += n
    if held:
        yield held


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    pass_bytes: int = PASS_BYTES,
    carry: bool = False,
) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items, items_sha256 and contaminated (n_hit > 0).

    A window is `window` consecutive words of a test item; an item of fewer words, but not none, is one window. A
    document's word is hit if it lies in any occurrence of a window; `items` are those with occurring windows,
    sorted as strings.

    The test items are a stated query set: their words go to all tasks in passes of bounded size, long items in
    overlapping pieces. Documents are scanned once, in one stage: a task builds the tables of a pass, searches the
    documents that it holds (all of its input, one slice at a time, where there is one pass; HELD_BYTES of it where there
    are more), and goes on to the next pass. Nothing is shuffled. A null text has no words; null item names
    count as empty strings; repeated items and rows count once by name and each on their own. Other columns are
    not read, and an empty table gives an empty result, an empty benchmark no hits. With `carry` the whole input row
    follows as the struct `row`.
    """
    rows, kind, row, inner = taken(docs, key, text, carry)
    share = docs.sparkSession.sparkContext.broadcast
    passes = [share(held) for held in _passes(benchmark, item, item_text, window, pass_bytes)]

    def work():
        only = searchers(passes[0].value) if len(passes) == 1 else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = list(map(words_of, batch.column(1).to_pylist()))
            marks: list[bytearray | None] = [None] * len(texts)
            names: list[set[str]] = [set() for _ in texts]
            for held in passes:
                for a in only or searchers(held.value):
                    ones = b"\x01" * a.length
                    for n, words in enumerate(texts):
                        for i, found in a.search(words):
                            if marks[n] is None:
                                marks[n] = bytearray(len(words))
                            marks[n][i : i + a.length] = ones
                            names[n] |= found
            items = list(map(sorted, names))
            hits = [sum(m) if m else 0 for m in marks]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(hits, pa.int64()), pa.array(list(map(len, items)), pa.int64()), pa.array(items, pa.list_(pa.string())),
                    pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in items], pa.string()), pa.array([h > 0 for h in hits], pa.bool_()), *batch.columns[2:],
                ],
                names=["key", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", *batch.schema.names[2:]],
            )

        return step

    schema = f"key {kind}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean{row}"
    held = {"most": HELD_BYTES, "gather": HELD_BYTES} if len(passes) > 1 else {}
    return map_slices(rows, work, schema, inner=inner, **held).withColumnRenamed("key", key)
