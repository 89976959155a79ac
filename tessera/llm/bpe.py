"""Byte-level BPE: token counts by rank-synchronous merging; encoding by speculation and verification.

Both read a public vocabulary in the `tokenizers` JSON format (byte-level BPE with the GPT-2 split pattern and no
normaliser); the path is a parameter and the file is never copied.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from ._arrow import map_slices, taken

# Fixed value: the split pattern of this public tokenizer family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words remembered per task. Beyond it the memory is emptied and filled again; results do not depend on it.
CACHE_WORDS = 100_000
#: Failing or counted words of more symbols than this are merged one at a time: rank by rank as well, all places of a
#: rank together, but from lists of places, since a pass over a very long word for each of its ranks is far slower.
LONG_WORD = 2048
_SHIFT = 20
_NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def newer_characters() -> str:
    """Letters and numbers that the `regex` module knows and the tokenizers' older Unicode tables don't.

    Of the characters that are unassigned in Python's own tables, the library's splitter is asked for each whether
    it stays with a letter or a digit before it. Returned as the inside of a character class.
    """
    ask = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    new = [
        c
        for before, kind in (("a", r"\p{L}"), ("1", r"\p{N}"))
        for c in regex.findall(kind, every)
        if unicodedata.category(c) == "Cn" and len(ask(before + c)) > 1
    ]
    runs: list[list[int]] = []
    for c in sorted(map(ord, new)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in runs)


def is_latin(text: str) -> bool:
    """Whether all characters are of Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ByteBPE:
    """A vocabulary with its merges as numpy tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError(f"{path}: byte-level BPE without a normaliser or prefix space is needed")
        alphabet = byte_alphabet()
        self.bytes_of: dict[int, bytes] = {i: bytes(alphabet[c] for c in s) for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys, rank = (left << _SHIFT) | right, np.arange(len(pairs), dtype=np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], rank[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.byte_id = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int32)
        n = max(self.bytes_of) + 1
        #: The merge that makes each token: its rank (-1 for single bytes) and its two parts.
        self.made = np.full(n, -1, np.int32)
        self.part = np.zeros((2, n), np.int64)
        self.made[self.merged], self.part[0, self.merged], self.part[1, self.merged] = rank, left, right
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        new = newer_characters()
        self.new = regex.compile(f"[{new}]") if new else None
        #: Whether the newer characters lie beyond Latin-1, so that most European texts needn't be searched for them.
        self.new_is_far = all(int(x, 16) > 0xFF for x in regex.findall(r"\\U([0-9a-f]{8})", new))
        old = SPLIT.replace(r" ?\p{L}+", rf" ?(?:(?![{new}])\p{{L}})+").replace(r" ?\p{N}+", rf" ?(?:(?![{new}])\p{{N}})+")
        self.split_old = regex.compile(old.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])+"))
        self._ranks: dict[int, int] | None = None
        self._greedy: tuple[dict[bytes, int], dict[bytes, int]] | None = None

    def words(self, text: str) -> tuple[list[str], list[int]]:
        """The pre-tokens of a text; a special string's id comes as the (negative) place in the second list."""
        split = self.split
        if self.new is not None and not text.isascii() and not (self.new_is_far and is_latin(text)) and self.new.search(text):
            split = self.split_old
        if self.cut is None or not any(s in text for s in self.special):
            return split.findall(text), []
        words: list[str] = []
        at: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                at.append(len(words))
                words.append(part)
            elif part:
                words += split.findall(part)
        return words, at

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, _NONE where there is none."""
        key = (left.astype(np.int64) << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte symbols of all words end to end, and the words' lengths."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        return self.byte_id[flat], np.fromiter(map(len, words), np.int64, len(words))

    def merge(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge a ragged batch rank-synchronously; returns the surviving symbols and their counts by word.

        Each round finds every word's lowest rank and replaces all places of that pair at once (every other one
        where they overlap, from the left). A pair that a merge makes ranks after it, so this is the order in
        which one merge at a time, leftmost first, would go. Words without a pair left leave the batch.
        """
        word = np.repeat(np.arange(len(lens)), lens)
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(sym)))
            rank = np.full(len(sym), _NONE, np.int32)
            rank[:-1] = self.rank(sym[:-1], sym[1:])
            rank[first + size - 1] = _NONE
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least != _NONE, size)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank = sym[live], word[live], rank[live]
                size = size[least != _NONE]
                least = least[least != _NONE]
            hit = np.flatnonzero(rank == np.repeat(least, size))
            if not len(hit):
                break
            place = np.arange(len(hit))
            run = np.append(True, hit[1:] != hit[:-1] + 1)
            hit = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            sym = sym.copy()
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(lens), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(lens))

    def merge_long(self, sym: np.ndarray) -> list[int]:
        """The same merging for one very long word: by rank, with the places of each rank at hand."""
        if self._ranks is None:
            self._ranks = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        ranks, ids = self._ranks, sym.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        heap: list[int] = []

        def note(i: int) -> None:
            if i >= 0 and after[i] < n and (r := ranks.get(ids[i] << _SHIFT | ids[after[i]])) is not None:
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(i)

        for i in range(n - 1):
            note(i)
        while heap:
            r = heapq.heappop(heap)
            for i in sorted(places.pop(r)):
                j = after[i]
                if ids[i] < 0 or j >= n or ranks.get(ids[i] << _SHIFT | ids[j]) != r:
                    continue
                ids[i], ids[j], after[i] = int(self.merged[r]), -1, after[j]
                if after[j] < n:
                    before[after[j]] = i
                note(before[i])
                note(i)
        return [x for x in ids if x >= 0]

    # Speculation and verification

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Propose tokens by longest match from the left, among tokens that encode to themselves."""
        if self._greedy is None:
            own = [(b, i) for i, b in self.bytes_of.items() if i not in set(self.special.values())]
            sym, n = self.merge(*self.symbols([b for b, _ in own]))
            first = np.cumsum(n) - n
            fits = (n == 1) & (sym[first] == np.array([i for _, i in own]))
            table = {b: i for (b, i), ok in zip(own, fits.tolist(), strict=True) if ok}
            reach: dict[bytes, int] = {}  # the longest token by its first two bytes
            for b in table:
                reach[b[:2]] = max(reach.get(b[:2], 1), len(b))
            self._greedy = table, reach
        table, reach = self._greedy
        flat: list[int] = []
        lens = np.zeros(len(words), np.int64)
        for k, w in enumerate(words):
            i, n, before = 0, len(w), len(flat)
            while i < n:
                j = n if n - i < 16 else min(n, i + reach.get(w[i : i + 2], 1))
                while (t := table.get(w[i:j])) is None:
                    j -= 1
                flat.append(t)
                i = j
            lens[k] = len(flat) - before
        return np.array(flat, np.int64), lens

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the bytes of token a followed by those of token b gives back (a, b), for each pair.

        Undo the merges inside both tokens from the latest to the earliest. At each step the symbols on either
        side of the seam are those that stood there before the merge just undone; had their own pair a lower
        rank, BPE would have merged across the seam. On equal ranks the leftmost place goes first: a pair inside
        a goes before the seam, the seam before a pair inside b.
        """
        ok = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        # Times (doubled ranks, so that ties can be told) before which a merge across the seam would come first.
        limit = np.full(len(a), 2**62, np.int64)
        while len(at):
            r = self.rank(x, y)
            bad = (r != _NONE) & (2 * r.astype(np.int64) + 1 < limit)
            ok[at[bad]] = False
            rx, ry = self.made[x], self.made[y]
            left = rx > ry
            top = np.maximum(rx, ry)
            go = ~bad & (top >= 0)
            at, x, y, left, top = at[go], x[go], y[go], left[go], top[go].astype(np.int64)
            limit = 2 * top + np.where(left, 1, 2)
            x, y = np.where(left, self.part[1, x], x), np.where(left, y, self.part[0, y])
        return ok

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        ids, lens = self.greedy(words)
        ends = np.cumsum(lens)
        inner = np.ones(len(ids), bool)
        inner[ends - 1] = False
        seam = np.flatnonzero(inner)
        broken = seam[~self.compatible(ids[seam], ids[seam + 1])]
        failing = np.unique(np.searchsorted(ends, broken, "right")).tolist()
        packed = ids.astype("<u4").tobytes()
        cuts = (4 * np.append(0, ends)).tolist()
        out = [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        short = [i for i in failing if len(words[i]) <= LONG_WORD]
        if short:
            sym, n = self.merge(*self.symbols([words[i] for i in short]))
            packed, cuts = sym.astype("<u4").tobytes(), (4 * np.append(0, np.cumsum(n))).tolist()
            for k, i in enumerate(short):
                out[i] = packed[cuts[k] : cuts[k + 1]]
        for i in failing:
            if len(words[i]) > LONG_WORD:
                out[i] = np.array(self.merge_long(self.symbols([words[i]])[0]), "<u4").tobytes()
        return out

    def count_words(self, words: list[bytes]) -> list[int]:
        """The number of tokens of each word."""
        short = [w for w in words if len(w) <= LONG_WORD]
        counts = iter(self.merge(*self.symbols(short))[1].tolist())
        return [next(counts) if len(w) <= LONG_WORD else len(self.merge_long(self.symbols([w])[0])) for w in words]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


class _Memo:
    """Values of words, worked out in batches as they first occur."""

    def __init__(self, work):
        self.work, self.known = work, {}

    def look_up(self, lists: list[list[str]]) -> dict:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = list(set().union(*lists).difference(self.known))
        if new:
            self.known.update(zip(new, self.work([w.encode() for w in new]), strict=True))
        return self.known


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Pre-tokens are held as ragged numpy arrays and merged rank-synchronously. A null text counts as empty: 0
    bytes, 0 tokens. Texts are never cut. Rows with the same key are counted each on their own, a null key is
    passed on, other columns are not read, and an empty table gives an empty result.
    """

    def work():
        bpe = load(path)
        memo = _Memo(bpe.count_words)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pc.fill_null(batch.column(1), "")
            lists, special = [], []
            for t in texts.to_pylist():
                words, at = bpe.words(t)
                lists.append(without(words, at))
                special.append(len(at))
            known = memo.look_up(lists)
            n = [sum(map(known.__getitem__, w)) + s for w, s in zip(lists, special, strict=True)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["key", "n_bytes", "n_tokens", "over_limit"],
            )

        return step

    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_slices(rows, work, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)


def without(words: list[str], places: list[int]) -> list[str]:
    """The words that aren't at one of the places."""
    if not places:
        return words
    gone = set(places)
    return [w for i, w in enumerate(words) if i not in gone]


def encode_ids(bpe: ByteBPE, memo: _Memo, texts: list[str]) -> list[bytes]:
    """The ids of whole texts as packed little-endian unsigned 32-bit integers."""
    split = [bpe.words(t) for t in texts]
    plain = [without(words, at) for words, at in split]
    known = memo.look_up(plain)
    out = []
    for words, at in split:
        if at:
            marks = set(at)
            out.append(b"".join(bpe.special[w].to_bytes(4, "little") if i in marks else known[w] for i, w in enumerate(words)))
        else:
            out.append(b"".join(map(known.__getitem__, words)))
    return out


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digest: bool = False, carry: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns the key, n_tokens, ids (array<int>) and decoded; with `digest`, instead of the last two, ids_sha256
    (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded text in UTF-8).

    Longest matches propose tokens, vectorised checks test every adjacent pair, and only words with a pair that
    fails are merged exactly. A null text counts as empty, with no ids. Repeated rows are encoded each on their
    own, a null key is passed on, other columns are not read, and an empty table gives an empty result. With `carry`
    the whole input row follows as the struct `row`.
    """
    rows, kind, row, inner = taken(docs, key, text, carry)

    def work():
        bpe = load(path)
        memo = _Memo(bpe.encode_words)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = encode_ids(bpe, memo, pc.fill_null(batch.column(1), "").to_pylist())
            decoded = [bpe.decode(np.frombuffer(p, "<u4")) for p in packed]
            columns = [batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64())]
            if digest:
                columns += [
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                ]
            else:
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                ids = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
                columns += [pa.ListArray.from_arrays(ends, ids), pa.array(decoded, pa.string())]
            return pa.RecordBatch.from_arrays(columns + batch.columns[2:], names=["key", "n_tokens", "x", "y", *batch.schema.names[2:]])

        return step

    names = ("ids_sha256 string", "decoded_sha256 string") if digest else ("ids array<int>", "decoded string")
    out = map_slices(rows, work, f"key {kind}, n_tokens long, x {names[0].split()[1]}, y {names[1].split()[1]}{row}", inner=inner)
    return out.toDF(key, "n_tokens", *(n.split()[0] for n in names), *(["row"] if carry else []))
