"""Secret scan: fixed patterns, and spans found by two character Markov models."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_slices, taken

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8
KINDS = ("assign", "access", "hex", "random")

#: What the models judge: runs of these characters, of this length at least.
LEAST_RUN = 20
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_-]{4,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
_SIZE = len(ALPHABET) + 1  # the last is the start of a string
_CODE = np.full(128, _SIZE - 1, np.int16)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

#: Documents whose runs train the models (expected number, picked by a hash of the key), and drawn random strings.
TRAIN_DOCUMENTS = 2000
DRAWN_STRINGS = 2000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base patterns' matches (start, end, kind) in code points.

    Runs too short are left out of the hex and access patterns themselves, which match the same: a run's shorter
    tails can't be long enough either. An assignment is matched first and dropped afterwards.
    """
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Sorted spans as ranges that don't overlap: nested and overlapping ones together."""
    out: list[tuple[int, int]] = []
    for a, b, _ in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def transitions(strings: list[str]) -> np.ndarray:
    """Counts of character pairs, each string with its start."""
    counts = np.zeros(_SIZE * _SIZE, np.int64)
    for s in strings:
        code = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)].astype(np.int64)
        counts += np.bincount(np.append(_SIZE - 1, code[:-1]) * _SIZE + code, minlength=_SIZE * _SIZE)
    return counts


def drawn_strings(n: int = DRAWN_STRINGS, seed: int = 7) -> list[str]:
    """Random strings over the alphabets that keys are commonly written in."""
    draw = random.Random(seed)
    kinds = ("0123456789abcdef", ALPHABET[:62], ALPHABET[26:62], ALPHABET[:64], ALPHABET[:62] + "_-")
    return ["".join(draw.choices(kinds[i % len(kinds)], k=draw.randint(16, 48))) for i in range(n)]


class MarkovPair:
    """First-order models of random strings and of ordinary words; `score` is the mean log-likelihood ratio."""

    def __init__(self, random_counts: np.ndarray, ordinary_counts: np.ndarray, smoothing: float = 0.5, backing: float = 8.0):
        def log(counts: np.ndarray) -> np.ndarray:
            """Pairs backed by the frequencies of single characters, so that a context never seen tells something too."""
            table = counts.reshape(_SIZE, _SIZE).astype(float)
            single = table.sum(0) + smoothing
            return np.log((table + backing * single / single.sum()) / (table.sum(1, keepdims=True) + backing))

        self.ratio = (log(random_counts) - log(ordinary_counts)).ravel()

    def score(self, s: str) -> float:
        code = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)].astype(np.int64)
        return float(self.ratio[np.append(_SIZE - 1, code[:-1]) * _SIZE + code].mean())


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = TRAIN_DOCUMENTS) -> MarkovPair:
    """Fit both models on labelled strings of about `sample` documents and on drawn random strings.

    Strings inside base matches are labelled random, all other runs ordinary. Only pair counts (a table of fixed
    size) come to the driver. An empty table leaves the drawn strings and smoothing.
    """
    share = min(1.0, sample / max(1, docs.count()))
    rows = docs.select(F.lit(0).alias("key"), F.col(text).alias("text")).filter(
        F.pmod(F.xxhash64(docs[key], F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)
    )

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [np.zeros(_SIZE * _SIZE, np.int64), np.zeros(_SIZE * _SIZE, np.int64)]
            for t in pc.fill_null(batch.column(1), "").to_pylist():
                spans = apart(base_spans(t))
                counts[1] += transitions([r for a, b in spans for r in ORDINARY.findall(t[a:b]) if len(r) >= 16])
                ends = [0, *(x for span in spans for x in span), len(t)]
                counts[0] += transitions([r for a, b in zip(ends[::2], ends[1::2], strict=True) if a < b for r in ORDINARY.findall(t[a:b])])
            where = [np.flatnonzero(c) for c in counts]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([0, 1], list(map(len, where)))), pa.array(np.concatenate(where)), pa.array(np.concatenate([c[w] for c, w in zip(counts, where, strict=True)]))],
                names=["random", "pair", "n"],
            )

        return step

    counts = np.zeros((2, _SIZE * _SIZE), np.int64)
    for r in map_slices(rows, work, "random long, pair long, n long").groupBy("random", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r["random"], r["pair"]] = r["n"]
    return MarkovPair(counts[1] + transitions(drawn_strings()), counts[0])


def all_spans(text: str, model: MarkovPair, threshold: float) -> list[tuple[int, int, str]]:
    """Base matches and, apart from them, the runs that the models take for random strings."""
    spans = base_spans(text)
    taken, k, added = apart(spans), 0, []  # both they and the runs are in order, so one walk tells which are apart
    for m in RUN.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if (k == len(taken) or m.end() <= taken[k][0]) and model.score(m[0]) > threshold:
            added.append((m.start(), m.end(), "random"))
    return sorted(spans + added, key=lambda s: (s[0], KINDS.index(s[2]))) if added else spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each span (overlapping ones together) replaced by a mark."""
    out, at = [], 0
    for a, b in apart(spans):
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, model: MarkovPair, threshold: float = 1.0, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Secrets of every whole text: key, n_assign, n_access, n_hex, n_random, base_sha256, spans and redacted.

    `spans` lists kind:start:end by start, then kind, in code points; `base_sha256` digests the base ones alone.
    A null text is empty and has no span. Repeated rows are scanned each, a null key is passed on, other columns
    are not read, and an empty table gives an empty result. With `carry` the whole input row follows as the struct
    `row`.
    """
    rows, key_type, row, inner = taken(docs, key, text, carry)

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            found = [all_spans(t, model, threshold) for t in texts]
            count = lambda kind: pa.array([sum(s[2] == kind for s in spans) for spans in found], pa.int64())
            base = [hashlib.sha256(joined([s for s in spans if s[2] != "random"]).encode()).hexdigest() for spans in found]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *map(count, KINDS), pa.array(base, pa.string()), pa.array(list(map(joined, found)), pa.string()), pa.array(list(map(redacted, texts, found)), pa.string()), *batch.columns[2:]],
                names=["key", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "redacted", *batch.schema.names[2:]],
            )

        return step

    schema = f"key {key_type}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string{row}"
    return map_slices(rows, work, schema, inner=inner).withColumnRenamed("key", key)
