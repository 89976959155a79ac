"""Embedding of texts by an injected model, in Arrow batches, and a model-free hashing embedder for tests and fallbacks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.query import WORD_OR_RUN
from tessera.operators.chunks import in_parts

BATCH, DIMENSION = 16, 64
#: Numbers of vectors that a task holds at once.
MOST_NUMBERS = 1 << 16
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Signed hashes of lower-case words, L2-normalised; a text without words is all zero."""
    out = np.zeros((len(texts), dimension))
    for i, text in enumerate(texts):
        for word in WORD_OR_RUN.findall(text.lower()):
            h = zlib.crc32(word.encode())
            out[i, h % dimension] += 1 if h & 0x80000000 else -1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def bounded(text: str, most: int) -> str:
    """A text up to the end of its first `most` words or single CJK characters, what a model of so many tokens reads of it."""
    n, end = 0, 0
    for m in WORD_OR_RUN.finditer(text):
        own = 1 if m[0].isascii() else len(m[0])
        if n + own > most:
            return text[: m.start() + (most - n) if not m[0].isascii() else end]
        n, end = n + own, m.end()
    return text


def embed(text: Column, make: Callable[[], Embedder] = lambda: hashing_embedder, batch: int = BATCH, instruction: str = "", most: int | None = None) -> Column:
    """Vectors of a text column. `make()` loads the model once a task; it is given at most `batch` texts at a time.

    Null texts are embedded as empty ones. `instruction` is put before each text, as models want it of queries; with `most`
    a text is cut after so many tokens, the instruction among them.
    """

    def vectors(model: Embedder, texts: pd.Series) -> Iterator[list[float]]:
        for i in range(0, len(texts), batch):
            held = [instruction + t for t in texts.iloc[i : i + batch]]
            for v in model(held if most is None else [bounded(t, most) for t in held]):
                yield list(map(float, v))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield from in_parts(((len(v), v) for v in vectors(model, texts.fillna(""))), MOST_NUMBERS)

    return run(text)


def with_vectors(chunks: DataFrame, make: Callable[[], Embedder] = lambda: hashing_embedder, text: str = "content", **options) -> DataFrame:
    """Chunks with their vectors as `embedding`; `options` are those of `embed`."""
    return chunks.withColumn("embedding", embed(F.col(text), make, **options))
