"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Every token has a sparse random index vector, drawn by its hash. What stands around a token adds up, over all documents,
to its context vector: sums of integers, so partial sums of tasks may meet in any order. Tokens share one of a fixed
number of rows by hash, so the vectors have one size whatever the vocabulary. A document is the mean of its tokens'
vectors, once plain and once with frequent tokens taken back, beside how alike neighbours' vectors are; the network judges
that. Its probabilities are calibrated by one temperature, on labelled documents that didn't train it.

Tokens are runs of letters, digits and non-ASCII characters, and runs of other visible characters, as written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._arrow import map_slices, slices, taken
from .language_id import held_out

#: Rows and columns of the table of word vectors (2 MB), and the entries of an index vector that aren't 0.
ROWS, DIM, SPARSE = 1 << 14, 32, 2
#: Tokens on each side whose index vectors add to a context vector.
REACH = 2
#: Labelled documents that the network learns from at most: the bounded sample. A fifth of them calibrates it.
MOST_LABELLED = 8000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 40, 64, 0.003, 1e-4, 5
#: Tokens more frequent than this part of all count less in the second mean.
USUAL = 1e-3
#: Tokens whose vectors are summed at a time.
_CHUNK = 1 << 14

_KIND = np.full(256, 2, np.uint8)
_KIND[:33], _KIND[127] = 0, 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of texts that lie end to end, and the n+1 token offsets of the texts."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    seen = kind[starts] > 0
    starts, ends = starts[seen], ends[seen]
    return _words.range_hashes(data, starts, ends, fold=False), np.searchsorted(starts, bounds)


def _row(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(ROWS - 1)).astype(np.int64)


def contexts(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What tokens add to the table: (ROWS, DIM + 1) sums, the last column being numbers of tokens."""
    row = _row(hashes)
    out = np.zeros((ROWS, DIM + 1), np.int64)
    out[:, DIM] = np.bincount(row, minlength=ROWS)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    drawn = _words.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    place = [((drawn >> np.uint64(8 * j)) % np.uint64(DIM)).astype(np.int64) for j in range(SPARSE)]
    sign = [((drawn >> np.uint64(56 + j)) & np.uint64(1)).astype(np.float64) * 2 - 1 for j in range(SPARSE)]
    cells, weights = [], []
    for o in range(1, REACH + 1):
        near = np.flatnonzero(doc[:-o] == doc[o:]) if len(doc) > o else np.zeros(0, np.int64)
        for a, b in ((near, near + o), (near + o, near)):
            for p, s in zip(place, sign, strict=True):
                cells.append(row[a] * DIM + p[b])
                weights.append(s[b])
    if cells:
        out[:, :DIM] = np.bincount(np.concatenate(cells), np.concatenate(weights), ROWS * DIM).reshape(ROWS, DIM)
    return out


def word_table(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Word vectors (ROWS, DIM) of unit length and the share that each row has of all tokens, over all documents.

    Each task sends one row for each table row that it met, and those are summed by row; what comes to the driver has the
    table's fixed size. Without tokens all is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, DIM + 1), np.int64)
        for batch in batches:
            for part in slices(batch):
                total += contexts(*tokens(*_words.buffers(part.column("text"))))
        met = np.flatnonzero(total[:, DIM])
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *map(pa.array, total[met].T)], names=names)

    columns = [f"c{j}" for j in range(DIM + 1)]
    names = ["slot", *columns]
    sent = docs.select(F.col(text).alias("text")).mapInArrow(run, "slot int" + "".join(f", {c} long" for c in columns))
    got = sent.groupBy("slot").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    sums = np.zeros((ROWS, DIM + 1))
    sums[got["slot"].to_numpy()] = np.stack([got[c].to_numpy() for c in columns], 1).reshape(-1, DIM + 1)
    vectors, counts = sums[:, :DIM], sums[:, DIM]
    size = np.sqrt((vectors**2).sum(1, keepdims=True))
    return (vectors / np.maximum(size, 1)).astype(np.float32), counts / max(1.0, counts.sum())


def pooled(hashes: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each text's two mean vectors side by side, the mean cosine of neighbours and how many have the same vector."""
    row = _row(hashes)
    out, alike = np.zeros((len(offsets) - 1, 2, DIM)), np.zeros((len(offsets) - 1, 2))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for i in range(0, len(row), _CHUNK):
        r, d = row[i : i + _CHUNK + 1], doc[i : i + _CHUNK + 1]
        v = vectors[r]
        cosine = np.einsum("nd,nd->n", v[1:], v[:-1]) * (d[1:] == d[:-1])
        alike[:, 0] += np.bincount(d[1:], cosine, len(alike))
        alike[:, 1] += np.bincount(d[1:], cosine > 0.999, len(alike))
        r, d, v = r[:_CHUNK], d[:_CHUNK], v[:_CHUNK]
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        out[d[first], 0] += np.add.reduceat(v, first)
        out[d[first], 1] += np.add.reduceat(v * weight[r][:, None], first)
    out[:, 0] /= np.maximum(1, np.diff(offsets))[:, None]
    alike /= np.maximum(1, np.diff(offsets) - 1)[:, None]
    whole = np.bincount(doc, weight[row], len(offsets) - 1)
    out[:, 1] /= np.where(whole > 0, whole, 1)[:, None]
    return np.column_stack([out.reshape(-1, 2 * DIM), alike])


@dataclass
class Network:
    """Scales, two layers and a temperature; without both labels to learn from, a constant."""

    center: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.maximum((x - self.center) / self.scale @ w + b, 0) @ v + c

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    """Mean negative log-likelihood of labels `y` under logits `z`."""
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0


def calibrate(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature under which logits explain the labels best, by golden section over its logarithm."""
    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(z / np.exp(a), y) <= loss(z / np.exp(b), y):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit the network to pooled vectors and 0/1 labels by Adam; every fifth row is left out and sets the temperature."""
    n, k = len(y), x.shape[1]
    if len(np.unique(y)) < 2:
        return Network(np.zeros(k), np.ones(k), [], 1.0, (float(y.sum()) + 1) / (n + 2))
    rng = np.random.default_rng(seed)
    aside = np.arange(n) % 5 == 4
    fit = np.flatnonzero(~aside) if len(np.unique(y[~aside])) == 2 else np.arange(n)
    center, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    p = [rng.normal(0, (2 / k) ** 0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(())]
    mean, square, t = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    xs = (x - center) / scale
    for _ in range(epochs):
        order = rng.permutation(fit)
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            raw = xs[rows] @ p[0] + p[1]
            act = np.maximum(raw, 0)
            back = (1 / (1 + np.exp(-(act @ p[2] + p[3]))) - y[rows]) / len(rows)
            inner = back[:, None] * p[2] * (raw > 0)
            grad = [xs[rows].T @ inner + DECAY * p[0], inner.sum(0), act.T @ back + DECAY * p[2], back.sum()]
            t += 1
            for j, g in enumerate(grad):
                mean[j] = mean[j] + 0.1 * (g - mean[j])
                square[j] = square[j] + 0.001 * (g * g - square[j])
                p[j] = p[j] - RATE * (mean[j] / (1 - 0.9**t)) / (np.sqrt(square[j] / (1 - 0.999**t)) + 1e-8)
    out = Network(center, scale, p, 1.0)
    if aside.any():
        out.temperature = calibrate(out.logits(x[aside]), y[aside])
    return out


@dataclass
class Model:
    vectors: np.ndarray
    weight: np.ndarray
    network: Network

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.network.probabilities(pooled(*tokens(*_words.buffers(texts)), self.vectors, self.weight))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Word vectors from all texts, and a network from at most `most` labelled documents that aren't held out.

    `labels` has rows (key, label of 0 or 1). Rows without key or label don't count; of several for one key the majority
    does, 1 in a tie. The labelled documents are picked by a hash of key and text; only their pooled vectors come to the
    driver. Rows of `docs` with a null text count as empty.
    """
    vectors, share = word_table(docs, text)
    weight = USUAL / (USUAL + share)
    asked = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label")).dropna()
    asked = asked.filter(~held_out(F.col("key"))).groupBy("key").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    picked = asked.orderBy(F.xxhash64("key", F.lit("quality")), "key").limit(most)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key")
    rows = rows.select("key", F.coalesce("text", F.lit("")).alias("text"), "label")

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = pooled(*tokens(*_words.buffers(batch.column("text"))), vectors, weight)
            held = pa.array([v.tobytes() for v in x], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("label"), held], names=["draw", "label", "x"])

        return step

    drawn = rows.select(F.xxhash64("key", "text", F.lit("order")).alias("draw"), "text", "label")
    # Keys may come again in `docs`, so the bound holds for their rows, too.
    got = map_slices(drawn, work, "draw long, label int, x binary").orderBy("draw", "x").limit(most).toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float64).reshape(-1, 2 * DIM + 2)
    return Model(vectors, weight, train(x, got["label"].to_numpy().astype(np.float64)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: key, held_out, score (the probability of label 1) and predicted (1 if score >= threshold).

    Whole texts are judged, whatever their length; null and empty ones as a text without tokens, whose vectors are 0. Rows
    are judged each on its own, a null key is passed on, other columns are not read, whatever they are called, and an empty
    table gives an empty result. Nothing is shuffled.
    """
    rows, kind, _, _ = taken(docs, key, text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        judge = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(judge.scores(batch.column(1)))], names=["key", "score"])

        return step

    out = map_slices(rows, work, f"key {kind}, score double")
    return out.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
