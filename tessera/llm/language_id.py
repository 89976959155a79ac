"""Language ID: a byte convolutional network, trained and applied with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words
from ._arrow import map_slices, taken

WIDTHS, FILTERS, DIM, LENGTH = (2, 3, 4), 8, 8, 128
UNKNOWN = "und"
#: Labels that one network tells apart at most; more is an error.
MOST_LABELS = 1000
#: Documents of each label that train the model, and windows taken of each: the bounded sample.
DOCUMENTS_PER_LABEL, WINDOWS_PER_DOCUMENT = 600, 6
EPOCHS, BATCH, RATE, SEED = 8, 128, 0.01, 11
#: Windows run through the network at a time.
_CHUNK = 64


def windows(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """All fixed-length windows of a text's bytes; neighbours share what the widest filter needs. Padded with 0."""
    step = length - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    held = np.zeros((n - 1) * step + length, np.uint8)
    held[: len(data)] = data[: len(held)]
    return np.lib.stride_tricks.sliding_window_view(held, length)[::step]


@dataclass
class Network:
    """Embedding, filters by width, and the output layer; `labels` are sorted."""

    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What pairs of bytes add to each filter: at its first two places, and at the two after."""
        by = [[self.embed @ f[k] for k in range(len(f))] for f in self.filters]
        first = [(t[0][:, None] + t[1][None]).reshape(65536, -1) for t in by]
        zero = np.zeros_like(by[0][0])
        then = [((t[2] if len(t) > 2 else zero)[:, None] + (t[3] if len(t) > 3 else zero)[None]).reshape(65536, -1) for t in by[1:]]
        return np.concatenate(first, 1).astype(np.float32), np.concatenate(then, 1).astype(np.float32)

    def probabilities(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Softmax outputs of windows (n, length)."""
        first, then = tables
        found = np.empty((len(x), first.shape[1]), np.float32)
        for i in range(0, len(x), _CHUNK):
            y = x[i : i + _CHUNK].T.astype(np.int32)
            pairs = (y[:-1] << 8) + y[1:]
            a, b = first[pairs], then[pairs[2:]]
            found[i : i + _CHUNK, :FILTERS] = a[:, :, :FILTERS].max(0)
            a = a[:-2, :, FILTERS:]
            a += b
            found[i : i + _CHUNK, FILTERS:] = a.max(0)
        hidden = np.maximum(found + np.concatenate(self.bias), 0)
        z = hidden @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit a network to windows `x` and label numbers `y` by Adam; gradients pass through the pooled places alone.

    Windows see a fourth byte place in every filter of width 3 or 4 as applied (see `Network.tables`), so the last
    place of a window is left to width 2.
    """
    rng = np.random.default_rng(seed)
    k = len(labels)
    p: dict[str, np.ndarray] = {"embed": rng.normal(0, 0.5, (256, DIM)), "out": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), k)), "ob": np.zeros(k)}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)), np.zeros(FILTERS)
    mean, square, t = {n: np.zeros_like(v) for n, v in p.items()}, {n: np.zeros_like(v) for n, v in p.items()}, 0
    for _ in range(epochs if len(x) and k > 1 else 0):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            b, target = x[order[i : i + BATCH]].astype(np.int64), y[order[i : i + BATCH]]
            rows = np.arange(len(b))
            hidden, places = [], []
            for w in WIDTHS:
                span = LENGTH - 1 if w == 2 else LENGTH - 3
                total = sum((p["embed"] @ p[f"f{w}"][j]).astype(np.float32)[b[:, j : j + span]] for j in range(w))
                at = total.argmax(1)
                places.append(at)
                hidden.append(np.take_along_axis(total, at[:, None], 1)[:, 0] + p[f"b{w}"])
            raw = np.concatenate(hidden, 1)
            act = np.maximum(raw, 0)
            z = act @ p["out"] + p["ob"]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[rows, target] -= 1
            z /= len(b)
            grad = {"out": act.T @ z, "ob": z.sum(0), "embed": np.zeros_like(p["embed"])}
            back = (z @ p["out"].T) * (raw > 0)
            for n, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
                g = back[:, n * FILTERS : (n + 1) * FILTERS]
                grad[f"b{w}"] = g.sum(0)
                grad[f"f{w}"] = np.empty_like(p[f"f{w}"])
                for j in range(w):
                    seen = b[rows[:, None], at + j]  # (batch, filters): the byte under this place of each filter
                    grad[f"f{w}"][j] = np.einsum("nfd,nf->df", p["embed"][seen], g)
                    np.add.at(grad["embed"], seen.ravel(), (g[:, :, None] * p[f"f{w}"][j].T[None]).reshape(-1, DIM))
            t += 1
            for n, g in grad.items():
                mean[n] += 0.1 * (g - mean[n])
                square[n] += 0.001 * (g * g - square[n])
                p[n] -= RATE * (mean[n] / (1 - 0.9**t)) / (np.sqrt(square[n] / (1 - 0.999**t)) + 1e-8)
    return Network(labels, p["embed"], [p[f"f{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["out"], p["ob"])


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of the key as text is 0 modulo `folds`: such documents never train. A null key counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == 0


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = DOCUMENTS_PER_LABEL) -> Network:
    """Train on about `per_label` documents of each label, of those that have one and aren't held out.

    They are picked by a hash of key and text, equal rows once; of each, windows spread evenly over its whole text come
    to the driver. Without labelled documents the network has no label; more than MOST_LABELS labels are an error.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("key")))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(MOST_LABELS + 1).collect()}
    labels = sorted(counts)
    if len(labels) > MOST_LABELS:
        raise ValueError(f"column {label} has more than {MOST_LABELS} values")
    if not labels:
        return train(np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64), [])
    share = F.create_map(*(F.lit(v) for k in labels for v in (k, min(1.0, 1.3 * per_label / counts[k]))))
    draw = F.xxhash64("key", "text", F.lit("language"))
    place = F.pmod(draw, F.lit(1 << 20)) / float(1 << 20)
    picked = rows.withColumn("draw", draw).filter(place < share[F.col("label")]).groupBy("draw", "label").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                w = windows(np.frombuffer(t.encode(), np.uint8))
                out.append(w[np.linspace(0, len(w) - 1, min(len(w), WINDOWS_PER_DOCUMENT)).astype(int)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("label"), pa.array(out, pa.binary())], names=["draw", "label", "windows"])

    sample = picked.mapInArrow(run, "draw long, label string, windows binary")
    got = sorted((r["draw"], bytes(r["windows"]), r["label"]) for r in sample.collect())
    x, y, used = [], [], dict.fromkeys(labels, 0)
    for _, held, name in got:
        if used[name] < per_label:
            used[name] += 1
            w = np.frombuffer(held, np.uint8).reshape(-1, LENGTH)
            x.append(w)
            y += [labels.index(name)] * len(w)
    return train(np.concatenate(x) if x else np.zeros((0, LENGTH), np.uint8), np.array(y, np.int64), labels)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """The language of every whole text: key, held_out, lang_pred and score.

    All windows of a text go through the network in batches of fixed length; the score is the mean probability
    of the best label over them. A text that is null or has no letter is `und` with score 0, as is every text
    where no label was learned. Repeated rows are judged each, a null key is passed on, other columns are not read,
    and an empty table gives an empty result. With `carry` the whole input row follows as the struct `row`.
    """
    rows, kind, row, inner = taken(docs, key, text, carry)

    def work():
        tables = network.tables()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = pc.fill_null(batch.column(1), "")
            data, at = _words.buffers(column)
            # ASCII letters are told by their bytes; only texts without one are looked at by character.
            sums = np.append(0, np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122)))
            letter = sums[at[1:]] > sums[at[:-1]]
            names, scores = [UNKNOWN] * len(column), [0.0] * len(column)
            for i in np.flatnonzero(~letter).tolist():
                letter[i] = has_letter(column[i].as_py())
            live = np.flatnonzero(letter).tolist() if network.labels else []
            if live:
                parts = [windows(data[at[i] : at[i + 1]]) for i in live]
                p = network.probabilities(np.concatenate(parts), tables)
                first = np.cumsum([0, *map(len, parts[:-1])])
                mean = np.add.reduceat(p, first, axis=0) / np.array(list(map(len, parts)))[:, None]
                for i, best, row in zip(live, mean.argmax(1).tolist(), mean, strict=True):
                    names[i], scores[i] = network.labels[best], min(1.0, float(row[best]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]], names=["key", "lang_pred", "score", *batch.schema.names[2:]])

        return step

    out = map_slices(rows, work, f"key {kind}, lang_pred string, score double{row}", inner=inner)
    return out.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "lang_pred", "score", *(["row"] if carry else []))
