"""The quality classifier: held-out accuracy, calibration, and its parts against plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_llm_operators import CLASH, documents

from tessera.llm import _words, quality, queries


def split(text):
    """Tokens of a text, character by character."""
    out, last = [], 0
    for ch in text:
        kind = 0 if ord(ch) <= 32 or ord(ch) == 127 else 1 if ch.isascii() and ch.isalnum() or ord(ch) > 127 else 2
        if kind and kind == last:
            out[-1] += ch
        elif kind:
            out.append(ch)
        last = kind
    return out


def test_tokens():
    texts = ["", "a", "the*** cat!! 3x,y", "é|ü||\x00b\x7f--", " \n ", "x" * 3000 + "#"]
    hashes, offsets = quality.tokens(*_words.buffers(pa.array(texts)))
    assert np.diff(offsets).tolist() == [len(split(t)) for t in texts]
    flat = [w for t in texts for w in split(t)]
    one = {w: int(quality.tokens(*_words.buffers(pa.array([w])))[0][0]) for w in flat}
    assert [one[w] for w in flat] == hashes.tolist() and len(set(one.values())) == len(one)


def test_contexts_and_pools_against_loops():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab,cd") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))) for _ in range(30)]
    hashes, offsets = quality.tokens(*_words.buffers(pa.array(texts)))
    got = quality.contexts(hashes, offsets)
    row = (hashes & np.uint64(quality.ROWS - 1)).astype(int)
    index = {}
    for h in hashes.tolist():
        v, drawn = np.zeros(quality.DIM), int(_words.mix(np.array([h], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))[0])
        for j in range(quality.SPARSE):
            v[(drawn >> 8 * j) % quality.DIM] += (drawn >> 56 + j & 1) * 2 - 1
        index[h] = v
    want = np.zeros((quality.ROWS, quality.DIM + 1))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        for i in range(a, b):
            want[row[i], quality.DIM] += 1
            for j in range(max(a, i - quality.REACH), min(b, i + quality.REACH + 1)):
                if j != i:
                    want[row[i], : quality.DIM] += index[int(hashes[j])]
    assert (got == want).all()
    vectors, weight = np.random.default_rng(2).normal(size=(quality.ROWS, quality.DIM)).astype(np.float32), np.random.default_rng(3).random(quality.ROWS)
    vectors /= np.sqrt((vectors**2).sum(1, keepdims=True))
    for chunk in (3, 1 << 14):
        quality._CHUNK, old = chunk, quality._CHUNK
        try:
            found = quality.pooled(hashes, offsets, vectors, weight)
        finally:
            quality._CHUNK = old
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            v, w = vectors[row[a:b]], weight[row[a:b]]
            if b > a:
                cosines = (v[1:] * v[:-1]).sum(1)
                near = [cosines.mean(), (cosines > 0.999).mean()] if b - a > 1 else [0, 0]
                assert np.allclose(found[k], np.concatenate([v.mean(0), (v * w[:, None]).sum(0) / w.sum(), near]), atol=1e-4)
            else:
                assert not found[k].any()


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 6))
    chance = 1 / (1 + np.exp(-(2 * x[:, 0] * x[:, 1] + x[:, 2])))
    y = (rng.random(2000) < chance).astype(float)
    net = quality.train(x[:1500], y[:1500])
    p = net.probabilities(x[1500:])
    assert ((p >= 0.5) == (chance[1500:] >= 0.5)).mean() > 0.8
    z, labels = net.logits(x[:1500][4::5]), y[:1500][4::5]
    at = quality.loss(z / net.temperature, labels)
    assert all(at <= quality.loss(z / t, labels) + 1e-6 for t in np.exp(np.linspace(-2.9, 2.9, 200)))
    assert net.temperature > 1.05  # a fitted network is surer than it should be
    again = quality.train(x[:1500], y[:1500])
    assert (again.probabilities(x) == net.probabilities(x)).all()


@pytest.mark.parametrize("y, want", [([], 0.5), ([1, 1], 0.75), ([0], 1 / 3)])
def test_without_both_labels(y, want):
    net = quality.train(np.zeros((len(y), 4)), np.array(y, float))
    assert net.probabilities(np.ones((3, 4))).tolist() == pytest.approx([want] * 3)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op12_quality_classifier(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for k, r in rows.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    aside = [(labels[k], r["score"]) for k, r in rows.items() if r["held_out"] and k in labels]
    good, bad = [s for q, s in aside if q], [s for q, s in aside if not q]
    pairs = [(a > b) + (a == b) / 2 for a in good for b in bad]
    assert len(bad) >= 5 and sum(pairs) / len(pairs) > 0.85
    assert sum((s >= 0.3) == q for q, s in aside) / len(aside) > 0.9


def test_labels_decide_nothing_but_training(spark):
    """Held-out labels and other columns change no score; rows in another order or partitioning don't, either."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    base = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality", "1 - toxic as toxic")
    more = turned.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (10**9, 0, 0)], "doc_id long, quality int, toxic int"))
    other = docs.selectExpr("text", "doc_id", "'zz' as lang", "'s' as source", "'k' as key", "0 as score").repartition(5)
    again = {r["doc_id"]: r["score"] for r in quality.score(other, quality.fit(other, more)).collect()}
    assert again == pytest.approx(base, abs=1e-9)


def test_odd_rows(spark):
    texts = [None, "", " \n", "a", "!!", "a b " * 40_000, "x", "x"]
    docs = documents(spark, *texts)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()}
    assert rows == dict.fromkeys(range(8), 0.5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] * 2 + [(3, 0)], "doc_id long, quality int")
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert rows[0] == rows[1] == rows[2] and rows[6] == rows[7] and all(0 <= s <= 1 for s in rows.values())
    kinds = "doc_id string, text string, " + ", ".join(f"{c} string" for c in [*CLASH, "score", "held_out"])
    odd = spark.createDataFrame([(None, "a", *["x"] * (len(CLASH) + 2)), ("k", None, *["x"] * (len(CLASH) + 2))] * 2, kinds)
    model = quality.fit(odd, spark.createDataFrame([("k", 1), (None, 0)], "doc_id string, quality int"))
    assert sorted(str(r["doc_id"]) for r in quality.score(odd, model).collect()) == ["None", "None", "k", "k"]
    assert quality.score(odd.limit(0), model).collect() == []
    assert quality.fit(odd.limit(0), none.selectExpr("cast(doc_id as string) as doc_id", "quality")).network.constant == 0.5
