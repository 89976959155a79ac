"""Ranked lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm_operators import CLASH, documents

from tessera.llm import lexical_search, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    """Rows (item, rank, key, score) of pairs (key, text) and (item, text)."""
    held = [(key, Counter(terms(text))) for key, text in docs]
    sizes = [sum(c.values()) for _, c in held]
    count, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for (key, c), n in zip(held, sizes, strict=True):
            m = total and 50 + 50 * n * count // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, key is not None, key))
        scored.sort()
        out += [(item, r, key, -s) for r, (s, _, key) in enumerate(scored[:k], 1)]
    return out


def order(rows):
    return sorted(rows, key=repr)


@settings(deadline=None, max_examples=150)
@given(st.data())
def test_trees_keep_the_best(data):
    n, width, k = data.draw(st.integers(1, 80)), data.draw(st.integers(1, 20)), data.draw(st.integers(1, 6))
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    tf = (rng.random((n, width)) < rng.random(width)) * rng.integers(1, 4, (n, width))
    m, weights = rng.integers(50, 200, n), rng.integers(1, 5000, width)
    before = np.sort(rng.integers(1, 10**7, rng.integers(0, k + 1)))
    tree = lexical_search.Tree(tf.astype(np.int32), m)
    places, found, top = lexical_search.best_first(tree, weights, before, k)
    every = lexical_search.scores(tf, m, weights)
    want = np.sort(np.concatenate([before, every[every > 0]]))[-k:]
    assert np.sort(top).tolist() == want.tolist()
    assert found.tolist() == every[tree.order[places]].tolist()
    least = want[0] if len(want) == k else 1
    kept = set(tree.order[places].tolist())
    assert {i for i in range(n) if every[i] >= least} <= kept


def test_bounds_hold_and_nodes_nest():
    rng = np.random.default_rng(3)
    tf, m, weights = rng.integers(0, 3, (300, 30)), rng.integers(50, 90, 300), rng.integers(0, 3000, 30)
    tree = lexical_search.Tree(tf.astype(np.int32), m)
    every = lexical_search.scores(tree.tf, tree.m, weights)
    for (starts, most, least), ends in zip(tree.levels, tree.ends, strict=True):
        bound = lexical_search.scores(most, least, weights)
        for a, b, x in zip(starts, ends, bound, strict=True):
            assert every[a:b].max() <= x
    assert len(tree.levels[0][0]) == 1 and all(set(a[0]) <= set(b[0]) for a, b in zip(tree.levels, tree.levels[1:], strict=False))


def some_texts(rng, n, kinds):
    return [" ".join(rng.choice(["Ab", "é", "x1"]) + str(min(rng.randrange(kinds), rng.randrange(kinds))) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_search_against_plain_scores(spark, monkeypatch):
    rng = random.Random(2)
    texts = some_texts(rng, 300, 12)
    texts[50:90] = [texts[0]] * 40  # ties
    texts += [None, "", " .,: ", "AB0 " * 3000, "[ab0]^é1_x12`{~", "Ab1\tab1 AB1"]
    items = [(i, t) for i, t in enumerate(some_texts(rng, 20, 14))] + [(70, None), (71, "--"), (72, "nothing here"), (73, "ab0 AB0 ab0"), (73, "é1 x12"), (73, "é1 x12"), (None, "ab2")]
    asked = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string")
    want = plain_search(list(enumerate(texts)), list(dict.fromkeys(items)), 7)
    got = lambda **more: order(tuple(r) for r in lexical_search.search(documents(spark, *texts), asked, k=7, **more).collect())
    assert got() == order(want)
    assert got(block_bytes=600) == order(want)  # several blocks
    monkeypatch.setattr(lexical_search, "_PIECE", 7)
    assert lexical_search.count_terms("Ab cd, ab-AB  cd", {b"ab": 5}) == (5, Counter({5: 3}))


def test_small_trees_and_groups_of_tasks(spark):
    """Trees of a few documents or cells, and several groups of tasks, find the same."""
    rng = random.Random(5)
    texts = some_texts(rng, 120, 9)
    items = list(enumerate(some_texts(rng, 6, 9)))
    held = [Counter(terms(t)) for t in texts]
    names = sorted({t for c in held for t in c} | {t for _, x in items for t in terms(x)})
    block = lexical_search._block(items, pa.int64())
    assert [n.decode() for n in block.known] == sorted({t for _, x in items for t in terms(x)}, key=str.encode) and names
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = order(plain_search(list(enumerate(texts)), items, 5))
    old = lexical_search.TREE_DOCUMENTS, lexical_search.TREE_CELLS, lexical_search.TASKS, lexical_search.LEAF
    try:
        lexical_search.TREE_DOCUMENTS, lexical_search.TREE_CELLS, lexical_search.TASKS, lexical_search.LEAF = 7, 40, 2, 1
        assert order(tuple(r) for r in lexical_search.search(docs, asked, k=5).collect()) == want
        vectors = [(i, sum(c.values()), [block.known[t.encode()] for t in c if t.encode() in block.known], [v for t, v in c.items() if t.encode() in block.known]) for i, c in enumerate(held)]
        df = np.bincount([t for v in vectors for t in v[2]], minlength=len(block.known))
        n, total = sum(v[1] > 0 for v in vectors), sum(v[1] for v in vectors)
        position = np.empty(len(df), np.int64)
        position[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        best = lexical_search._Best(block, position, np.array([lexical_search.weight(n, int(d)) for d in df]), 5)
        for a in range(0, len(vectors), 7):
            part = vectors[a : a + 7]
            flat = lambda k: np.array([x for v in part for x in v[k]], np.int64)  # noqa: B023, E731
            m = np.array([50 + 50 * v[1] * n // total for v in part])
            best.add(pa.array([v[0] for v in part]), m, np.array([len(v[2]) for v in part]), flat(2), flat(3))
        found = [(i, r, key, s) for i, rows in enumerate(best.held) for r, (s, key) in enumerate(rows, 1)]
        assert order(found) == want
    finally:
        lexical_search.TREE_DOCUMENTS, lexical_search.TREE_CELLS, lexical_search.TASKS, lexical_search.LEAF = old


def test_odd_rows(spark):
    kinds = "doc_id string, text string, " + ", ".join(f"{c} string" for c in CLASH)
    rest = ["x"] * len(CLASH)
    docs = [(None, "a b"), ("k", "a b"), ("k", "a b"), ("j", "a b"), ("z", None), ("y", "c")]
    frame = spark.createDataFrame([(*r, *rest) for r in docs], kinds)
    asked = spark.createDataFrame([("q", "A c"), ("r", "b")], "item_id string, text string")
    got = [tuple(r) for r in lexical_search.search(frame, asked, k=4).collect()]
    assert order(got) == order(plain_search(docs, [("q", "A c"), ("r", "b")], 4))
    assert [r[2] for r in sorted(got) if r[0] == "r"] == [None, "j", "k", "k"]
    for a, b in ((frame.limit(0), asked), (frame, asked.limit(0)), (frame.limit(0), asked.limit(0)), (frame.filter("text is null"), asked)):
        assert lexical_search.search(a, b).collect() == []


def test_query_on_a_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    got = queries.op13_lexical_search(spark, sf_dir)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert order(tuple(r) for r in got.collect()) == order(plain_search(read("documents", "doc_id"), read("benchmark", "item_id"), 50))
