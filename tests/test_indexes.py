"""The vector and text indexes against exact search and full scans: same rows, fewer files."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tessera.operators import nearest, recall, text_index, vector_index


def vectors(spark, x, keys=None):
    rows = [(int(k), None if v is None else [float(e) for e in v]) for k, v in zip(keys if keys is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)


def asked(spark, x):
    return spark.createDataFrame([(f"q{i}", [float(e) for e in v]) for i, v in enumerate(x)], "query_id string, embedding array<double>")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 8)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(60, 16)) * 0.4 for c in centres])
    x[5] = x[4]  # ties
    return x, np.concatenate([centres[:6] + 0.2, rng.normal(size=(3, 16))])


def test_index_finds_what_exact_search_finds(spark, tmp_path, clustered):
    x, q = clustered
    held = vectors(spark, [*x, None, np.zeros(16), []])
    index = vector_index.VectorIndex.build(held, f"{tmp_path}/v", n_cells=12)
    exact = recall.dense_retrieve(held, asked(spark, q), 10)
    assert rows(index.search(asked(spark, q), 10)) == rows(exact)
    read, every = index.files_read()
    assert 0 < read <= every and int(index.counts.sum()) == len(x)
    # Queries near clusters leave most files alone, also where the result is exact.
    near = vector_index.VectorIndex.open(spark, f"{tmp_path}/v")
    assert rows(near.search(asked(spark, q[:2]), 10)) == [r for r in rows(exact) if r[0] in ("q0", "q1")]
    read, every = near.files_read()
    assert read <= every / 2
    # Probes: as many as the recall needs, and the files of no other cells.
    some = vector_index.VectorIndex.open(spark, f"{tmp_path}/v")
    probes = some.probes_for(asked(spark, q), exact, 0.9)
    found = {}
    for r in some.search(asked(spark, q), 10, probes=probes).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for name in {r[0] for r in rows(exact)}:
        true = {r[2] for r in rows(exact) if r[0] == name}
        assert len(found[name] & true) >= 0.9 * len(true)
    one = vector_index.VectorIndex.open(spark, f"{tmp_path}/v")
    assert one.search(asked(spark, q[:1]), 5, probes=1).count() == 5 and one.files_read()[0] < one.files_read()[1]


def test_index_grows(spark, tmp_path, clustered):
    x, q = clustered
    index = vector_index.VectorIndex.build(vectors(spark, x[:400]), f"{tmp_path}/v")
    index.append(vectors(spark, x[400:], range(400, len(x))))
    again = vector_index.VectorIndex.open(spark, f"{tmp_path}/v")
    want = rows(recall.dense_retrieve(vectors(spark, x), asked(spark, q), 7))
    assert rows(again.search(asked(spark, q), 7)) == want == rows(index.search(asked(spark, q), 7))
    assert (again.counts == index.counts).all() and (again.angles == index.angles).all()


def test_odd_vectors(spark, tmp_path):
    none = vectors(spark, [None, []])
    index = vector_index.VectorIndex.build(none, f"{tmp_path}/none")
    assert index.search(asked(spark, [[1, 0]]), 3).collect() == []
    with pytest.raises(ValueError):
        index.append(none)
    same = vectors(spark, [[1.0, 0.0]] * 300)  # one cell holds all
    index = vector_index.VectorIndex.build(same, f"{tmp_path}/same")
    assert len(index.centres) == 1
    assert [r["vec_id"] for r in index.search(asked(spark, [[2, 0]]), 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert index.search(asked(spark, [[2, 0]]).limit(0), 4).collect() == []
    assert index.search(asked(spark, [[0, 0]]), 4).collect() == []  # a zero query has no neighbours
    with pytest.raises(Exception, match="doesn't have"):
        recall.dense_retrieve(vectors(spark, [[1.0, 2.0], [1.0]]), asked(spark, [[1, 0]]), 2).collect()


def test_tasks_keep_their_best(spark, monkeypatch):
    """However small the pieces, and however many tasks and groups of them, the nearest are the same."""
    rng = np.random.default_rng(7)
    x, q = np.round(rng.normal(size=(500, 4)), 1), np.round(rng.normal(size=(20, 4)), 1)
    held = vectors(spark, x).repartition(9)
    score = np.round(nearest.unit(q) @ nearest.unit(x).T, 9)
    want = sorted((f"q{i}", r + 1, int(j), round(float(score[i, j]), 8)) for i in range(20) for r, j in enumerate(np.lexsort((np.arange(500), -score[i]))[:6]))
    assert rows(recall.dense_retrieve(held, asked(spark, q), 6)) == want
    found = nearest.best_in_tasks(held.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v")), [f"q{i}" for i in range(20)], q, 6)
    assert found.count() <= 9 * 20 * 6
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 7)
    assert rows(recall.dense_retrieve(held, asked(spark, q), 6)) == want


def test_products_held_at_a_time_are_few(spark, monkeypatch):
    """Many queries cost no more memory than the products of a turn; the best rows are those of all products."""
    rng = np.random.default_rng(3)
    held, q, k = rng.normal(size=(2000, 8)), rng.normal(size=(4096, 8)), 3
    held[500:900] = held[0]
    batches = [pa.record_batch([pa.array(range(a, a + 1000)), pa.array(list(held[a : a + 1000]))], names=["key", "v"]) for a in (0, 1000)]
    rows = SimpleNamespace(schema={"key": StructField("key", LongType())}, sparkSession=spark, mapInArrow=lambda run, schema: run)
    run = nearest.best_in_tasks(rows, [str(i) for i in range(len(q))], q, k)
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    tracemalloc.start()
    found = pa.Table.from_batches(run(iter(batches))).to_pydict()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    score = np.round(nearest.unit(q) @ nearest.unit(held).T, 9)
    want = [(str(i), int(j), float(score[i, j])) for i in range(len(q)) for j in np.lexsort((np.arange(len(held)), -score[i]))[:k]]
    assert list(zip(found["query_id"], found["key"], found["score"])) == want
    assert most < 40_000_000


# Text


def chunks(spark, texts, names=None):
    held = [(f"d{i // 3:03}", i % 3, f"c{i}", (names or {}).get(i, "file.txt"), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(held, "document_id string, chunk_index int, child_id string, source_name string, content string").repartition(4)


def keys(df):
    return sorted((r["query_id"], r["place"], r["document_id"], r["chunk_index"], r["content"]) for r in df.collect())


def test_text_index_gives_the_same_rows(spark, tmp_path):
    texts = [f"common words and number{i:04} with 差旅报销标准 {'x' * (i % 7)}" for i in range(120)]
    texts[7], texts[50], texts[90], texts[91] = None, "", "needle in ünïcode", "ab"
    held = chunks(spark, texts, {30: "needle.pdf", 31: None, 32: "报销.md"})
    index = text_index.TextIndex.build(held, f"{tmp_path}/t", part_bytes=400)
    terms = {
        "rare": ["number0017", "needle"], "one": ["number0100"], "none": ["absent term"], "wide": ["common"], "cjk": ["报销"], "mixed": ["ünï", "number0003"],
        "source": ["needle.pdf", ".pd"], "no terms": [], "across": ["er0101 w", "wordsand"],
    }
    for limit in (3, 1000):
        for q, t in terms.items():
            own = text_index.TextIndex(spark, f"{tmp_path}/t")
            assert keys(own.candidates({q: t}, limit)) == keys(recall.candidates(held, {q: t}, limit)), q
        assert keys(index.candidates(terms, limit)) == keys(recall.candidates(held, terms, limit))
    rare = text_index.TextIndex(spark, f"{tmp_path}/t")
    assert len(keys(rare.candidates({"rare": terms["rare"]}, 10))) == 3
    read, every = rare.files_read()
    assert every > 10 and read <= 4
    absent = text_index.TextIndex(spark, f"{tmp_path}/t")
    assert keys(absent.candidates({"none": ["absent term"]}, 10)) == [] and absent.files_read()[0] == 0
    # Short terms read all, and so do only their queries.
    short = text_index.TextIndex(spark, f"{tmp_path}/t")
    two = {"short": ["ab"], "rare": ["needle"], "one char": ["é", "x"]}
    assert keys(short.candidates(two, 1000)) == keys(recall.candidates(held, two, 1000)) and short.files_read()[0] == every


def test_more_parts_than_a_plan_holds(spark, tmp_path, monkeypatch):
    held = chunks(spark, [f"text {i % 5} of number{i}" for i in range(60)])
    index = text_index.TextIndex.build(held, f"{tmp_path}/t", part_bytes=50)
    monkeypatch.setattr(text_index, "MOST_PARTS", 2)
    terms = {"a": ["text 3", "number59"], "b": ["number7"]}
    assert keys(index.candidates(terms, 9)) == keys(recall.candidates(held, terms, 9))


def test_odd_chunks(spark, tmp_path):
    empty = chunks(spark, ["x"]).limit(0)
    index = text_index.TextIndex.build(chunks(spark, [None, "", "a"]), f"{tmp_path}/t")
    assert keys(index.candidates({"q": ["abc"]}, 5)) == []
    assert recall.candidates(empty, {"q": ["abc"]}, 5).collect() == []
    assert text_index.grams(b"ab").tolist() == [] and text_index.grams(b"abc").tolist() == [0x616263]
