"""The pipeline on a small table against the same decisions made one by one, and each llm query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import queries
from tests_llm_support import brute_pipeline, plain_rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    found = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(found)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "labels", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        assert plain_rows(found) == plain_rows(con.sql(queries.ORACLES[name]).df())


def test_registered():
    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline(spark):
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    kept, tokens = brute_pipeline(spark, DATA, docs)
    assert set(found) == kept
    assert {k: r["n_tokens"] for k, r in found.items()} == tokens and all(r["round_trip"] for r in found.values())


def test_stages_keep_odd_rows_whole(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    good = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(1, good, "en", None, None), (1, good, "en", None, None), (None, good + " far", None, "s", 3), (3, None, "en", "s", 0), (4, "", None, "s", 0), (5, "token=abcdefgh12 " + good[::-1], None, "s", 9)]
    docs = spark.createDataFrame(rows, names)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of the kind is said in any of these few documents here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = corpus_pipeline.join_near_copies(spark, docs, str(tmp_path))
    assert near.columns == docs.columns and near.count() == 5
    clean = corpus_pipeline.redact_secrets(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert {r["n_chars"] for r in clean.filter("doc_id = 5").collect()} == {len("[SECRET] " + good[::-1])}
    assert clean.filter("text is null").count() == 1 and clean.count() == 6
    assert corpus_pipeline.drop_benchmark_text(spark, docs, str(tmp_path)).count() == 6
    assert corpus_pipeline.encode(spark, docs, str(tmp_path)).filter("round_trip").count() == 6
    assert corpus_pipeline.identify_language(spark, docs, str(tmp_path)).filter("doc_id in (3, 4)").count() == 0


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    """Empty tables, columns with clashing names, a very long text: each stage keeps columns and clean rows."""
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, component_id string, spans int"
    base = "the quick brown fox jumps over the lazy dog and runs away over hills "
    long = " ".join(f"{base}{i}" for i in range(4000))
    docs = spark.createDataFrame([(i, f"{base} number {i} " * (i % 3 + 1) if i else long, "en", "s", 1, "r", i, "c", 0) for i in range(20)], names)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if k < 4:
            assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} <= set(range(20))
            assert any(r["doc_id"] == 0 and len(r["text"]) == len(long) for r in out.collect())
        else:
            assert out.filter("round_trip").count() == 20
    first, second = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))
