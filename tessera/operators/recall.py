"""Candidate recall: filtered scans, BM25 with lexical overlap, and exact cosine neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.functions import query as Q
from tessera.functions import text as X
from tessera.operators import nearest
from tessera.storage import stored

K1, B = 1.5, 0.75
#: Queries are written into the plan, so their number is bounded; more come in several calls.
MOST_QUERIES = 2000
#: Candidates' keys that are broadcast at most, some hundred bytes each.
BROADCAST_KEYS = 200_000


def any_term(terms: Sequence[str], content: Column, source_name: Column) -> Column:
    """Whether the content or the source name contains any of the terms (pushed to the scan as contains-filters)."""
    found = (F.contains(c, F.lit(t)) for t in terms for c in (content, source_name))
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False)) if terms else F.lit(False)


def candidate_scan(chunks: DataFrame, terms: Sequence[str], limit: int) -> DataFrame:
    """The first `limit` chunks (by document and chunk number) with any of the terms. A null content or name has none."""
    return chunks.filter(any_term(terms, F.col("content"), F.col("source_name"))).orderBy("document_id", "chunk_index").limit(limit)


def _matched(chunks: DataFrame, terms: dict[str, Sequence[str]]) -> DataFrame:
    """One scan for all queries: each chunk once for each query that it has a term of."""
    if len(terms) > MOST_QUERIES:
        raise ValueError(f"{len(terms)} queries; at most {MOST_QUERIES} at a time")
    tests = [F.when(any_term(t, F.col("content"), F.col("source_name")), F.lit(q)) for q, t in terms.items() if t]
    if not tests:
        return chunks.limit(0).withColumn("query_id", F.lit(None).cast("string"))
    return chunks.withColumn("query_id", F.explode(F.array_compact(F.array(*tests))))


def _first_keys(keys: DataFrame, limit: int) -> DataFrame:
    """The first `limit` keys (query_id, document_id, chunk_index) of each query.

    Tasks keep no more before the shuffle, and groups of tasks no more before those of all groups meet.
    """
    order = [(c, "ascending") for c in ("query_id", "document_id", "chunk_index")]

    def cut(held: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held, sort_keys=order, null_placement="at_start"))
        q = held["query_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        at = np.arange(len(q))
        first = np.maximum.accumulate(np.where(np.append(True, q[1:] != q[:-1])[: len(q)], at, 0))
        return held.filter(pa.array(at - first < limit))

    def run(batches):
        from pyspark import TaskContext

        held, size = None, 0
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows > max(2 * size, 1 << 16):
                held = cut(held)
                size = held.num_rows
        if held is not None:
            held = cut(held)
            group = pa.array(np.full(held.num_rows, TaskContext.get().partitionId() // nearest.TASKS, np.int32))
            yield from held.append_column("part", group).to_batches()

    kept = keys.mapInArrow(run, StructType([*keys.schema.fields, StructField("part", IntegerType())]))
    for by in (["query_id", "part"], ["query_id"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("document_id", "chunk_index"))
        kept = kept.withColumn("place", place).filter(F.col("place") <= limit)
    return kept.drop("part")


def candidates(chunks: DataFrame, terms: dict[str, Sequence[str]], limit: int) -> DataFrame:
    """For some queries: the first `limit` chunks, by document and chunk number, with any of a query's terms.

    Rows are those of `chunks` with query_id and place. Two scans for all queries: one finds the keys, of which each
    task keeps the first ones; the other fetches the chunks. Keys are broadcast where they are at most
    BROADCAST_KEYS, else joined.
    """
    matched = _matched(chunks, terms).select("query_id", "document_id", "chunk_index")
    keys = stored(_first_keys(matched, limit))
    return chunks.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, ["document_id", "chunk_index"])


def sparse_retrieve(
    chunks: DataFrame, queries: dict[str, str], k: int, terms_of: Callable[[str], list[str]] = Q.recall_terms, scan: int | None = None
) -> DataFrame:
    """BM25 plus lexical overlap for some queries: query_id, document_id, chunk_index, score, rank.

    Each query's corpus is its own candidates: the chunks that contain a recall term, at most `scan`
    (by default max(30 k, 80)) by document and chunk number. The score is max(0, bm25) plus the weighted share of
    the query's tokens in the chunk, plus 0.35 if the whole query occurs. Ties go by chunk, then document.

    `chunks`: document_id, chunk_index, source_name, content; others are kept. Queries without terms get no rows.
    """
    if not queries:
        return chunks.limit(0).withColumns({"query_id": F.lit(""), "bm25": F.lit(0.0), "overlap": F.lit(0.0), "score": F.lit(0.0), "rank": F.lit(1)})
    corpus = candidates(chunks, {q: terms_of(text) for q, text in queries.items()}, scan or Q.scan_limit(k)).drop("place")
    # Stored, the bounded candidates cost one scan of the chunks, though they are read twice; dealt out, all cores score them.
    corpus = stored(corpus.repartition(chunks.sparkSession.sparkContext.defaultParallelism, "query_id", "document_id"))
    text = X.search_text(F.col("source_name"), F.col("content"))
    asked = F.create_map(*(F.lit(v) for q, t in queries.items() for v in (q, t)))[F.col("query_id")]
    corpus = corpus.withColumns({"tokens": X.tokens(text), "wanted": X.tokens(asked)})
    corpus = corpus.withColumns({"whole": (X.normalize(asked) != "") & F.contains(X.normalize(text), X.normalize(asked)), "length": F.size("tokens")})
    # Numbers of a query's tokens in each candidate; the candidates of a query are bounded by the scan.
    corpus = corpus.withColumn("row_id", F.struct("document_id", "chunk_index"))
    counted = F.transform(
        F.array_distinct("wanted"),
        lambda w: F.struct(
            w.alias("token"),
            F.size(F.filter("wanted", lambda t: t == w)).alias("asked"),
            F.size(F.filter("tokens", lambda t: t == w)).alias("tf"),
        ),
    )
    by_query = Window.partitionBy("query_id")
    stats = corpus.withColumns({"docs": F.count("*").over(by_query), "mean": F.avg("length").over(by_query)})
    flat = stats.select("query_id", "row_id", "whole", "length", "docs", "mean", F.explode_outer(counted).alias("t"))
    flat = flat.withColumn("df", F.sum((F.col("t.tf") > 0).cast("int")).over(Window.partitionBy("query_id", "t.token")))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("t.tf")
    part = F.col("t.asked") * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    weight = F.least(F.length("t.token"), F.lit(8)) / 8.0
    scored = flat.groupBy("query_id", "row_id").agg(
        F.sum(F.when(tf > 0, part).otherwise(0.0)).alias("bm25"),
        (F.sum(F.when(tf > 0, weight).otherwise(0.0)) / F.sum(weight)).alias("overlap"),
        F.first("whole").alias("whole"),
    )
    score = F.greatest(F.lit(0.0), F.col("bm25")) + F.coalesce("overlap", F.lit(0.0)) + F.when(F.col("whole"), 0.35).otherwise(0.0)
    scored = scored.select("query_id", "row_id", F.col("bm25"), F.col("overlap"), score.alias("score")).filter("score > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "row_id.chunk_index", "row_id.document_id")
    top = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    kept = corpus.drop("tokens", "wanted", "whole", "length")
    return kept.join(top, ["query_id", "row_id"]).drop("row_id")


def as_results(hits: DataFrame) -> DataFrame:
    """Hits of whatever store as chunks: `content` is the first of child_text, chunk_text and text that isn't empty.

    Columns that a store doesn't have are null, no text at all is an empty content, `distance` serves as the score
    where there is none, and other columns are kept.
    """
    have = set(hits.columns)
    texts = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("child_text", "chunk_text", "text", "content") if c in have]
    scores = [F.col(c).cast("double") for c in ("distance", "score") if c in have]
    kinds = dict.fromkeys(("child_id", "document_id", "parent_id", "source_name", "file_type", "content_type"), "string") | dict.fromkeys(("parent_index", "chunk_index"), "int")
    missing = {c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in have}
    return hits.withColumns({**missing, "content": F.coalesce(*texts, F.lit("")), "score": F.coalesce(*scores, F.lit(0.0))})


def dense_retrieve(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", threshold: float | None = None) -> DataFrame:
    """Exact cosine neighbours: query_id, key, score, rank for each query's `k` nearest.

    `queries`: query_id and vector, a stated set; they are collected in blocks of bounded size and multiplied with
    every batch of the corpus. Each task keeps its own best `k` of each query, so the shuffle has k rows a query and
    task. Vectors that are null, empty or zero have no neighbours. Scores are compared at nine digits, ties go by key.
    """
    rows = corpus.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    parts = [nearest.best_in_tasks(rows, names, vectors, k) for names, vectors in nearest.blocks(queries, vector)]
    kind = corpus.schema[key].dataType.simpleString()
    out = reduce(DataFrame.unionByName, parts) if parts else corpus.sparkSession.createDataFrame([], f"query_id string, key {kind}, score double, part int")
    if threshold is not None:
        out = out.filter(F.col("score") >= threshold)
    return nearest.ranked(out, k).withColumnRenamed("key", key)
