"""Retrieval queries: documents as chunks, the openings of benchmark items as the stated query set, embeddings as vectors."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import query as Q
from tessera.functions import text as X
from tessera.lexicon import ENGLISH
from tessera.operators import chunks, embedding, evidence, fusion, recall, rerank, text_index, vector_index
from tessera.plans import search
from tessera.queries.registry import Registry, table
from tessera.storage import new_path, stored

K, POOL = 5, 150
_registry = Registry()


def as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk."""
    docs = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    return docs.select(
        F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), name.alias("child_id"), name.alias("parent_id"),
        F.col("source").alias("source_name"), F.lit("txt").alias("file_type"), F.col("text").alias("content"),
    )


def asked(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The first six words of every fiftieth benchmark item."""
    rows = table(spark, sf_dir, "benchmark").filter("item_id % 50 = 0").collect()
    return {str(r["item_id"]): " ".join(re.findall(r"[^ \t\n\r]+", r["text"] or "")[:6]) for r in rows}


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")


# Parts of the oracles

_NORM = r"""regexp_replace(lower({}), '[\s\-_.,;:!?，。！？；：、“”‘’\\"''`~…·/\\|()\[\]{{}}<>《》]+', '', 'g')"""


def norm(x: str) -> str:
    return _NORM.format(x)


def ordered(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


_ASKED = r"""
q0 AS (SELECT CAST(item_id AS VARCHAR) AS query_id, array_to_string(regexp_extract_all(text, '[^ \t\n\r]+')[1:6], ' ') AS qt
       FROM benchmark WHERE item_id % 50 = 0),
q1 AS (SELECT query_id, qt, regexp_extract_all(lower(qt), '[a-z0-9]+') AS words,
              list_filter(regexp_extract_all(lower(qt), '[a-z0-9]+'), lambda x: len(x) >= 2) AS long_words FROM q0),
q AS (SELECT query_id, qt, words, list_filter(long_words, lambda x, i: list_position(long_words, x) = i)[1:12] AS terms FROM q1),
cand AS (SELECT * FROM (
  SELECT q.query_id, q.qt, q.words, q.terms, d.doc_id, d.source, d.text,
         row_number() OVER (PARTITION BY q.query_id ORDER BY d.doc_id) AS rn
  FROM documents d JOIN q ON len(list_filter(q.terms, lambda t: contains(d.text, t) OR contains(d.source, t))) > 0) WHERE rn <= 150)"""

_BM25 = (
    "WITH"
    + _ASKED
    + f""",
tok AS (SELECT query_id, qt, words, doc_id, regexp_extract_all(lower(source || chr(10) || text), '[a-z0-9]+') AS toks,
               {norm("qt")} <> '' AND contains({norm("source || chr(10) || text")}, {norm("qt")}) AS whole FROM cand),
base AS (SELECT *, len(toks) AS n, count(*) OVER (PARTITION BY query_id) AS docs, avg(len(toks)) OVER (PARTITION BY query_id) AS mean FROM tok),
flat AS (SELECT query_id, doc_id, whole, n, docs, mean, toks, words, unnest(list_distinct(words)) AS t FROM base),
tf AS (SELECT query_id, doc_id, whole, n, docs, mean, t, len(list_filter(words, lambda x: x = t)) AS asked,
              len(list_filter(toks, lambda x: x = t)) AS tf FROM flat),
df AS (SELECT *, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, t) AS df FROM tf),
part AS (SELECT query_id, doc_id, any_value(whole) AS whole,
   sum(CASE WHEN tf > 0 THEN asked * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean)) ELSE 0 END) AS bm25,
   sum(CASE WHEN tf > 0 THEN least(len(t), 8) / 8.0 ELSE 0 END) / sum(least(len(t), 8) / 8.0) AS overlap
   FROM df GROUP BY query_id, doc_id),
scored AS (SELECT query_id, doc_id, greatest(0, bm25) + coalesce(overlap, 0) + CASE WHEN whole THEN 0.35 ELSE 0 END AS score FROM part),
ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE score > 0)
"""
)


@_registry.add("WITH" + _ASKED + " SELECT query_id, doc_id FROM cand")
def sparse_candidate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 documents with a term of each query."""
    terms = {q: Q.recall_terms(t) for q, t in asked(spark, sf_dir).items()}
    return recall.candidates(as_chunks(spark, sf_dir), terms, POOL).select("query_id", F.col("document_id").alias("doc_id"))


@_registry.add(_BM25 + "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.sparse_retrieve(as_chunks(spark, sf_dir), asked(spark, sf_dir), K)
    return found.select("query_id", F.col("document_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_KNN = """
WITH q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.query_id, e.vec_id, e.label, round(list_cosine_similarity(q.qv, e.embedding::DOUBLE[]), 9) AS score FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def _nearest(spark: SparkSession, sf_dir: str, k: int, **options) -> DataFrame:
    return recall.dense_retrieve(table(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), k, **options)


@_registry.add(_KNN + "SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def dense_knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@_registry.add()
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by an index over all vectors, and each query's recall against the exact ten.

    As many cells are probed as the stated queries need for a recall of 0.9 each.
    """
    vectors, queries = table(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir)
    index = vector_index.VectorIndex.build(vectors, new_path(spark, "vectors"))
    exact = stored(_nearest(spark, sf_dir, 10).select("query_id", "vec_id"))
    found = stored(index.search(queries, 10, probes=index.probes_for(queries, exact)))
    hit = found.join(exact.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    recall_of = F.round(F.sum(F.coalesce("hit", F.lit(0))).over(Window.partitionBy("query_id")) / 10, 6)
    return hit.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), recall_of.alias("recall"))


@_registry.add(_KNN + "SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def ivf_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by the index, exactly: cells are left out where their bounds allow it."""
    index = vector_index.VectorIndex.build(table(spark, sf_dir, "embeddings"), new_path(spark, "vectors"))
    found = index.search(vector_queries(spark, sf_dir), 10)
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@_registry.add("WITH" + _ASKED + " SELECT query_id, doc_id FROM cand")
def indexed_candidate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 documents with a term of each query, by an index of trigrams."""
    index = text_index.TextIndex.build(as_chunks(spark, sf_dir), new_path(spark, "chunks"))
    terms = {q: Q.recall_terms(t) for q, t in asked(spark, sf_dir).items()}
    return index.candidates(terms, POOL).select("query_id", F.col("document_id").alias("doc_id"))


@_registry.add(_KNN + "SELECT query_id, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10 AND score >= 0.5")
def similarity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 10, threshold=0.5).select("query_id", "vec_id", F.round("score", 6).alias("score"))


_ROUTES = """
WITH q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.query_id, e.vec_id, round(list_cosine_similarity(q.qv, e.embedding::DOUBLE[]), 9) AS a,
             round(list_cosine_similarity(q.qv[1:32], (e.embedding::DOUBLE[])[1:32]), 9) AS b FROM q, embeddings e),
r1 AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, vec_id) AS rank FROM s),
r2 AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, vec_id) AS rank FROM s),
routes AS (SELECT query_id, vec_id, rank, 'a' AS route, 0 AS place FROM r1 WHERE rank <= 20
           UNION ALL SELECT query_id, vec_id, rank, 'b', 1 FROM r2 WHERE rank <= 20),
"""


def _two_routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    half = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    vectors, queries = table(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir)
    return recall.dense_retrieve(vectors, queries, 20), recall.dense_retrieve(half(vectors), half(queries), 20)


def _fused_sql(first: float, second: float, limit: int) -> str:
    return (
        _ROUTES
        + f"""f AS (SELECT query_id, vec_id, sum(CASE WHEN place = 0 THEN {first} ELSE {second} END / (60 + rank)) AS score, min(place * 1000 + rank) AS seen,
       string_agg(route, ',' ORDER BY place) AS routes FROM routes GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, vec_id) AS rank FROM f)
SELECT query_id, vec_id, rank, round(score, 9) AS score, routes FROM o WHERE rank <= {limit}"""
    )


def _fused(found: DataFrame) -> DataFrame:
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), F.array_join("routes", ",").alias("routes"))


@_registry.add(_fused_sql(0.6, 0.4, 10))
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_routes(spark, sf_dir)
    routes = a.select("query_id", "vec_id", "rank", F.lit("a").alias("route")).union(b.select("query_id", "vec_id", "rank", F.lit("b")))
    return _fused(fusion.fuse_routes(routes, {"a": 0.6, "b": 0.4}, ["vec_id"], 10))


@_registry.add(_fused_sql(1.4, 0.75, 20))
def multi_query_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two routes as an original query and a variant."""
    a, b = _two_routes(spark, sf_dir)
    routes = a.select("query_id", "vec_id", "rank", F.lit("a").alias("route")).union(b.select("query_id", "vec_id", "rank", F.lit("b")))
    return _fused(fusion.fuse_routes(routes, {"a": Q.ORIGINAL_WEIGHT, "b": Q.VARIANT_WEIGHT}, ["vec_id"], 20))


@_registry.add(
    _KNN
    + """, p AS (SELECT query_id, vec_id, (greatest(-1, least(1, score)) + 1) / 2 AS v FROM r WHERE rank <= 20),
m AS (SELECT *, min(v) OVER (PARTITION BY query_id) AS lo, max(v) OVER (PARTITION BY query_id) AS hi FROM p)
SELECT query_id, vec_id, round(CASE WHEN hi - lo > 1e-9 THEN (v - lo) / (hi - lo) WHEN v > 0 THEN 1 ELSE 0 END, 6) AS normalized FROM m"""
)
def score_normalize_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _nearest(spark, sf_dir, 20).withColumn("v", rerank.source_score(F.col("score"), F.lit("dense")))
    return found.select("query_id", "vec_id", F.round(rerank.min_max(F.col("v"), ["query_id"]), 6).alias("normalized"))


@_registry.add(
    _KNN
    + """, p AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM r WHERE rank <= 20)
SELECT query_id, vec_id, round(score, 6) AS score FROM p WHERE score >= greatest(0.28, 0.62 * best) OR (rank = 1 AND best >= 0.28)"""
)
def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.score_floor(_nearest(spark, sf_dir, 20)).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@_registry.add(
    """WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
s AS (SELECT e.label, e.vec_id, round(list_cosine_similarity(q.qv, e.embedding::DOUBLE[]), 9) AS score FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT label, vec_id, rank FROM r WHERE rank <= 3"""
)
def route_topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label the three vectors nearest to the first one."""
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.filter("vec_id = 0").select("embedding").first()
    against = F.array(*(F.lit(float(x)) for x in one["embedding"]))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col("embedding").cast("array<double>")
    scored = vectors.select("label", "vec_id", F.round(dot(v, against) / F.sqrt(dot(v, v) * dot(against, against)), 9).alias("score"))
    return evidence.top_per_group(scored, ["label"], [F.desc("score"), "vec_id"], 3).select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries' candidates with a stand-in score by length, for reranking."""
    found = recall.candidates(as_chunks(spark, sf_dir), {q: Q.recall_terms(t) for q, t in asked(spark, sf_dir).items()}, POOL)
    score = F.pmod(F.length("content"), F.lit(97)) / 10.0
    return found.select("*", score.alias("score"), F.lit("sparse").alias("source"), F.col("document_id").alias("position"))


def _asked(spark: SparkSession, sf_dir: str) -> dict[str, rerank.Asked]:
    return {q: rerank.Asked.of(t, ENGLISH, words=True) for q, t in asked(spark, sf_dir).items()}


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.rerank(_pool(spark, sf_dir), _asked(spark, sf_dir), ENGLISH)


def _coverage(terms: str, body: str) -> str:
    weight = "least(len(t), 12) / 12.0"
    return (
        f"CASE WHEN len({terms}) = 0 OR {body} = '' THEN 0.0 ELSE least(1.0, ((CASE WHEN contains({body}, array_to_string({terms}[1:3], '')) THEN 1.0 ELSE 0.0 END)"
        f" + coalesce(list_sum(list_transform(list_filter({terms}, lambda t: contains({body}, t)), lambda t: {weight})), 0.0))"
        f" / list_sum(list_transform({terms}, lambda t: {weight}))) END"
    )


_RERANK = (
    "WITH"
    + _ASKED
    + f""",
k AS (SELECT query_id, doc_id, source, text, {norm("qt")} AS nq, list_filter(terms, lambda t: t NOT IN ('company', 'document', 'documents')) AS kw,
             (length(text) % 97) / 10.0 AS raw0 FROM cand WHERE regexp_matches(text, '\\S')),
b AS (SELECT *, kw[1:2] AS focus, {norm("source || chr(10) || text")} AS body,
             {norm("coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '')")} AS head, raw0 / (raw0 + 1) AS rs FROM k),
c AS (SELECT *, min(rs) OVER w AS lo, max(rs) OVER w AS hi, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY query_id)),
u AS (SELECT query_id, doc_id, n, unnest(kw) AS t, body FROM c),
v AS (SELECT query_id, doc_id, contains(body, t) AS has, (ln((n + 1) / (1 + sum(CASE WHEN contains(body, t) THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, t))) + 1) * least(len(t), 8) / 8.0 AS w FROM u),
sp AS (SELECT query_id, doc_id, least(1.0, sum(CASE WHEN has THEN w ELSE 0 END) / sum(w)) AS spec FROM v GROUP BY 1, 2),
s AS (SELECT c.*, coalesce(sp.spec, 0.0) AS spec,
   CASE WHEN hi - lo > 1e-9 THEN (rs - lo) / (hi - lo) WHEN rs > 0 THEN 1.0 ELSE 0.0 END AS rn,
   len(list_filter(kw, lambda t: contains(body, t))) AS hits, len(list_filter(kw, lambda t: len(t) >= 3 AND contains(body, t))) AS longs,
   len(list_filter(focus, lambda t: contains(body, t))) AS fhits,
   {_coverage("kw", "body")} AS kc, {_coverage("focus", "body")} AS fc, {_coverage("kw", "head")} AS hc, {_coverage("focus", "head")} AS hfc,
   nq <> '' AND contains(body, nq) AS exact FROM c LEFT JOIN sp USING (query_id, doc_id)),
g AS (SELECT *, len(kw) = 0 OR exact OR ((CASE WHEN len(kw) <= 2 THEN hits >= 1 OR kc >= 0.28 ELSE longs >= 1 OR hits >= 2 OR kc >= 0.22 END)
   AND NOT (len(focus) >= 2 AND fhits < 2 AND fc < 0.18 AND hc < 0.30)) AS gate FROM s),
z AS (SELECT *, 0.20 * rn + 0.20 * kc + 0.24 * spec + 0.16 * fc + 0.08 * hc + 0.12 * hfc + CASE WHEN exact THEN 0.25 ELSE 0 END
   + CASE WHEN gate THEN 0.22 ELSE -0.22 END + 0.03 AS final FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 12) DESC, raw0 DESC, doc_id) AS final_rank FROM z)
"""
)


@_registry.add(_RERANK + "SELECT query_id, doc_id, final_rank, round(final, 6) AS final_score FROM r")
def rerank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", F.col("document_id").alias("doc_id"), F.col("final_rank").cast("long").alias("final_rank"), F.round("final_score", 6).alias("final_score"))


@_registry.add(_RERANK + "SELECT query_id, doc_id, gate, round(kc, 6) AS keyword_coverage, round(hc, 6) AS heading_coverage, CAST(hits AS BIGINT) AS keyword_hits FROM r")
def gate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select(
        "query_id", F.col("document_id").alias("doc_id"), F.col("gate_passed").alias("gate"), F.round("keyword_coverage", 6).alias("keyword_coverage"),
        F.round("heading_coverage", 6).alias("heading_coverage"), F.col("keyword_hits").cast("long").alias("keyword_hits"),
    )


@_registry.add(_RERANK + "SELECT query_id, doc_id, round(spec, 6) AS specificity FROM r")
def keyword_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", F.col("document_id").alias("doc_id"), F.round("specificity", 6).alias("specificity"))


@_registry.add(
    _RERANK
    + """, a AS (SELECT *, max(CASE WHEN gate THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS gated FROM r),
p AS (SELECT *, max(final) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY final_rank) AS place FROM a WHERE gate OR gated = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_rank) AS cite_rank FROM p WHERE CASE WHEN gated = 0 THEN place <= 3
   ELSE final >= greatest(0.28, 0.62 * best) OR (place = 1 AND best >= 0.28) END)
SELECT query_id, doc_id, cite_rank FROM f WHERE cite_rank <= 3"""
)
def cited_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final filter over each query's reranked pool."""
    plain = {q: replace(one, structured=False) for q, one in _asked(spark, sf_dir).items()}
    out = rerank.filter_results(rerank.rerank(_pool(spark, sf_dir), plain, ENGLISH), plain, 5, ENGLISH)
    return out.select("query_id", F.col("document_id").alias("doc_id"), F.col("cite_rank").cast("long").alias("cite_rank"))


@_registry.add(
    "WITH"
    + _ASKED
    + """, b AS (SELECT query_id, rn, '[资料' || rn || '] 来源: ' || source || ' / chunk: 0' || chr(10)
   || regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS block FROM cand),
s AS (SELECT *, 6500 - coalesce(sum(len(block)) OVER (PARTITION BY query_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b),
p AS (SELECT query_id, rn, CASE WHEN len(block) <= room THEN block WHEN room > 120 THEN rtrim(substr(block, 1, CAST(room AS BIGINT))) END AS part FROM s WHERE room > 0)
SELECT query_id, md5(string_agg(part, chr(10) || chr(10) ORDER BY rn)) AS context_md5, count(*) AS n_blocks, CAST(sum(len(part)) AS BIGINT) AS n_chars
FROM p WHERE part IS NOT NULL GROUP BY 1"""
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context of at most 6500 characters out of each query's candidates in order."""
    out = _pool(spark, sf_dir).withColumn("rank", F.col("document_id"))
    return evidence.assemble_context(out).select("query_id", F.md5("context").alias("context_md5"), "n_blocks", "n_chars")


@_registry.add(
    "WITH"
    + _ASKED
    + """, g AS (SELECT query_id, source AS source_name, min(rn) AS seen, count(*) AS n_hits, CAST(max(doc_id) AS BIGINT) AS last_doc FROM cand GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seen, source_name) AS position FROM g)
SELECT query_id, position, source_name, n_hits, CAST(last_doc AS DOUBLE) AS max_score FROM r WHERE position <= 3"""
)
def source_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sources among each query's candidates."""
    out = _pool(spark, sf_dir).withColumn("rank", F.col("document_id"))
    hits = out.withColumns({"parent_id": F.col("source_name"), "score": F.col("document_id").cast("double")})
    return evidence.group_sources(hits).select("query_id", F.col("position").cast("long").alias("position"), "source_name", "n_hits", "max_score")


@_registry.add("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = evidence.first_wins(docs, ["text"], ["doc_id"])
    return kept.join(docs.groupBy("text").agg(F.count("*").alias("n")), "text").select("doc_id", "n")


_LINES = """WITH l0 AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
l1 AS (SELECT doc_id, source, trim(line, ' ' || chr(9) || chr(13)) AS line, i FROM l0),
l AS (SELECT doc_id, source, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index FROM l1 WHERE line <> '')
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return chunks.line_chunks(docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_name"), "text"))


@_registry.add(_LINES + "SELECT doc_id, count(*) AS n_chunks, md5(string_agg(line, chr(10) || chr(10) ORDER BY chunk_index)) AS content_md5 FROM l GROUP BY 1")
def document_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = evidence.reassemble(_lines(spark, sf_dir))
    return held.select(F.col("document_id").alias("doc_id"), "n_chunks", F.md5("content").alias("content_md5"))


@_registry.add(_LINES + "SELECT l.doc_id, chunk_index, len(d.text) AS parent_chars FROM l JOIN documents d USING (doc_id) WHERE contains(line, 'All rights reserved')")
def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License lines as hits, with the documents that hold them."""
    hits = _lines(spark, sf_dir).filter(F.contains("content", F.lit("All rights reserved")))
    hits = hits.withColumns({"query_id": F.lit("q"), "child_id": F.concat_ws(":", "document_id", "chunk_index"), "parent_id": F.col("document_id").cast("string"), "rank": F.col("chunk_index")})
    parents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("parent_id"), F.col("text").alias("parent_text"))
    out = evidence.expand_parents(hits, parents)
    return out.select(F.col("document_id").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.length("parent_context").cast("long").alias("parent_chars"))


@_registry.add()
def parent_child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into parents and children."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("source_name"), F.lit("txt").alias("file_type"), "text")
    return chunks.parent_children(docs)[1]


@_registry.add("SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def document_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, rows = evidence.page(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 20, 20)
    return rows.withColumn("total", F.lit(total).cast("long"))


@_registry.add(r"SELECT page_id, lower(regexp_replace(url, '[\s_-]+', '', 'g')) AS key, contains(lower(regexp_replace(url, '[\s_-]+', '', 'g')), '100') AS hit FROM pages")
def identifier_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    none = F.lit("")
    return pages.select("page_id", X.identifier_key(F.col("url")).alias("key"), X.contains_identifier(F.col("url"), none, none, "1-00").alias("hit"))


@_registry.add(r"SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))) ELSE 0 END AS n_tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.estimated_tokens(F.col("text")).cast("long").alias("n_tokens"))


@_registry.add(
    "SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 AND source <> '' THEN source WHEN doc_id % 4 = 1 THEN coalesce(lang, '') ELSE coalesce(text, '') END) AS content_md5, CAST(n_chars AS DOUBLE) AS score FROM documents WHERE source IS NOT NULL"
)
def hit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a store that has their texts in one of three columns."""
    docs = table(spark, sf_dir, "documents").filter("source is not null")
    kind = F.col("doc_id") % 4
    hits = docs.select(
        "doc_id", F.when(kind == 0, F.col("source")).alias("child_text"), F.when(kind == 1, F.coalesce("lang", F.lit(""))).otherwise("").alias("chunk_text"),
        F.when(kind != 1, F.col("text")).alias("text"), F.col("n_chars").alias("distance"),
    )
    return recall.as_results(hits).select("doc_id", F.md5("content").alias("content_md5"), "score")


@_registry.add("SELECT md5(text) AS content_md5, source, lang, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN lang IS NULL THEN 2 ELSE 3 END AS n FROM documents WHERE text IS NOT NULL")
def serialized_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the columns that answers don't show as a map."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("text").alias("content"), "source", "doc_id", "lang", F.lit("txt").alias("file_type"), F.lit(1).alias("_inner"))
    out = evidence.serialize(docs)
    return out.select(F.md5("content").alias("content_md5"), "source", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["doc_id"].alias("doc_id"), F.size("metadata").alias("n"))


@_registry.add()
def embedded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both routes over all documents: hashed words as vectors, and BM25; the ten best of each query."""
    held = as_chunks(spark, sf_dir)
    vectors = stored(embedding.with_vectors(held).select("document_id", "chunk_index", "embedding"))
    queries = asked(spark, sf_dir)
    texts = spark.createDataFrame(list(queries.items()), "query_id string, content string")
    found = search.hybrid(held, queries, 10, vectors, embedding.with_vectors(texts))
    return found.select("query_id", F.col("document_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@_registry.add()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search for all queries: recall, fusion over variants, reranking and the final filter, with parents."""
    held = as_chunks(spark, sf_dir)
    parents = held.select("parent_id", "document_id", F.lit(0).alias("parent_index"), F.col("content").alias("parent_text"))
    queries = asked(spark, sf_dir)
    found = search.search_many(held, queries, K, parents, lexicon=ENGLISH, variants={q: [t, " ".join(t.split()[:3])] for q, t in queries.items()}, words=True)
    return found.select("query_id", F.col("document_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.length("parent_context").cast("long").alias("parent_chars"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
