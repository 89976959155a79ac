"""The facade: ingest files, search with several queries and routes, and answer with an injected model."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import query as Q
from tessera.lexicon import CHINESE, Lexicon
from tessera.operators import chunks, evidence, fusion, recall, rerank
from tessera.plans.memory import Memories
from tessera.sources import files
from tessera.storage import stored

KEY = ["document_id", "chunk_index"]
NO_RESULTS = "当前知识库未检索到足够相关资料"
METHODS = ("hybrid", "dense", "sparse")


def ingest(spark: SparkSession, path: str, readers: dict[str, files.Reader] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read files and chunk them: (documents, parents, children). Documents without text or chunks have failed."""
    read = stored(files.read_files(spark, path, readers))
    parents, children = chunks.parent_children(read)
    counts = children.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"))
    documents = read.drop("text").join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    documents = documents.withColumn("status", F.when(F.col("chunk_count") > 0, "ready").otherwise("failed"))
    return documents.withColumnRenamed("error", "error_message"), parents, children


def hybrid(
    children: DataFrame,
    queries: Mapping[str, str],
    k: int,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | Callable[[], DataFrame] | None = None,
    method: str = "hybrid",
    weights: tuple[float, float] = (0.6, 0.4),
    terms_of: Callable[[str], list[str]] = Q.recall_terms,
) -> DataFrame:
    """Ranked routes of some queries: query_id, key columns, rank, score, failed_routes.

    `vectors` (key columns, embedding) and `query_vectors` (query_id, embedding) make the dense route; where they are
    missing the sparse one serves alone, and the other way round by `method`. Queries with an identifier never go
    by vectors alone. A route that fails is an error, whatever the other one finds. Only where `query_vectors` is a
    function, of a caller who can do without vectors, and that raises, the sparse route serves alone and each row names
    `dense` in failed_routes, else empty; a query without a row to say so makes it an error again.
    """
    use_dense = vectors is not None and query_vectors is not None and method != "sparse"
    worded = {q: t for q, t in queries.items() if not use_dense or method != "dense" or Q.is_identifier_query(t)}

    def sparse() -> DataFrame:
        names, most = list(worded), recall.MOST_QUERIES
        blocks = [{q: worded[q] for q in names[i : i + most]} for i in range(0, len(names), most)] or [{}]
        parts = [recall.sparse_retrieve(children, some, k, terms_of).select("query_id", *KEY, "rank", "score") for some in blocks]
        return reduce(DataFrame.unionByName, parts)

    def dense() -> DataFrame:
        kind = vectors.select(F.struct(*KEY).alias("key")).schema["key"].dataType.simpleString()
        near = recall.dense_retrieve(vectors.select(F.to_json(F.struct(*KEY)).alias("vec"), "embedding"), query_vectors, k, "vec")
        return near.withColumn("key", F.from_json("vec", kind)).select("query_id", "key.*", "rank", "score")

    def marked(found: DataFrame, *failed: str) -> DataFrame:
        return found.withColumn("failed_routes", F.array(*map(F.lit, failed)).cast("array<string>"))

    if not use_dense:
        return marked(sparse())
    if callable(query_vectors):
        try:
            query_vectors = query_vectors()
        except Exception:
            found = stored(sparse())
            if found.select("query_id").distinct().count() < len(queries):
                raise
            logging.getLogger(__name__).warning("queries have no vectors, the sparse route serves alone", exc_info=True)
            return marked(found, "dense")
    if not worded:
        return marked(dense())
    fused = fusion.fuse_dense_sparse(stored(dense()), stored(sparse()), KEY, weights, k)
    return marked(fused.select("query_id", *KEY, "rank", "score"))


def search_many(
    children: DataFrame,
    queries: Mapping[str, str],
    k: int = 5,
    parents: DataFrame | None = None,
    vectors: DataFrame | None = None,
    embed: Callable[[dict[str, str]], DataFrame] | None = None,
    method: str = "hybrid",
    lexicon: Lexicon = CHINESE,
    variants: Mapping[str, Sequence[str]] | None = None,
    words: bool = False,
) -> DataFrame:
    """Search chunks with some queries, each with its variants, in one plan: the cited results by query_id and cite_rank.

    `children` has document_id, chunk_index, child_id, parent_id, source_name, file_type and content. Each variant's
    route is recalled, routes are fused (the original weighing 1.4, others 0.75), the original's relevant hits and, in
    lookups, each route's first three tables with fitting fields are kept in the pool, the pool is reranked and
    filtered, and tables and parents are attached where `parents` is given.
    """
    k = min(50, max(1, k))
    asked = {q: rerank.Asked.of(t, lexicon, words) for q, t in queries.items()}
    told: dict[str, str] = {}
    for q, text in queries.items():
        every = list(variants[q]) if variants is not None else Q.variants(text)
        every = every if Q.is_identifier_query(text, lexicon) else every[: Q.MOST_VARIANTS]
        told |= {f"{i + 1}|{q}": t for i, t in enumerate(every)}
    pool_size = Q.candidate_limit(k)
    terms_of = (lambda t: Q.word_keywords(t, 12, lexicon)) if words else (lambda t: Q.recall_terms(t, lexicon=lexicon))
    asked_vectors = embed(told) if embed and vectors is not None and method != "sparse" else None
    found = hybrid(children, told, pool_size, vectors, asked_vectors, method, terms_of=terms_of)
    number = F.substring_index("query_id", "|", 1)
    routes = stored(found.select(F.expr("substring(query_id, instr(query_id, '|') + 1)").alias("query_id"), *KEY, number.alias("route"), "rank", "score"))
    weights = {str(i + 1): Q.VARIANT_WEIGHT if i else Q.ORIGINAL_WEIGHT for i in range(max((int(r.partition("|")[0]) for r in told), default=0))}
    fused = fusion.fuse_routes(routes, weights, KEY)
    # What the routes found is bounded; their texts are fetched once.
    keys = routes.select(*KEY).distinct()
    texts = stored(children.join(F.broadcast(keys) if routes.count() <= recall.BROADCAST_KEYS else keys, KEY))
    shown = rerank.signals(rerank.with_asked(routes.join(texts, KEY), asked, lexicon), lexicon)
    direct = shown.filter((F.col("route") == "1") & (F.col("rank") <= max(2 * k, 12)) & rerank.gate()).withColumn("turn", F.lit(0))
    tables = rerank.fitting_tables(shown).withColumn("turn", F.col("route").cast("int"))
    kept = direct.unionByName(tables).select("query_id", *KEY, F.struct("turn", "rank").alias("at"), "score")
    kept = kept.groupBy("query_id", *KEY).agg(F.min("at").alias("rank"), F.max("score").alias("score"))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", *KEY)))
    pool = fusion.keep_protected(fused.select("query_id", *KEY, "rank", "score"), kept, KEY, pool_size)
    pool = stored(pool.join(texts, KEY).withColumns({"source": F.lit("hybrid"), "position": F.col("rank")}))
    cited = rerank.filter_results(rerank.rerank(pool, asked, lexicon), asked, k, lexicon)
    cited = cited.withColumns({"rank": F.col("cite_rank"), "score": F.col("final_score")})
    if parents is None:
        return cited
    cited = stored(cited)
    sheets = {q: queries[q] for q, one in asked.items() if one.structured}
    rest = cited.filter(~F.col("query_id").isin(list(sheets))) if sheets else cited
    if sheets:
        found = evidence.sheet_evidence(cited.filter(F.col("query_id").isin(list(sheets))), parents, sheets, lexicon)
        rest = rest.unionByName(found, allowMissingColumns=True)
    return evidence.expand_parents(rest, parents)


def search(children: DataFrame, query: str, k: int = 5, parents: DataFrame | None = None, variants: Sequence[str] | None = None, **options) -> DataFrame:
    """`search_many` with one query, whose query_id is `q`."""
    return search_many(children, {"q": query}, k, parents, variants=None if variants is None else {"q": variants}, **options)


def raw_search(children: DataFrame, query: str, k: int = 5, vectors: DataFrame | None = None, embed: Callable[[dict[str, str]], DataFrame] | None = None, method: str = "sparse") -> DataFrame:
    """One route's own results with their content, neither reranked nor expanded."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    queries = {"q": query}
    found = hybrid(children, queries, min(50, max(1, k)), vectors, embed(queries) if embed and vectors is not None else None, method)
    return found.drop("failed_routes").join(children, KEY)


def chat_messages(
    query: str, history: Sequence[dict] = (), context: str = "", profile: Sequence[str] = (), memories: Sequence[str] = (), strategy: str = "window",
    n: int = 5, m: int = 10, summarise: Callable[[str, list[dict]], str] | None = None,
) -> list[dict]:
    """Messages for a model: system messages, the profile, memories, the context, short-term history, and the query.

    `window` keeps the last `n` turns; `summary` also folds older turns, max(m - n, 1) at a time, into one summary.
    """
    if strategy not in ("window", "summary") or n < 1 or (strategy == "summary" and m <= n):
        raise ValueError("strategy is window or summary, n at least 1, and m more than n for a summary")
    system = [x for x in history if x["role"] == "system"]
    turns: list[list[dict]] = []
    for x in history:
        if x["role"] == "user" or (not turns and x["role"] == "assistant"):
            turns.append([])
        if x["role"] in ("user", "assistant"):
            turns[-1].append(x)
    say = lambda text: [{"role": "system", "content": text}] if text else []
    older, told = turns[:-n], ""
    if strategy == "summary" and summarise is not None:
        for i in range(0, len(older), max(m - n, 1)):
            told = summarise(told, [x for t in older[i : i + max(m - n, 1)] for x in t])
    recent = [x for t in turns[-n:] for x in t]
    return [*system, *say("\n".join(profile)), *say("\n".join(memories)), *say(context), *say(told), *recent, {"role": "user", "content": query}]


def no_result_answer(query: str, identifier: bool) -> str:
    """What is said when nothing was found, so that no model guesses."""
    said = query.strip()
    if identifier:
        return f"当前知识库未检索到与“{said}”匹配的资料。请核对编号或名称是否准确，或确认相关文档已经上传并完成索引。"
    return f"{NO_RESULTS}，暂时无法依据已上传资料回答“{said}”。请确认相关文档已上传并完成索引，或补充制度名称、业务对象、时间、金额、项目环境等限定信息。"


def answer(
    children: DataFrame, query: str, llm: Callable[[list[dict]], str], k: int = 5, parents: DataFrame | None = None, history: Sequence[dict] = (), lexicon: Lexicon = CHINESE,
    memories: Memories | None = None, router: Callable[[str], str] | None = None, rewrite: Callable[[str, Sequence[dict]], str] | None = None, use_retrieval: bool = True, **options,
) -> dict:
    """Route, retrieve, recall, assemble a context and ask a model: answer, intent, context, sources.

    A question for the user's name is answered from `memories` alone. `router` decides where rules can't, `rewrite` writes
    the query that is searched for. Where retrieval finds nothing no model is asked. Otherwise the user's facts and the
    memories near the query go to the model with the context; a recall that fails is left out.
    """
    nothing = {"context": "", "sources": []}
    told = memories.name_answer(query) if memories is not None else None
    if told is not None:
        return {"answer": told, "intent": Q.Intent(False, "profile_name"), **nothing}
    intent = Q.route_intent(query, use_retrieval, router, lexicon)
    context, sources = "", []
    if intent.retrieve:
        asked = Q.resolve_query(query, intent, rewrite, history, lexicon)
        found = stored(search(children, asked, k, parents, lexicon=lexicon, **options))
        table = "aggregated" in found.columns and bool(found.filter("aggregated").limit(1).count())
        made = evidence.assemble_context(found, evidence.TABLE_CONTEXT_CHARS if table else evidence.CONTEXT_CHARS).first()
        if made is None:
            return {"answer": no_result_answer(query, Q.is_identifier_query(query, lexicon)), "intent": intent, **nothing}
        context = made["context"]
        sources = [r.asDict() for r in evidence.group_sources(found).collect()]
    profile, recalled = [], []
    if memories is not None:
        try:
            profile, recalled = memories.messages(query)
        except Exception:
            logging.getLogger(__name__).warning("memories could not be recalled and are left out", exc_info=True)
    said = llm(chat_messages(query, history, context, profile, recalled))
    return {"answer": Q.tidy_answer(said), "intent": intent, "context": context, "sources": sources}
