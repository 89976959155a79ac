"""A chat's memory leg and rewriting, projections of records, and many searches in one plan against few."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import query as Q
from tessera.lexicon import ENGLISH
from tessera.operators import embedding, recall, records
from tessera.plans import memory as plan
from tessera.plans import search
from tessera.schemas import MEMORY_RECORDS

NOW = datetime(2024, 6, 1)


def record(memory_id, kind, key, content, status="active", expires=None, importance=50.0, user="u"):
    return (memory_id, user, kind, key, content, "c1", "s1", importance, importance, 0.7, 0, None, expires, status, 1, None, NOW - timedelta(days=1), NOW - timedelta(days=1))


@pytest.fixture
def memories(spark):
    held = [
        record("p1", "profile", "profile.name", " Ann ", importance=60.0), record("p2", "profile", "profile.city", "Rome"), record("p3", "profile", "profile.old", "gone", "deleted"),
        record("e1", "event", "e", "【主题】报销\n【摘要】上限五百\n【原文】..."), record("e2", "event", "e", "other words"), record("e3", "event", "e", "差旅 报销 expired", expires=NOW - timedelta(days=1)),
        record("x", "event", "e", "差旅报销", user="else"),
    ]
    rows = spark.createDataFrame(held, MEMORY_RECORDS)
    texts = {"e1": "travel refund limit five hundred", "e2": "other words entirely", "e3": "travel refund limit", "x": "travel refund limit"}
    base = spark.createDataFrame([(m, "else" if m == "x" else "u", "c1", "s1", "dialogue", "", t) for m, t in texts.items()], "memory_id string, user_id string, conversation_id string, session_id string, chunk_type string, topic string, content string")
    return plan.Memories("u", rows, embedding.with_vectors(base), NOW)


def test_names_are_remembered(spark, memories):
    children = spark.createDataFrame([], "document_id string, chunk_index int, child_id string, parent_id string, source_name string, file_type string, content string")
    never = lambda m: pytest.fail("no model is asked")
    told = search.answer(children, "你还 记得我叫 什么吗", never, memories=memories)
    assert told["answer"] == "当然记得，你叫Ann。" and told["sources"] == []
    nobody = plan.Memories("nobody", memories.records, memories.vectors, NOW)
    assert nobody.name_answer("我叫什么") == plan.NO_NAME and nobody.name_answer("我喜欢什么") is None
    assert plan.asks_to_remember("请 记住 我喜欢茶") and not plan.asks_to_remember("hello")


def test_memories_go_to_the_model(spark, memories):
    got = [(r["memory_id"], r["live_rank"]) for r in memories.recall("travel refund limit").orderBy("live_rank").collect()]
    assert got[0] == ("e1", 1) and {m for m, _ in got} == {"e1", "e2"}  # neither what expired nor another user's
    children = spark.createDataFrame([], "document_id string, chunk_index int, child_id string, parent_id string, source_name string, file_type string, content string")
    seen = []
    search.answer(children, "你好 travel refund", lambda m: seen.extend(m) or "ok", memories=memories)
    system = [m["content"] for m in seen if m["role"] == "system"]
    assert system[0] == f"{plan.PROFILE_HEAD}\n- profile.name:  Ann \n- profile.city: Rome"
    assert system[1].startswith(f"{plan.MEMORY_HEAD}\n1. 报销：上限五百\n2. ")
    broken = plan.Memories("u", memories.records, memories.vectors.drop("embedding"), NOW)
    assert search.answer(children, "你好", lambda m: "still", memories=broken)["answer"] == "still"


def test_routes_and_rewrites():
    assert Q.intent_of({"intent": "KB", "confidence": "7", "search_query": " a  b "}) == Q.Intent(True, "llm:kb", "llm", 1.0, "a b")
    assert Q.intent_of({"action": "no_rag", "query": "x", "confidence": "?"}) == Q.Intent(False, "llm:no_rag", "llm", 0.5, "")
    assert Q.intent_of({"route": "maybe"}) is None and Q.intent_of({"use_rag": True}).retrieve
    ruled, told = Q.Intent(True, "knowledge_keyword", rewritten="x"), Q.Intent(True, "llm", "llm", 1.0, "差旅报销标准 2024")
    assert Q.resolve_query("差旅报销标准", ruled, lambda q, h: "other") == "差旅报销标准"
    assert Q.resolve_query("差旅报销标准", told) == "差旅报销标准 2024"
    lost = Q.Intent(True, "llm", "llm", 1.0, "weather")
    history = [{"role": r, "content": f"{r}{i}"} for i in range(5) for r in ("user", "assistant")]
    seen = []
    assert Q.resolve_query("差旅报销标准", lost, lambda q, h: seen.extend(h) or '{"query": "差旅报销标准 上限"}', history) == "差旅报销标准 上限"
    assert [m["content"] for m in seen] == ["user2", "assistant2", "user3", "assistant3", "user4", "assistant4"]
    assert Q.resolve_query("差旅报销标准", lost, lambda q, h: "weather") == "差旅报销标准" == Q.resolve_query("差旅报销标准", lost)
    assert Q.written_query("```json") == "" and Q.written_query(" plain\n text ") == "plain text"


def test_embedding_bounds(spark):
    assert embedding.bounded("one two three", 2) == "one two" and embedding.bounded("一二三四 x", 3) == "一二三" and embedding.bounded("a b", 5) == "a b"
    df = spark.createDataFrame([("one two three",), (None,)], "content string")
    got = [r["embedding"] for r in embedding.with_vectors(df, instruction="find: ", most=3).collect()]
    want = embedding.hashing_embedder(["find: one two", "find: "])
    assert [pytest.approx(w.tolist(), abs=1e-6) for w in want] == got


def test_projections(spark):
    user = spark.createDataFrame([("u", "h", "s", datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 60)), ("v", "h", "s", None, None)], "user_id string, password_hash string, password_salt string, created_at timestamp, updated_at timestamp")
    assert sorted(map(tuple, records.projected(user).collect()), key=str) == [("u", "2024-01-02T03:04:05", "2024-01-02T03:04:05.000060"), ("v", None, None)]
    kind = "q string, hits array<array<struct<distance: double, entity: struct<chunk_text: string, document_id: string>>>>"
    hits = spark.createDataFrame([("q", [[(0.42, ("t", "doc-1")), None, (0.1, None)], []]), ("r", None)], kind)
    assert [tuple(r) for r in records.flat_hits(hits).orderBy("hit_no").collect()] == [("q", 0, 0, 0.42, "t", "doc-1"), ("q", 0, 2, 0.1, None, None)]
    talks = spark.createDataFrame([("u", "a", 1), ("u", "b", 3), ("u", "c", 3), ("u", "d", None), ("v", "e", 0)], "user_id string, conversation_id string, updated_at int")
    assert sorted((r["conversation_id"], r["place"]) for r in records.recent_conversations(talks).collect()) == [("a", 3), ("b", 1), ("c", 2), ("d", 4), ("e", 1)]
    assert records.recent_conversations(talks, 1).count() == 2
    parts = spark.createDataFrame([(1, [("text", "a"), ("image", None), ("text", "b")]), (2, None)], "conv_id int, text array<struct<type: string, text: string>>")
    assert sorted(map(tuple, records.content_text(parts).collect())) == [(1, "ab"), (2, "")]
    assert records.content_text(spark.createDataFrame([(["x", None, "y"],)], "text array<string>")).first()[0] == "xy"
    assert records.content_text(spark.createDataFrame([("s",), (None,)], "text string")).filter("text is null").count() == 0
    with pytest.raises(ValueError):
        records.content_text(spark.createDataFrame([(1,)], "text int"))


def plain_hybrid(texts, queries, k):
    """BM25 with overlap and hashed words by cosine, fused: the two routes in plain Python."""
    import math
    import re

    import numpy as np

    words = {d: re.findall("[a-z0-9]+", f"src\n{t}".lower()) for d, t in texts.items()}
    flat = lambda t: re.sub(r"[\s\-_.,;:!?]+", "", t.lower())
    out = {}
    vectors = dict(zip(texts, embedding.hashing_embedder(list(texts.values())).astype(np.float32).astype(float), strict=True))
    for q, text in queries.items():
        terms = Q.recall_terms(text)
        held = sorted(d for d, t in texts.items() if any(x in t or x in "src" for x in terms))[: Q.scan_limit(k)]
        asked = re.findall("[a-z0-9]+", text.lower())
        mean = sum(len(words[d]) for d in held) / max(1, len(held))
        scored = []
        for d in held:
            bm25, share = 0.0, 0.0
            for w in dict.fromkeys(asked):
                tf, df = words[d].count(w), sum(w in words[x] for x in held)
                if tf:
                    bm25 += asked.count(w) * math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words[d]) / mean))
                    share += min(len(w), 8) / 8
            score = max(0, bm25) + share / sum(min(len(w), 8) / 8 for w in dict.fromkeys(asked)) + (0.35 if flat(text) in flat(f"src\n{texts[d]}") else 0)
            if score > 0:
                scored.append((-round(score, 9), d))
        sparse = [d for _, d in sorted(scored)[:k]]
        v = embedding.hashing_embedder([text])[0].astype(np.float32).astype(float)
        near = lambda x: float(x @ v / (np.linalg.norm(x) * np.linalg.norm(v)))
        dense = [d for _, d in sorted((-round(near(x), 9), d) for d, x in vectors.items() if x.any())[:k]] if v.any() else []
        fused = {}
        for at, (route, w) in enumerate(((dense, 0.6), (sparse, 0.4))):
            for r, d in enumerate(route, 1):
                score, first = fused.get(d, (0.0, (at, r)))
                fused[d] = (score + w / (60 + r), first)
        out[q] = [(d, round(s, 9)) for d, (s, f) in sorted(fused.items(), key=lambda x: (-round(x[1][0], 12), x[1][1], x[0]))[:k]]
    return out


def corpus(spark, rng, n):
    names = [f"word{i}" for i in range(60)]
    texts = {f"d{i:03}": " ".join(rng.choice(names) for _ in range(rng.randint(3, 60))) for i in range(n)}
    frame = spark.createDataFrame([(d, 0, d, d, "src", "txt", t) for d, t in texts.items()], "document_id string, chunk_index int, child_id string, parent_id string, source_name string, file_type string, content string")
    return texts, frame.repartition(3), {f"q{i}": " ".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for i in range(20)}


def test_both_routes_against_plain_ones(spark):
    texts, frame, queries = corpus(spark, random.Random(6), 90)
    vectors = embedding.with_vectors(frame).select("document_id", "chunk_index", "embedding")
    asked = embedding.with_vectors(spark.createDataFrame(list(queries.items()), "query_id string, content string"))
    got = {}
    for r in search.hybrid(frame, queries, 10, vectors, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["document_id"], round(r["score"], 9)))
    assert got == plain_hybrid(texts, queries, 10)


def test_routes_take_any_number_of_queries(spark, monkeypatch):
    """More queries than one plan holds: words still count, in several calls."""
    monkeypatch.setattr(recall, "MOST_QUERIES", 8)
    texts, frame, queries = corpus(spark, random.Random(6), 40)
    vectors = embedding.with_vectors(frame).select("document_id", "chunk_index", "embedding")
    asked = embedding.with_vectors(spark.createDataFrame(list(queries.items()), "query_id string, content string"))
    got = {}
    for r in search.hybrid(frame, queries, 10, vectors, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["document_id"], round(r["score"], 9)))
    assert got == plain_hybrid(texts, queries, 10)


def test_many_searches_are_those_of_few(spark):
    """Twenty queries, some structured and some with variants, in one plan and in halves: the same cited results."""
    rng = random.Random(7)
    _, frame, queries = corpus(spark, rng, 60)
    sheets = [(f"s{i}", 0, f"s{i}", f"s{i}", "staff.xlsx", "xlsx", f"[Sheet] staff\nname,department\nword{i},sales\nword{i + 20},hr") for i in range(8)]
    frame = frame.unionByName(spark.createDataFrame(sheets, frame.schema))
    queries |= {f"q{i}": f"employee name of word{i} department" for i in range(0, 20, 4)}
    parents = frame.select("parent_id", "document_id", F.lit(0).alias("parent_index"), F.col("content").alias("parent_text"))
    variants = {q: [t, " ".join(t.split()[:2])] if i % 3 else [t] for i, (q, t) in enumerate(queries.items())}

    def found(some):
        rows = search.search_many(frame, some, 4, parents, lexicon=ENGLISH, variants={q: variants[q] for q in some}, words=True)
        return {(r["query_id"], r["rank"], r["document_id"], r["content"], r["aggregated"] if "aggregated" in rows.columns else None) for r in rows.collect()}

    names = list(queries)
    every = found(queries)
    halves = found({q: queries[q] for q in names[::2]}) | found({q: queries[q] for q in names[1::2]})
    assert {r[:4] for r in every} == {r[:4] for r in halves} and len({r[0] for r in every}) >= 15
    assert any(r[4] for r in every)
