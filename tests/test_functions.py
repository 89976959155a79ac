"""Text and query functions against worked examples, and against plain Python where both exist."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import chunking as C
from tessera.functions import query as Q
from tessera.functions import text as X
from tessera.lexicon import CHINESE, ENGLISH


def value(spark, column, **fields):
    df = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in fields))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("志愿填报", ["志愿填报", "志愿", "愿填", "填报", "志愿填", "愿填报"]),
        ("AB-12 志愿", ["ab", "12", "志愿"]),
        ("ÉTÉ", ["t"]),
        ("部门人", ["部门人", "部门", "门人"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, text, tokens):
    assert value(spark, X.tokens(F.col("t")), t=text) == tokens


def test_normalize_agrees_with_python(spark):
    texts = ["  A b-C_d.\n", "《标准》，；", "no。punct！", "x　y", "", "[a](b){c}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["v"] for r in df.select(X.normalize(F.col("t")).alias("v")).collect()] == list(map(Q.normalize, texts))


def test_token_estimates(spark):
    df = spark.createDataFrame([("ab_1 c",), ("标准 x",), ("…",), ("  ",), (None,)], "t string")
    assert [r["v"] for r in df.select(X.estimated_tokens(F.col("t")).alias("v")).collect()] == [2, 3, 1, 0, 0]


def test_headings_and_sheets(spark):
    sheet = "\n [Sheet]  员工名单 \n姓名,工号\n张,1"
    assert value(spark, X.heading_text(F.col("t")), t=sheet) == "[Sheet]  员工名单\n姓名,工号"
    assert value(spark, X.sheet_name(F.col("t")), t=sheet) == "员工名单"
    assert value(spark, X.sheet_name(F.col("t")), t="plain") == ""
    assert value(spark, X.is_structured(F.col("f"), F.col("t")), f=".XLSX", t="x")
    assert value(spark, X.is_reference_index(F.col("t"), CHINESE.index_markers), t="常见问题和检索提示")


def test_identifiers():
    assert Q.identifiers("查 AB-12 和 20231234") == ["AB-12", "ab-12", "AB12", "ab12", "20231234"]
    assert Q.canonical_identifiers("AB-12 ab12") == ["AB-12"]
    assert Q.identifiers("a1") == []
    assert Q.is_identifier_query("员工编号是什么") and Q.is_identifier_query("my id?") and not Q.is_identifier_query("idea")
    assert Q.variants("查 AB-12 和 CD-34")[1:] == ["AB-12", "CD-34"]


def test_recall_terms():
    assert Q.recall_terms("公司每个部门的负责人是谁") == ["部门", "负责人"]
    assert Q.recall_terms("") == []
    assert len(Q.recall_terms(" ".join(f"word{i}" for i in range(30)))) == 12


def test_focus_joins_adjoining_terms():
    assert Q.focus_terms("差旅报销标准")[0] == "差旅报销标准"
    assert "交通" in Q.focus_terms("城市交通")
    assert Q.keywords("差旅报销标准")[:3] == ["报销", "标准", "差旅"]
    assert Q.word_keywords("The quick the Fox a", lexicon=ENGLISH) == ["the", "quick", "fox"]


def test_limits():
    assert [Q.candidate_limit(k) for k in (1, 5, 10, 50)] == [60, 60, 80, 400]
    assert Q.scan_limit(1) == 80 and Q.scan_limit(10) == 300


def test_routing():
    assert Q.rule_intent("你好").reason == "direct_keyword"
    assert Q.rule_intent("报销流程").retrieve
    assert Q.rule_intent("翻译这个文档").reason == "signal_conflict"
    assert Q.rule_intent("", True).reason == "empty_query" and Q.rule_intent("x", False).reason == "retrieval_disabled"
    told = Q.route_intent("翻译这个文档", llm=lambda q: '```json\n{"needs_retrieval": false, "confidence": 3}\n```')
    assert told.source == "llm" and not told.retrieve and told.confidence == 1.0
    assert Q.route_intent("翻译这个文档", llm=lambda q: "no").reason == "fallback:signal_conflict"


def test_rewrites_keep_focus():
    assert Q.keeps_focus("差旅报销标准", "差旅报销标准是多少")
    assert not Q.keeps_focus("差旅报销标准", "天气")
    assert not Q.keeps_focus("", "x")


def test_tidy_answer():
    assert Q.tidy_answer("结论:  a\r\n- b\n- c\n\n\n\nd\n```\n x  \n```") == "结论: a\n\n- b\n- c\n\nd\n```\n x\n```"


def test_variants_put_the_query_first():
    assert Q.clean_variants(["1. foo", "foo", "bar"], "base") == ["base", "foo", "bar"]
    assert Q.clean_variants(["a", "b", "c", "d"], "base") == ["base", "a", "b", "c"]
    assert Q.heuristic_variants("请问部门的负责人是谁")[0] == "请问部门的负责人是谁"
    assert "部门负责人" in Q.aliases("部门的主管是谁")


# Chunks


@given(st.text(alphabet="ab 。\n，", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_chunks_hold_all_text(text, size, overlap):
    found = C.split_text(text, size, overlap)
    assert all(c == c.strip() and c for c in found)
    assert all(len(c) <= size for c in found)
    strip = lambda t: re.sub(r"\s", "", t)
    if not overlap:
        assert strip("".join(found)) == strip(text)


def test_split_prefers_paragraphs():
    assert C.split_text("aa bb\n\ncc dd", 8, 0) == ["aa bb", "cc dd"]
    assert C.split_text("abcdef", 4, 2) == ["abcd", "cdef"]


def test_headings():
    assert C.heading("## Title") == (2, "Title")
    assert C.heading("1.2. Scope") == (2, "1.2. Scope")
    assert C.heading("第三章 总则") == (1, "第三章 总则")
    assert C.heading("（二）范围") == (2, "（二）范围")
    assert C.heading("plain") is None and C.heading("1. 有句号。") is None


def test_sections():
    text = "# A\nbody one\n## B\nbody two\n# C\nbody three"
    assert C.sections(text) == [("A", "body one"), ("A / B", "body two"), ("C", "body three")]
    assert C.split_document(text, file_type="md") == ["[章节] A\nbody one", "[章节] A / B\nbody two", "[章节] C\nbody three"]
    assert C.sections("no heading") == []


def test_tables_keep_rows_and_headers():
    text = "[Sheet] S\nname,no\n" + "\n".join(f"person{i},{i}" for i in range(40))
    parents = C.split_document(text, 300, 0, "xlsx")
    assert all(p.startswith("[Sheet] S\nname,no\nperson") for p in parents) and len(parents) > 1
    assert sum(p.count("person") for p in parents) == 40
    assert C.split_rows(text)[0] == "[Sheet] S\nname,no\nperson0,0"
    assert C.parent_children("[Sheet] S\nname", "xlsx") == [("[Sheet] S\nname", ["[Sheet] S\nname"])]


def test_chat_packer():
    p = C.ChatPacker(size=20, overlap=8)
    done = [c for r, t in (("user", "aaaa"), ("assistant", "bbbb"), ("user", "c" * 40)) for c in p.add(r, t)] + list(p.close())
    assert done[0] == ("用户: aaaa\n\n助手: bbbb", 0, 1, 2)
    assert all(len(t) <= 20 for t, *_ in done) and done[-1][2] == 2


def test_topic_packer():
    p = C.TopicPacker(lambda held, turn: "new" in turn, lambda t: (t[:3],), limit=5)
    done = [m for t in ("one two", "three", "new topic", "a b c d e f g") for m in p.add(t)] + list(p.close())
    assert [m["trigger_reason"] for m in done] == ["topic_change", "token_limit", "token_limit"]
    assert [(m["turn_start"], m["turn_end"]) for m in done] == [(0, 1), (2, 2), (3, 3)]
    assert done[0]["summary"] == "one" and done[0]["text"].startswith("【主题】one\n【摘要】one\n【原文】\n")


def test_chunks_of_a_batch_are_held_in_parts():
    from tessera.operators.chunks import in_parts

    made, most = [], 0
    for part in in_parts(((100, made.append(i) or [i]) for i in range(1000)), 1000):
        most = max(most, len(part))
        assert len(made) == part.iloc[-1][0] + 1  # nothing is made ahead
    assert most == 10 and made == list(range(1000))
    assert [len(p) for p in in_parts(iter([(5000, []), (1, []), (0, [])]), 1000)] == [1, 2] and list(in_parts(iter([]))) == []


def test_vectors_of_a_batch_are_held_in_parts(monkeypatch):
    import pandas as pd

    from tessera.operators import embedding

    kept = []
    monkeypatch.setattr(embedding.F, "pandas_udf", lambda kind: lambda f: kept.append(f) or (lambda c: None))
    texts = pd.Series([f"word{i} other" if i % 5 else None for i in range(5000)])
    embedding.embed(None)
    parts = list(kept[0](iter([texts])))
    want = embedding.hashing_embedder(texts.fillna("").tolist())
    assert [v for p in parts for v in p] == want.tolist() and max(map(len, parts)) * embedding.DIMENSION <= embedding.MOST_NUMBERS
