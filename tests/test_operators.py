"""Operators on small literal tables."""

import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera import schemas
from tessera.lexicon import CHINESE
from tessera.operators import chunks, conversations, evidence, fusion, memory, recall, rerank, sheets
from tessera.plans import search
from tessera.queries import retrieval
from tessera.sources import files, rewrite

CHUNKS = "document_id string, chunk_index int, child_id string, parent_id string, source_name string, file_type string, content string"


def chunk_rows(spark, *texts, file_type="txt"):
    rows = [(f"doc-{i + 1}", i, f"c{i}", f"p{i}", f"{i}.txt", file_type, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNKS)


def test_sparse_prefers_more_terms(spark):
    held = chunk_rows(spark, "高考 志愿 填报 指南与更多说明", "志愿")
    found = recall.sparse_retrieve(held, {"q": "高考 志愿"}, 1).collect()
    assert [(r["document_id"], r["rank"]) for r in found] == [("doc-1", 1)]


def test_sparse_without_match(spark):
    held = chunk_rows(spark, "abc", None)
    assert recall.sparse_retrieve(held, {"q": "zzz"}, 5).count() == 0
    assert recall.sparse_retrieve(held, {"q": ""}, 5).count() == 0
    assert recall.sparse_retrieve(held.limit(0), {"q": "abc"}, 5).count() == 0


def test_dense_skips_empty_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = recall.dense_retrieve(vectors, spark.createDataFrame([("q", [2.0, 0.0]), ("e", [0.0, 0.0])], "query_id string, embedding array<double>"), 3)
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found.orderBy("rank").collect()] == [("q", 1, 1.0), ("q", 5, 1.0), ("q", 2, 0.6)]
    assert recall.dense_retrieve(vectors, vectors.select(F.lit("x").alias("query_id"), "embedding").limit(0), 3).count() == 0


def test_fusion_worked_example(spark):
    dense = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, k string, rank int")
    sparse = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "query_id string, k string, rank int")
    found = fusion.fuse_dense_sparse(dense, sparse, ["k"]).orderBy("rank").collect()
    assert [(r["k"], round(r["score"], 6), r["routes"]) for r in found] == [("b", 0.016235, ["dense", "sparse"]), ("a", 0.009836, ["dense"]), ("c", 0.006452, ["sparse"])]


def test_protected_results_replace_the_tail(spark):
    fused = spark.createDataFrame([("q", f"r{i}", i, 1.0 / i) for i in range(1, 6)], "query_id string, k string, rank int, score double")
    protected = spark.createDataFrame([("q", "r5", 1, 0.5), ("q", "r1", 2, 0.4)], "query_id string, k string, rank int, score double")
    found = fusion.keep_protected(fused, protected, ["k"], 3).orderBy("rank").collect()
    assert [r["k"] for r in found] == ["r1", "r2", "r5"]


def test_scores(spark):
    rows = [("sparse", 3.0), ("dense", -0.2), ("hybrid", 0.0162)]
    df = spark.createDataFrame(rows, "source string, score double")
    got = [r["v"] for r in df.select(rerank.source_score(F.col("score"), F.col("source")).alias("v")).collect()]
    assert got == pytest.approx([0.75, 0.4, 0.0162])
    for values, want in (([2.0, 2.0], [1.0, 1.0]), ([0.0, 0.0], [0.0, 0.0]), ([1.0, 3.0], [0.0, 1.0])):
        df = spark.createDataFrame([("q", v) for v in values], "query_id string, v double")
        assert sorted(r["x"] for r in df.select(rerank.min_max(F.col("v"), ["query_id"]).alias("x")).collect()) == want


def results(spark, *texts, file_type="txt"):
    held = chunk_rows(spark, *texts, file_type=file_type)
    return held.select("*", F.lit("q").alias("query_id"), F.lit(0.5).alias("score"), F.lit("hybrid").alias("source"), F.col("chunk_index").alias("position"))


def test_rerank_and_filter(spark):
    asked = rerank.Asked.of("差旅报销标准")
    ranked = rerank.rerank(results(spark, "天气预报", "差旅报销标准：住宿费用", "  "), asked)
    got = ranked.orderBy("final_rank").collect()
    assert [r["document_id"] for r in got] == ["doc-2", "doc-1"]
    assert got[0]["gate_passed"] and got[0]["exact_match"] and not got[1]["gate_passed"]
    assert [r["document_id"] for r in rerank.filter_results(ranked, asked, 3).collect()] == ["doc-2"]


def test_identifiers_are_protected(spark):
    asked = rerank.Asked.of("AB-12 和 CD-34 的资料")
    ranked = rerank.rerank(results(spark, "关于 ab12", "AB-12 AB-12", "cd_34 说明", "其他资料"), asked)
    got = {r["document_id"] for r in rerank.filter_results(ranked, asked, 1).collect()}
    assert "doc-3" in got and got & {"doc-1", "doc-2"}


def test_tables_by_header(spark):
    asked = rerank.Asked.of("员工的部门名单")
    assert asked.structured
    ranked = rerank.rerank(results(spark, "[Sheet] 员工名单\n姓名,工号,部门\n张,1,研发", "[Sheet] 说明\n字段,用途\n员工,部门", file_type="xlsx"), asked)
    assert [r["document_id"] for r in rerank.filter_results(ranked, asked, 5).orderBy("cite_rank").collect()][0] == "doc-1"


def test_sheet_evidence(spark):
    hits = results(spark, "[Sheet] 员工\n姓名,部门\n张三,研发", file_type="xlsx").withColumn("rank", F.lit(1))
    parents = spark.createDataFrame(
        [("doc-1", 0, "[Sheet] 员工\n姓名,部门\n张三,研发\n李四,销售"), ("doc-1", 1, "[Sheet] 员工\n姓名,部门\n李四,销售\n王五,研发"), ("doc-1", 2, "[Sheet] 其他\nx\ny")],
        "document_id string, parent_index int, parent_text string",
    )
    got = evidence.sheet_evidence(hits, parents, "销售").first()
    assert got["aggregated"] and got["score"] == pytest.approx(0.58)
    assert got["content"] == "[Sheet] 员工\n字段: 姓名、部门\n去重记录数: 3\n优先匹配行数: 1\n数据行:\n李四,销售\n张三,研发\n王五,研发"


def test_context_is_cut(spark):
    rows = [("q", 1, "a" * 50, "s", "d", 0), ("q", 2, "b" * 400, "s", "d", 1), ("q", 3, "c", "s", "d", 2)]
    df = spark.createDataFrame(rows, "query_id string, rank int, content string, source_name string, document_id string, chunk_index int")
    got = evidence.assemble_context(df, 300).first()
    assert got["n_blocks"] == 2 and got["n_chars"] == 300 and "c" * 1 not in got["context"].replace("chunk", "")


def test_parents_and_sources(spark):
    hits = results(spark, "x", "x").withColumn("rank", F.col("chunk_index") + 1)
    parents = spark.createDataFrame([("p0", "whole")], "parent_id string, parent_text string")
    got = {r["document_id"]: r["parent_context"] for r in evidence.expand_parents(hits.union(hits), parents).collect()}
    assert got == {"doc-1": "whole", "doc-2": None}
    assert [r["n_hits"] for r in evidence.group_sources(hits.union(hits)).orderBy("position").collect()] == [2, 2]


def test_content_cascade(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    one = spark.createDataFrame([("a", "one"), ("b", "")], "document_id string, content string")
    two = spark.createDataFrame([("a", "two"), ("b", "two")], "document_id string, content string")
    assert {r["document_id"]: r["content"] for r in evidence.content_cascade(docs, one, two).collect()} == {"a": "one", "b": "two", "c": None}


def test_turns(spark):
    rows = [("c", i, r, t) for i, (r, t) in enumerate([("assistant", "hi"), ("User ", "q1"), ("assistant", "a1"), ("user", "q2"), ("tool", "x"), ("user", " ")])]
    conv = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert [(r["turn"], r["turn_no"]) for r in conversations.segment_turns(conv).orderBy("turn").collect()] == [(0, 0), (1, 1), (2, 1), (3, 2)]
    assert [r["turn"] for r in conversations.last_turns(conv, 1).collect()] == [3]
    assert conversations.fold_summaries(conv, 1, 2, lambda s, b: s + f"<{b}>").first()["summary"] == "<助手: hi><用户: q1\n助手: a1>"
    assert conversations.memory_chunks(conv.limit(0)).count() == 0
    with pytest.raises(ValueError):
        conversations.older_batches(conv, 2, 2)


NOW = datetime(2024, 6, 1)


def record(spark, **fields):
    base = dict.fromkeys(schemas.MEMORY_RECORDS.names) | {
        "memory_id": "m", "user_id": "u", "memory_type": "event", "memory_key": "profile.x", "content": "v", "base_importance_score": 50.0, "importance_score": 50.0,
        "confidence_score": 0.65, "access_count": 0, "status": "active", "version": 1, "created_at": NOW, "updated_at": NOW,
    }
    row = base | fields
    return spark.createDataFrame([tuple(row[c] for c in schemas.MEMORY_RECORDS.names)], schemas.MEMORY_RECORDS)


@pytest.mark.parametrize(
    "fields, score, status",
    [
        ({}, 32.5, "active"),
        ({"created_at": NOW - timedelta(days=90)}, 11.96, "expired"),
        ({"created_at": NOW - timedelta(days=90), "access_count": 3}, 15.42, "expired"),
        ({"memory_type": "profile", "created_at": NOW - timedelta(days=170), "base_importance_score": 10.0}, 4.08, "active"),
        ({"expires_at": NOW}, 32.5, "expired"),
    ],
)
def test_decay(spark, fields, score, status):
    got = memory.maintain(record(spark, **fields), NOW).first()
    assert (got["importance_score"], got["status"]) == (score, status)


def test_purge(spark):
    assert memory.maintain(record(spark, status="deleted", updated_at=NOW - timedelta(days=31)), NOW).count() == 0
    assert memory.maintain(record(spark, status="deleted", updated_at=NOW - timedelta(days=29)), NOW).count() == 1


def test_importance(spark):
    a, b = memory.event_importance(F.lit("今天必须完成"), CHINESE)
    got = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (got["a"], got["b"]) == (51.0, 0.55)


def test_profile_versions(spark):
    schema = "user_id string, memory_key string, value string, action string, confidence double, importance double, conversation_id string, session_id string, position int"
    old = record(spark, memory_type="profile")

    def after(*rows):
        given = spark.createDataFrame([("u", k, v, a, None, None, None, None, i) for i, (k, v, a) in enumerate(rows)], schema)
        return sorted((r["memory_key"], r["content"], r["status"], r["version"], r["importance_score"]) for r in memory.upsert_profiles(old, given, NOW).collect())

    assert after(("Profile.X ", " v ", "upsert")) == [("profile.x", "v", "active", 1, 75.0)]
    assert after(("profile.x", "w", None)) == [("profile.x", "v", "superseded", 1, 50.0), ("profile.x", "w", "active", 2, 75.0)]
    assert after(("profile.x", "w", "upsert"), ("profile.x", "", "delete")) == [("profile.x", "v", "deleted", 1, 50.0)]
    assert after(("9bad", "w", "upsert"), ("profile.y", " ", "upsert")) == [("profile.x", "v", "active", 1, 50.0)]


def test_event_records(spark):
    rows = spark.createDataFrame([("n", "u", "今天必须完成", "c", None, "summary", 0)], "memory_id string, user_id string, text string, conversation_id string, session_id string, chunk_type string, chunk_index int")
    one = memory.register_events(record(spark).limit(0), rows, NOW)
    two = memory.register_events(one, rows.withColumn("memory_id", F.lit("n2")), NOW)
    assert sorted((r["memory_id"], r["status"], r["version"]) for r in two.collect()) == [("n", "superseded", 1), ("n2", "active", 2)]
    assert memory.forget(two, "u", "c", NOW).filter("status = 'active'").count() == 0
    with pytest.raises(ValueError):
        memory.active_profiles(two, " ", NOW)


def test_sheets(spark):
    rows = [("s", 0, ["Report", "", ""]), ("s", 1, ["name", "team", "pay"]), ("s", 2, ["a", "x", "1"]), ("s", 3, ["b", "", "2"]), ("t", 5, ["only"])]
    df = spark.createDataFrame(rows, "sheet string, row_no int, cells array<string>")
    assert {r["sheet"]: r["header_row"] for r in sheets.infer_header(df).collect()} == {"s": 1, "t": 5}
    heads = spark.createDataFrame([("s", i, h) for i, h in enumerate(["a", " ", "a", "Unnamed: 1", None])], "sheet string, position int, header string")
    assert [r["name"] for r in sheets.unique_headers(heads).orderBy("position").collect()] == ["a", "列2", "a_2", "列4", "列5"]
    assert {r["sheet"]: r["content"] for r in sheets.render_sheet(df).collect()}["t"] == "[Sheet] t\nonly"


def test_rewrites(spark):
    table = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    assert sorted(map(tuple, rewrite.replace_keys(table, new, ["k"]).collect())) == [("a", 9), ("b", 3)]
    docs = spark.createDataFrame([("a", "ready"), ("b", "processing")], "document_id string, status string")
    held = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, n int")
    marked, left = rewrite.purge_documents(docs, held, spark.createDataFrame([("a",), ("b",), ("z",)], "document_id string"))
    assert sorted(map(tuple, marked.collect())) == [("a", "deleting"), ("b", "processing")] and [r["document_id"] for r in left.collect()] == ["b"]
    with pytest.raises(ValueError):
        schemas.require_columns(table, ["k", "missing"])


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    docx = f"<w:document {W}><w:body>{p('Hello')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    (tmp_path / "a.docx").write_bytes(_zip({"word/document.xml": docx}))
    book = f'<workbook {S}><sheets><sheet name="员工" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    cell = lambda r, t: f'<c r="{r}" t="inlineStr"><is><t>{t}</t></is></c>'
    sheet = f'<worksheet {S}><sheetData><row r="1">{cell("A1", "name")}{cell("B1", "no, id")}</row><row r="3">{cell("A3", "x")}<c r="B3"><v>7.0</v></c></row></sheetData></worksheet>'
    (tmp_path / "b.xlsx").write_bytes(_zip({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet}))
    (tmp_path / "c.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "d.bin").write_bytes(b"x")
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r["source_name"]: (r["text"], r["error"]) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"][0] == "Hello\n\n[表格]\na | b"
    assert got["b.xlsx"][0] == '[Sheet] 员工\nname,"no, id"\nx,7'
    assert got["c.txt"][0] == "中文"
    assert got["d.bin"][0] is None and got["e.docx"][0] is None and "BadZipFile" in got["e.docx"][1]
    documents, parents, children = search.ingest(spark, str(tmp_path))
    assert {r["source_name"]: r["status"] for r in documents.collect()} == {"a.docx": "ready", "b.xlsx": "ready", "c.txt": "ready", "d.bin": "failed", "e.docx": "failed"}
    assert children.join(parents, "parent_id", "left_anti").count() == 0


def test_chunk_ids(spark):
    docs = spark.createDataFrame([("d", "n", "txt", "word " * 300), ("e", "n", "txt", None)], "document_id string, source_name string, file_type string, text string")
    parents, children = chunks.parent_children(docs)
    assert [r["chunk_index"] for r in children.orderBy("chunk_index").collect()] == list(range(children.count()))
    assert children.orderBy("chunk_index").first()["child_id"] == "d:c000000" and parents.filter("document_id = 'e'").count() == 0


def test_search_and_answer(spark):
    held = chunk_rows(spark, "差旅报销标准：住宿每晚三百元。", "天气预报", "采购流程说明")
    parents = spark.createDataFrame([("p0", "doc-1", 0, "第一章 差旅\n差旅报销标准：住宿每晚三百元。")], "parent_id string, document_id string, parent_index int, parent_text string")
    got = search.search(held, "差旅报销标准是什么", 3, parents).orderBy("rank").collect()
    assert got[0]["document_id"] == "doc-1" and got[0]["parent_context"].startswith("第一章")
    told = search.answer(held, "差旅报销标准是什么", lambda m: m[0]["content"][:20], parents=parents)
    assert told["answer"].startswith("[资料1] 来源: 0.txt") and told["sources"][0]["source_name"] == "0.txt"
    assert search.answer(held, "合同编号 ZZ-99", lambda m: "never")["answer"] == search.no_result_answer("合同编号 ZZ-99", True)
    assert search.answer(held, "你好", lambda m: "hi")["answer"] == "hi"


def test_sheet_text_has_notes_and_fills():
    from tessera.functions import sheet_rows as S

    rows = [["Staff list", "", "", ""], ["", "", "", ""], ["部门", "name", "", "工资"], ["研发", "a", "x", "1"], ["", "b", "", "2"], ["", "c", "", ""]]
    assert S.sheet_text("s", rows) == "[Sheet] s\n部门,name,列3,工资\n[说明] Staff list\n研发,a,x,1\n研发,b,,2\n研发,c,,"
    assert S.preview('[Sheet] s\na,"b,c"\n1') == [("s", ["a", "b,c"], [["1", ""]])]
    assert S.sheet_text("s", [["", " "]]) == "" and S.header_row([["only"]]) == 0


def test_messages_in_order():
    history = [{"role": "system", "content": "s"}] + [{"role": r, "content": f"{r[0]}{i}"} for i in range(3) for r in ("user", "assistant")]
    said = [m["content"] for m in search.chat_messages("q", history, "ctx", ["p"], ["m"], n=1)]
    assert said == ["s", "p", "m", "ctx", "u2", "a2", "q"]
    folded = search.chat_messages("q", history, strategy="summary", n=1, m=2, summarise=lambda s, b: s + b[0]["content"])
    assert [m["content"] for m in folded] == ["s", "u0u1", "u2", "a2", "q"]
    with pytest.raises(ValueError):
        search.chat_messages("q", strategy="summary", n=3, m=3)


def test_embedding_and_raw_search(spark):
    from tessera.operators import embedding

    held = chunk_rows(spark, "alpha beta", "gamma delta", None)
    vectors = embedding.with_vectors(held).select("document_id", "chunk_index", "embedding")
    queries = lambda q: embedding.with_vectors(spark.createDataFrame(list(q.items()), "query_id string, content string"))
    got = search.raw_search(held, "gamma delta", 1, vectors, queries, "dense").collect()
    assert [r["document_id"] for r in got] == ["doc-2"]
    both = search.raw_search(held, "gamma delta", 2, vectors, queries, "hybrid").orderBy("rank").collect()
    assert both[0]["document_id"] == "doc-2"
    with pytest.raises(ValueError):
        search.raw_search(held, "x", method="other")


def test_sessions_slide(spark):
    from tessera.operators import accounts

    t = lambda m: NOW + timedelta(minutes=m)
    sessions = spark.createDataFrame([("u", "s1", t(60), None), ("u", "s2", t(60), None), ("v", "s3", t(0), None)], "user_id string, session_id string, expires_at timestamp, revoked_at timestamp")
    asked = spark.createDataFrame([("s1", t(50)), ("s1", t(109)), ("s2", t(60)), ("s2", t(61))], "session_id string, at timestamp")
    moved = {r["session_id"]: r["expires_at"] for r in accounts.renewed(sessions, asked).collect()}
    assert moved == {"s1": t(169), "s2": t(60), "s3": t(0)}
    users = spark.createDataFrame([("u", True), ("v", True)], "user_id string, is_active boolean")
    claims = spark.createDataFrame([("u", "s1"), ("v", "s3"), ("v", "s1")], "user_id string, session_id string")
    assert [r["session_id"] for r in accounts.authorised(claims, users, sessions, NOW).collect()] == ["s1"]
    assert accounts.revoked(sessions, "u", "s1", NOW).filter("revoked_at is not null").count() == 1
    assert accounts.password_fits("pw", "00ff", accounts.password_hash("pw", "00ff")) and not accounts.password_fits("pW", "00ff", accounts.password_hash("pw", "00ff"))


def test_candidates_from_answers(spark):
    told = '```json\n{"memories":[{"memory_key":"profile.name","value":"Ann","confidence":0.9,"importance":"80"},{"memory_key":"profile.city","action":"delete"}]}\n```'
    answers = spark.createDataFrame([("u", None, None, told), ("u", None, None, "none")], "user_id string, conversation_id string, session_id string, answer string")
    given = memory.parse_candidates(answers)
    assert [r["memory_key"] for r in given.orderBy("position").collect()] == ["profile.name", "profile.city"]
    after = memory.upsert_profiles(record(spark).limit(0), given, NOW).collect()
    assert [(r["memory_key"], r["importance_score"], r["confidence_score"]) for r in after] == [("profile.name", 80.0, 0.9)]


def test_conversation_summaries(spark):
    rows = [("c", 0, "user", "first?"), ("c", 1, "assistant", "intro\n- one\n- two\n- three"), ("c", 2, "user", "second?"), ("c", 3, "assistant", "A. B. C.")]
    got = conversations.summaries(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).first()
    assert (got["n_turns"], got["questions"], got["highlights"]) == (2, ["first?", "second?"], ["one", "two", "A", "B"])


def test_missing_tables_are_empty(spark):
    assert schemas.table_or_empty(spark, "no_such_table", schemas.PARENTS).count() == 0
    assert schemas.wrong_dimensions(spark.createDataFrame([([1.0],), (None,)], "v array<double>"), "v", 1).count() == 1


def test_memory_is_stored_and_forgotten(spark):
    from tessera.plans import memory as plan

    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"message {i} 必须记住这个重要决定") for i in range(14)] + [(2, 0, "user", "other"), (3, 0, "user", "nobody's")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    owners = spark.createDataFrame([(1, "u", "s"), (2, "v", None), (3, " ", None)], "conv_id long, user_id string, session_id string")
    empty = spark.createDataFrame([], schemas.MEMORY_RECORDS)
    now = datetime(2024, 5, 1)
    vectors, records = plan.store_conversations(conversations, owners, empty, now, size=60, overlap=10)
    held = vectors.collect()
    assert {r["user_id"] for r in held} == {"u", "v"} and all(r["embedding"] for r in held) and len({r["memory_id"] for r in held}) == len(held) > 2
    assert {r["memory_id"] for r in records.collect()} == {r["memory_id"] for r in held}
    vectors, records = plan.forget(vectors, records, "u", "1", now)
    assert {r["user_id"] for r in vectors.collect()} == {"v"}
    assert {(r["user_id"], r["status"]) for r in records.collect()} == {("u", "deleted"), ("v", "active")}
    one = [r["memory_id"] for r in vectors.collect()]
    vectors, records = plan.forget_ids(vectors, records, "v", one, now)
    assert vectors.count() == 0 and {r["status"] for r in records.collect()} == {"deleted"}
    topics, _ = plan.store_topics(conversations, owners, empty, now, lambda a, b: False, lambda t: "topic：x", short_window=2)
    assert {(r["chunk_type"], r["conversation_id"]) for r in topics.collect()} == {("semantic", "1")}
    with pytest.raises(ValueError):
        plan.forget(vectors, records, "", "1", now)
    with pytest.raises(ValueError):
        plan.forget_ids(vectors, records, "u", [], now)


def test_failing_route_is_empty(spark):
    def broken():
        raise RuntimeError("no model")

    rows = chunk_rows(spark, "差旅报销标准：住宿费用", "天气预报")
    vectors = rows.select("document_id", "chunk_index", F.array(F.lit(1.0)).alias("embedding"))
    found = search.hybrid(rows, {"q": "差旅报销"}, 3, vectors, broken).collect()
    assert [r["document_id"] for r in found] == ["doc-1"]
    with pytest.raises(RuntimeError):
        search.hybrid(rows, {"q": "天气怎么样"}, 3, vectors, broken, method="dense")


def test_failure_is_no_result(spark, monkeypatch):
    """What one route finds doesn't pass for the result of both."""
    rows = chunk_rows(spark, "差旅报销标准：住宿费用", "天气预报")
    vectors = rows.select("document_id", "chunk_index", F.array(F.lit(1.0)).alias("embedding"))
    asked = spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>")
    longer = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, embedding array<double>")  # fails in a task

    def broken(*_, **__):
        raise RuntimeError("no model")

    with pytest.raises(PySparkException):
        search.hybrid(rows, {"q": "差旅报销"}, 3, vectors, longer).collect()
    with pytest.raises(PySparkException):
        search.hybrid(rows, {"q": "差旅报销"}, 3, vectors.drop("embedding"), asked).collect()
    with pytest.raises(RuntimeError):
        search.search(rows, "差旅报销", 3, vectors=vectors, embed=broken).collect()
    whole = search.hybrid(rows, {"q": "差旅报销"}, 3, vectors, lambda: asked).collect()
    assert len(whole) == 2 and all(r["failed_routes"] == [] for r in whole)
    # A caller who can do without vectors is told so in each row, and has an error where a query has none.
    assert [r["failed_routes"] for r in search.hybrid(rows, {"q": "差旅报销"}, 3, vectors, broken).collect()] == [["dense"]]
    with pytest.raises(RuntimeError):
        search.hybrid(rows, {"q": "差旅报销", "r": "xyz"}, 3, vectors, broken)
    monkeypatch.setattr(recall, "sparse_retrieve", broken)
    with pytest.raises(RuntimeError):
        search.hybrid(rows, {"q": "差旅报销"}, 3, vectors, asked).collect()
    with pytest.raises(RuntimeError):
        retrieval.embedded_search(spark, "/root/testdata/sf0.001").collect()


def test_fitting_tables_are_kept_by_route(spark):
    from tessera.functions import query as Q

    tables = ["[Sheet] 员工名单\n姓名,工号,部门\n张,1,研发"] * 5 + ["[Sheet] 天气\n气温,风\n1,2"]
    asked = {"q": rerank.Asked.of("员工的部门名单"), "r": rerank.Asked.of("差旅")}
    held = results(spark, *tables, file_type="xlsx").withColumns({"rank": F.col("chunk_index"), "route": F.lit("1")})
    both = held.unionByName(held.withColumn("query_id", F.lit("r"))).unionByName(held.withColumn("route", F.lit("2")))
    kept = rerank.fitting_tables(rerank.signals(rerank.with_asked(both, asked))).collect()
    assert sorted((r["query_id"], r["route"], r["rank"]) for r in kept) == [("q", x, i) for x in "12" for i in sorted(r["rank"] for r in held.collect())[:3]]
    assert Q.is_structured_lookup("员工的部门名单")
