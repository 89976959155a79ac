"""Sections and sheets as rows against one text in memory."""

import random

from pyspark.sql import functions as F

from tessera.functions import chunking as C
from tessera.operators import sections

LINES = [
    "# A", "## B  b", "### C", "###### deep", "# ", "#no", "1. one", "1.2. two", "2.1.3、three", "第一章 总则", "一、范围", "（二）细则", "(3) more", "plain text here", "more plain", "", "", "  ",
    "long 。 with stop", "3. has ; inside", "x" * 150, "1.5 is a number", "　wide　 space", "第二条：x", "# # twice",
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "document_id int, text string").repartition(3)


def some_texts(n):
    rng = random.Random(11)
    breaks = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", " "]
    return ["".join(rng.choice(LINES) + rng.choice(breaks) for _ in range(rng.randint(0, 25))) for _ in range(n)] + [None, "", "no heading", "# only"]


def test_headings_are_told_alike(spark):
    df = spark.createDataFrame([(x.strip(),) for x in LINES], "line string").select("line", sections.heading(F.col("line")).alias("h"))
    for r in df.collect():
        want = C.heading(r["line"])
        got = None if r["h"] is None else (r["h"]["level"], r["h"]["title"])
        assert got == (None if want is None else (want[0], want[1].lstrip("#").strip() if want[1].startswith("#") else want[1])), r["line"]


def test_sections_are_those_of_one_text(spark):
    texts = some_texts(120)
    got = {}
    for r in sections.sections(frame(spark, texts)).orderBy("document_id", "section_no").collect():
        got.setdefault(r["document_id"], []).append((r["path"], r["body"]))
    want = {i: C.sections(t) for i, t in enumerate(texts)}
    assert got == {i: s for i, s in want.items() if s} and len(got) > 80
    assert sections.sections(frame(spark, ["nothing", None])).collect() == []


def test_section_chunks(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(LINES[:12]) + "\n" + "句子。" * rng.randint(0, 90) + " word" * rng.randint(0, 60) for _ in range(rng.randint(1, 6))) for _ in range(25)]
    got = {}
    for r in sections.section_chunks(frame(spark, texts)).orderBy("document_id", "section_no", "at").collect():
        got.setdefault(r["document_id"], []).append(r["content"])
    want = {i: C.split_sections(t, C.ARTICLE_SIZE, C.ARTICLE_OVERLAP, C.ARTICLE_SEPARATORS) for i, t in enumerate(texts)}
    assert got == {i: c for i, c in want.items() if c}


def test_rows_of_tables(spark):
    texts = ["[Sheet] a\nh1,h2\n1,2\n[说明] x\n\n3,4\n[sheet]  b \nonly", "before\nrow\n[Sheet] c\nh\n1", "no sheet\nat all", None, "[Sheet] d"]
    got = {}
    for r in sections.row_chunks(frame(spark, texts)).orderBy("document_id", "sheet_no", "row_no").collect():
        got.setdefault(r["document_id"], []).append(r["content"])
    assert got == {i: c for i, t in enumerate(texts) if t and any(n for n, _ in C.sheets(t)) and (c := C.split_rows(t))}
