"""Core queries that SQL can't express, against plain versions over whole lists of the same rows."""

import re
from collections import defaultdict

import duckdb

from tessera import queries as core
from tessera.functions import chunking as C

DATA = "/root/testdata/sf0.001"
LABELS = {"user": "用户", "assistant": "助手"}


def messages():
    """(turn number, labelled text, role, bare text) of each conversation's messages that count, in order."""
    out = defaultdict(list)
    rows = duckdb.sql(f"SELECT conv_id, lower(trim(role)), coalesce(text, '') FROM '{DATA}/conversations.parquet' ORDER BY conv_id, turn").fetchall()
    for conv, role, text in rows:
        text = text.strip()
        if role in LABELS and text:
            held = out[conv]
            number = (held[-1][0] + (role == "user")) if held else 0
            held.append((number, f"{LABELS[role]}: {text}", role, text))
    return out


def got(spark, name):
    out = defaultdict(list)
    for r in sorted(core.QUERIES[name](spark, DATA).collect(), key=lambda r: (r["conv_id"], r["chunk_index"])):
        assert r["chunk_index"] == len(out[r["conv_id"]])
        out[r["conv_id"]].append({k: v for k, v in r.asDict().items() if k not in ("conv_id", "chunk_index")})
    return out


def greedy(held, size=500, overlap=80):
    """The longest run of blocks that fits, then the next one, which begins with the longest tail within `overlap`."""
    blocks = []
    for i, (_, labelled, role, text) in enumerate(held):
        taken = len(LABELS[role]) + 2
        parts = [text] if len(labelled) <= size else C.split_text(text, size - taken, overlap - taken)
        blocks += [(i, f"{LABELS[role]}: {p}") for p in parts]
    joined = lambda run: "\n\n".join(b for _, b in run)
    at, tail = 0, []
    while at < len(blocks):
        run = [*tail, blocks[at]]
        if len(joined(run)) > size:
            run = [blocks[at]]
        at += 1
        while at < len(blocks) and len(joined([*run, blocks[at]])) <= size:
            run.append(blocks[at])
            at += 1
        places = {i for i, _ in run}
        yield {"text": joined(run), "turn_start": min(places), "turn_end": max(places), "message_count": len(places)}
        keep = max(k for k in range(1, len(run) + 1) if k == 1 or len(joined(run[-k:])) <= overlap)
        tail = [] if len(joined(run)) > size else run[-keep:]


def by_topic(held, limit=200):
    """From each turn on the longest run of one first letter and at most `limit` words; a turn of more stands alone."""
    turns = [[] for _ in range(held[-1][0] + 1)]
    for number, labelled, *_ in held:
        turns[number].append(labelled)
    turns = ["\n".join(t) for t in turns]
    words = [max(1, len(re.findall(r"[A-Za-z0-9_]+|[一-鿿]", t))) for t in turns]
    letter = [t[4:5].lower() for t in turns]
    at, why = 0, "token_limit"
    while at < len(turns):
        end = at + 1
        large = words[at] > limit
        while not large and end < len(turns) and letter[end] == letter[at] and sum(words[at : end + 1]) <= limit:
            end += 1
        if not large:
            why = "flush" if end == len(turns) else "topic_change" if letter[end] != letter[at] else "token_limit"
        text = "\n\n".join(turns[at:end])
        yield text, at, end - 1, why
        if large:
            why = "token_limit"
        at = end


def test_greedy_memory_chunks(spark):
    want = {conv: list(greedy(held)) for conv, held in messages().items()}
    assert got(spark, "memory_chunks_greedy") == want
    assert any(len(c) > 2 for c in want.values())


def test_semantic_memory_chunks(spark):
    found = got(spark, "semantic_memory_chunks")
    want = {conv: list(by_topic(held)) for conv, held in messages().items()}
    assert {conv: [(r["transcript"], r["turn_start"], r["turn_end"], r["trigger_reason"]) for r in rows] for conv, rows in found.items()} == want
    for r in (r for rows in found.values() for r in rows):
        t = r["transcript"]
        assert (r["topic"], r["summary"], r["message_count"]) == (t[4:24].strip(), t[4:84].strip(), r["turn_end"] - r["turn_start"] + 1)
        assert r["text"] == f"【主题】{r['topic']}\n【摘要】{r['summary']}\n【原文】\n{t}"


def test_children_cover_their_documents(spark):
    """Every child is a stretch of its document within the size; in order, they leave only white space between them."""
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    children = defaultdict(list)
    for r in core.QUERIES["parent_child_chunks"](spark, DATA).collect():
        children[int(r["document_id"])].append(r)
    assert set(children) == {d for d, t in texts.items() if t and t.strip()}
    for doc, rows in children.items():
        rows.sort(key=lambda r: r["chunk_index"])
        assert [r["child_id"] for r in rows] == [f"{doc}:c{n:06d}" for n in range(len(rows))]
        parents = [r["parent_index"] for r in rows]
        assert parents == sorted(parents) and set(parents) == set(range(parents[-1] + 1))
        text, reached = texts[doc], 0
        for r in rows:
            assert 0 < len(r["child_text"]) <= C.CHILD_SIZE
            least = len(text) - len(text[reached:].lstrip())
            begin = text.rfind(r["child_text"], 0, least + len(r["child_text"]))  # the latest start that leaves no gap reaches farthest
            assert begin >= 0
            reached = max(reached, begin + len(r["child_text"]))
        assert not text[reached:].strip()
