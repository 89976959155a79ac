"""Work inside one row or group grows as its size does, and plans don't grow with the query set."""

import time

from pyspark.sql import functions as F
from test_llm_operators import CLASH, VOCABULARY, documents, got

from tessera.llm import bpe, chat_format, decontaminate, secrets, substring_dedup


def seconds(work):
    best = 1e9
    for _ in range(3):
        start = time.perf_counter()
        work()
        best = min(best, time.perf_counter() - start)
    return best


def test_secrets_of_long_texts():
    model = secrets.MarkovPair(secrets.transitions(secrets.drawn_strings()), secrets.transitions(["ordinaryidentifier", "another_common_name"]))
    text = lambda n: "".join(f"token = abcdefgh{i:08} then Xk29fQzr81LmPw0aTTv{i:06} \n" for i in range(n))
    small, large = (seconds(lambda n=n: secrets.all_spans(text(n), model, -1.0)) for n in (5_000, 20_000))
    assert large < 10 * small
    spans = secrets.all_spans(text(300), model, -1.0)
    base = secrets.base_spans(text(300))
    brute = [(m.start(), m.end(), "random") for m in secrets.RUN.finditer(text(300)) if not any(a < m.end() and m.start() < b for a, b, _ in base) and model.score(m[0]) > -1.0]
    assert sorted(spans) == sorted(base + brute) and brute


def test_many_special_strings():
    words = bpe.load(VOCABULARY).words
    texts = ["<|endoftext|>x" * n for n in (20_000, 80_000)]
    split = [words(t) for t in texts]
    small, large = (seconds(lambda s=s: bpe.without(*s)) for s in split)
    assert large < 10 * small
    assert bpe.without(["a", "b", "c", "d"], [0, 2]) == ["b", "d"] and bpe.without(["a"], []) == ["a"]


def test_long_conversations(spark):
    """One conversation of 100,000 turns: the assistant's texts are where the spans say."""
    n = 100_000
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    log = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit(0).alias("part"), F.col("id").alias("seq"), F.lit("open").alias("event"), role.alias("role"), F.lit("").alias("text"))
    said = log.withColumns({"event": F.lit("delta"), "text": F.concat(F.lit("[t"), F.col("turn").cast("string"), F.lit("]")), "seq": F.col("seq") + n})
    start = time.perf_counter()
    row = chat_format.format_chats(log.unionByName(said)).first()
    took = time.perf_counter() - start
    spans = row["loss_spans"]
    assert len(spans) == n // 2 and all(row["formatted"][s["start"] : s["end"]] == f"[\\t{2 * i + 1}]" for i, s in enumerate(spans))
    assert took < 120


def test_benchmarks_of_any_size_are_one_stage(spark):
    items = spark.range(400).select(F.col("id").alias("item_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), (F.col("id") * 7 % 31).cast("string")) for k in range(30))).alias("text"))
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before "), F.substring("text", 1, 150), F.lit(" after")).alias("text")).limit(60)
    one, many = (decontaminate.find_contamination(docs, items, pass_bytes=most) for most in (1 << 20, 2000))
    for found in (one, many):
        assert found._jdf.queryExecution().toString().count("MapInArrow") == 4  # once in each of the four plans
    assert got(one) == got(many) and one.filter("contaminated").count() == 60


def test_long_items_are_split():
    words = " ".join(f"w{i % 50}" for i in range(1000))
    every = list(decontaminate.pieces("a", words, 10, 300))
    assert len(every) > 5 and all(sum(map(len, w)) < 400 for _, w, _ in every)
    windows = {tuple(w[i : i + 10]) for _, w, size in every for i in range(len(w) - size + 1)}
    whole = decontaminate.words_of(words)
    assert windows == {tuple(whole[i : i + 10]) for i in range(991)}
    assert list(decontaminate.pieces("a", " .. ", 10, 300)) == [] and list(decontaminate.pieces("a", "one two", 10, 1)) == [("a", [b"one", b"two"], 2)]


def test_decontamination_of_long_texts_and_other_columns(spark):
    text = "a b " * 100_000 + "one two three four five six seven eight nine ten " + "c " * 100_000
    docs = documents(spark, text, None).withColumns({c: F.lit("x") for c in ("items", "hit", "n_words", "contaminated")})
    table = spark.createDataFrame([(1, "ONE two three four five six seven eight nine ten", "x")], "item_id long, text string, hit string")
    rows = got(decontaminate.find_contamination(docs, table))
    assert [(r[0], r[1], r[2], r[-1]) for r in rows] == [(0, 300_010, 10, True), (1, 0, 0, False)]


def test_secrets_without_key_and_with_other_columns(spark):
    docs = documents(spark, "password = hunter2hunter2", None).withColumns({c: F.lit("x") for c in ("n_assign", "base_sha256", "random")}).withColumn("doc_id", F.lit(None).cast("long"))
    rows = secrets.scan(docs, secrets.train(docs)).collect()
    assert sorted((r["doc_id"], r["n_assign"]) for r in rows) == [(None, 0), (None, 1)]


def test_event_logs_with_other_columns(spark):
    kinds = "conv_id long, turn long, part int, seq long, event string, role string, text string, " + ", ".join(f"{c} string" for c in [*CLASH, "chat", "piece", "again", "log"])
    rest = ["x"] * (len(CLASH) + 4)
    log = spark.createDataFrame([(1, 0, 0, 0, "open", "user", None, *rest), (1, 0, 0, 1, "delta", None, "hi", *rest)], kinds)
    row = chat_format.format_chats(log).first()
    assert row["formatted"] == "<s>[INST] user [/INST]hi</s>" and row["loss_spans"] == []


def test_repeats_with_other_columns(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, passage, "x " + passage).withColumns({c: F.lit("x") for c in ("n_words", "n_removed", "kept", "anchor")})
    found = substring_dedup.remove_repeats(docs, window=50, keep_text=False).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in found] == [0, 60]
