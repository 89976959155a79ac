"""As-of and interval joins, and the table functions, against loops and the operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.operators import conversations, timejoin

T0 = datetime(2024, 3, 1)


def events(spark, rng, n, name):
    rows = [(rng.choice(["a", "a", "a", "b", None]), None if rng.random() < 0.05 else T0 + timedelta(minutes=rng.randint(0, 4000)), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"k string, ts timestamp, {name} long").repartition(3)


@pytest.mark.parametrize("piece", [60.0, 86_400.0, 1e9])
def test_as_of(spark, piece):
    rng = random.Random(1)
    left_rows, left = events(spark, rng, 150, "l")
    right_rows, right = events(spark, rng, 100, "r")
    got = {r["l"]: (r["r"], r["x"]) for r in timejoin.as_of(left, right.withColumn("x", F.when(F.col("r") % 3 > 0, F.col("r"))), ["k"], "ts", "ts", ["r", "x"], "r", piece).collect()}
    for k, t, i in left_rows:
        found = max(((s, r) for q, s, r in right_rows if q == k and s is not None and t is not None and s <= t), default=(None, None))[1]
        assert got[i] == (found, None if found is None or found % 3 == 0 else found)
    assert len(got) == 150
    assert timejoin.as_of(left, right.limit(0), ["k"], "ts", "ts", ["r"]).filter("r is not null").count() == 0
    assert timejoin.as_of(left.limit(0), right, ["k"], "ts", "ts", ["r"]).count() == 0


@pytest.mark.parametrize("before, after", [(3600, 0), (0, 1800), (600, 7200)])
def test_intervals(spark, before, after):
    rng = random.Random(2)
    left_rows, left = events(spark, rng, 120, "l")
    right_rows, right = events(spark, rng, 120, "r")
    want = sorted(
        (i, j) for k, t, i in left_rows for q, s, j in right_rows
        if k is not None and k == q and t is not None and s is not None and t - timedelta(seconds=before) <= s <= t + timedelta(seconds=after)
    )
    got = timejoin.interval_join(left, right, ["k"], "ts", "ts", before, after, ["r"])
    assert sorted((r["l"], r["r"]) for r in got.collect()) == want and want
    outer = timejoin.interval_join(left, right, ["k"], "ts", "ts", before, after, ["r"], "left")
    alone = {i for _, _, i in left_rows} - {i for i, _ in want}
    assert sorted(((r["l"], r["r"]) for r in outer.collect()), key=str) == sorted([*want, *((i, None) for i in alone)], key=str)
    with pytest.raises(ValueError):
        timejoin.interval_join(left, right, ["k"], "ts", "ts", 0, 0, ["r"])


def conversation_rows(spark):
    rng = random.Random(3)
    rows = []
    for c in range(12):
        for t in range(rng.randint(0, 25)):
            role = rng.choice(["user", " Assistant", "system", "tool", None, "USER"])
            rows.append((c, t, role, rng.choice([None, "", "  ", "short　", "x" * 700, "word " * rng.randint(1, 90)]), "more"))
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, extra string").repartition(3)


def shown(df, names):
    return sorted(str(tuple(r)) for r in df.select(*names).collect())


def test_table_functions_say_what_operators_do(spark):
    conv = conversation_rows(spark)
    conv.createOrReplaceTempView("conversation_rows")
    changes, summarise = (lambda held, turn: held[6:7] != turn[6:7]), (lambda t: {"topic": t[:9], "summary": t[:30]})
    tables.register(spark, changes, summarise)
    names = ["conv_id", "chunk_index", "text", "turn_start", "turn_end", "message_count"]
    over = "TABLE(conversation_rows) PARTITION BY conv_id ORDER BY turn"
    assert shown(spark.sql(f"SELECT * FROM memory_chunks({over})"), names) == shown(conversations.memory_chunks(conv), names)
    small = spark.sql(f"SELECT * FROM memory_chunks({over}, size => 120, overlap => 30, include_system => true)")
    assert shown(small, names) == shown(conversations.memory_chunks(conv, 120, 30, True), names) and small.count() > 20
    more = [*names, "topic", "summary", "transcript", "trigger_reason"]
    assert shown(spark.sql(f"SELECT * FROM semantic_chunks({over}, token_limit => 60)"), more) == shown(conversations.semantic_chunks(conv, changes, summarise, 60), more)
    typed = spark.sql("SELECT * FROM memory_chunks(TABLE(SELECT CAST(conv_id AS string) AS conv_id, turn, role, text FROM conversation_rows) PARTITION BY conv_id ORDER BY turn)")
    assert dict(typed.dtypes)["conv_id"] == "string"
    for wrong in ("memory_chunks(TABLE(SELECT 1 AS conv_id) PARTITION BY conv_id)", f"memory_chunks({over}, size => -1)", "memory_chunks(5)"):
        with pytest.raises(Exception, match="no column|0 or more|is a table"):
            spark.sql(f"SELECT * FROM {wrong}").collect()


@pytest.mark.parametrize("piece", [60, 7200, 10**9])
def test_idle_sessions_over_pieces(spark, piece):
    from tessera.streaming.events import idle_sessions

    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2]), T0 + timedelta(minutes=30 * rng.randint(0, 150))) for i in range(150)] + [(200, 3, T0), (201, 3, T0 + timedelta(hours=1))]
    got = {(r["user_id"], r["session_no"]): (r["started"], r["ended"], r["n"]) for r in idle_sessions(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), 3600, piece).collect()}
    want = {}
    for user in (1, 2, 3):
        no, last = 0, None
        for at in sorted(t for _, u, t in rows if u == user):
            no += last is not None and (at - last).total_seconds() >= 3600
            first, _, n = want.get((user, no), (at, at, 0))
            want[user, no], last = (first, at, n + 1), at
    assert got == want and len(want) > 10
