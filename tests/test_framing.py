"""Events of chunked bodies against whole ones: cut at any byte, in any order, over several runs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.streaming import events as E
from tessera.streaming import framing


def whole(body):
    """Events of a body that is there at once, by lines."""
    out, event, said = [], "message", []
    for line in [*body.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"), ""]:
        if not line:
            if said:
                out.append((event, "\n".join(said)))
            event, said = "message", []
        elif line.startswith("event:"):
            event = line[6:].strip()
        elif line.startswith("data:"):
            said.append(line[5:].strip())
    return out if any(e == "done" for e, _ in out) else [*out, ("done", "{}")]


BODIES = [
    b"event: start\ndata: {}\n\nevent: message\ndata: {\"content\": \"\xe4\xbd\xa0\xe5\xa5\xbd\"}\n\nevent: done\ndata: {}\n\n",
    b"event: start\r\ndata: a\r\ndata: b\r\n\r\ndata: no name\r\n\r\n: comment\r\n\r\nevent: x\r\n\r\n",
    b"", b"data: tail without an end", b"\n\n\n\nevent:done\ndata:1\n\n", b"event: error\ndata: \xff\xfe broken\n\n",
]


@settings(deadline=None, max_examples=200)
@given(st.sampled_from(BODIES), st.lists(st.integers(0, 140), max_size=12))
def test_cuts_change_nothing(body, cuts):
    at = sorted({0, len(body), *(c for c in cuts if c < len(body))})
    framer, got = framing.Framer(), []
    for a, b in zip(at[:-1], at[1:], strict=True):
        got += framer.add(body[a:b])
        framer = framing.Framer(bytes(framer.tail), framer.done)  # as it is taken up in the next micro-batch
    assert [*got, *framer.end()] == whole(body)


def test_long_events_are_searched_once():
    framer, out = framing.Framer(), []
    for _ in range(200_000):
        out += framer.add(b"data: x" if not framer.tail else b"y")
    out += framer.add(b"\n\n")
    assert len(out) == 1 and len(out[0][1]) == 200_000


def test_streams_give_the_rows_of_the_uncut_log(spark, tmp_path):
    rng = random.Random(4)
    bodies = {f"r{i}": b for i, b in enumerate(BODIES)} | {"long": b"".join(b"data: {\"n\": %d}\n\n" % i for i in range(300)) + b"event: done\ndata: {}\n\n"}
    rows = []
    for name, body in bodies.items():
        at = sorted({0, len(body), *(rng.randrange(len(body) + 1) for _ in range(30))})
        pieces = [body[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] or [b""]
        rows += [(name, i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    rows += rng.sample(rows, 20)  # some come twice
    rng.shuffle(rows)
    path, base = f"{tmp_path}/in", f"{tmp_path}/base"
    kinds = "request_id string, number long, chunk binary, last boolean"
    write = lambda some: spark.createDataFrame(some, kinds).repartition(2).write.mode("append").parquet(path)
    stream = lambda: framing.reassemble(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(path))
    write(rows[: len(rows) // 2])
    first = E.run_stateful(stream(), base).count()
    write(rows[len(rows) // 2 :])
    got = {}
    for r in E.run_stateful(stream(), base).orderBy("request_id", "seq").collect():
        got.setdefault(r["request_id"], []).append((r["event"], r["data"]))
    assert got == {name: whole(body) for name, body in bodies.items()}
    assert first < sum(map(len, got.values()))
    states = {r["request_id"]: r["state"] for r in E.replies(E.run_stateful(stream(), base)).collect()}
    assert states["r0"] == "done" and states["r5"] == "error"


def test_bodies_that_stop(spark, tmp_path):
    path = f"{tmp_path}/in"
    rows = [("a", 0, b"event: start\ndata: 1\n\ndata: un", False, 10), ("b", 0, b"data: x\n\n", True, 11), ("a", 2, b"never reached", False, 12), ("tick", 0, b"", True, 5000)]
    held = spark.createDataFrame(rows, "request_id string, number long, chunk binary, last boolean, s long").withColumn("at", F.timestamp_seconds("s"))
    for ticks in (False, True):
        held.filter((F.col("request_id") == "tick") == ticks).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = E.run_stateful(framing.reassemble(stream, "10 seconds", 60_000)).orderBy("request_id", "seq").collect()
    assert [(r["request_id"], r["event"], r["data"]) for r in got if r["request_id"] != "tick"] == [
        ("a", "start", "1"), ("a", "message", "un"), ("a", "done", "{}"), ("b", "message", "x"), ("b", "done", "{}"),
    ]
    with pytest.raises(ValueError):
        framing.reassemble(stream, "10 seconds")


def test_a_group_of_bodies_is_few_calls_of_the_state_store():
    import pandas as pd

    class Store(dict):
        calls, value = 0, None

        def getValueState(self, *_):
            return self

        getMapState = getValueState

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def getValue(self, key):
            self.calls += 1
            return self[key]

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def removeKey(self, key):
            self.calls += 1
            del self[key]

    body = b"event: message\ndata: \xe4\xbd\xa0\n\n" * 20
    rows = [(f"r{i}", n, body[n * 12 : n * 12 + 12], n * 12 + 12 >= len(body)) for i in range(50) for n in range(-(-len(body) // 12))]
    random.Random(6).shuffle(rows)
    store, got = Store(), {}
    for part in (rows[0::3], rows[1::3], rows[2::3]):
        machine = framing.Reassemble()
        machine.init(store)
        for frame in machine.handleInputRows((0,), [pd.DataFrame(part, columns=["request_id", "number", "chunk", "last"])], None):
            for request, seq, event, data in frame.itertuples(index=False):
                got.setdefault(request, []).append((seq, event, data))
    assert got == {f"r{i}": [(n, *e) for n, e in enumerate(whole(body))] for i in range(50)}
    assert store.calls <= 12 and not store
