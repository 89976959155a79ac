"""The stream of memory records ends where the batch operators do, however its rows are cut, also after a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import memory as M
from tessera.schemas import MEMORY_RECORDS
from tessera.streaming import memory as S

T0 = datetime(2024, 1, 1)


def some_records(spark, rng, n):
    rows = []
    for i in range(n):
        at = T0 - timedelta(days=rng.randint(0, 400), microseconds=rng.randint(0, 10**6))
        kind = rng.choice(["profile", "event"])
        rows.append((
            f"m{i}", f"u{i % 5}", kind, rng.choice(["profile.name", "profile.city", "k3"]), rng.choice(["Ann  B", "x y", "z"]), None, None, float(rng.randint(0, 100)), 0.0, 0.65,
            rng.randint(0, 4), rng.choice([None, at + timedelta(days=3)]), rng.choice([None, at + timedelta(days=90)]), rng.choice(["active", "active", "superseded"]), rng.randint(1, 3), None, at, at,
        ))
    return spark.createDataFrame(rows, MEMORY_RECORDS)


def some_candidates(spark, rng, n):
    rows = [
        (rng.choice(["u0", "u1", "u2", "u9", "", None]), rng.choice(["profile.name", " Profile.City ", "bad key", "k3"]), rng.choice(["Ann B", " x   y ", "new", "", None]),
         rng.choice(["upsert", "DELETE", None, "upsert"]), rng.choice([None, 0.5, 3.0]), rng.choice([None, 10.0, 500.0]), "c", "s", i)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "user_id string, memory_key string, value string, action string, confidence double, importance double, conversation_id string, session_id string, position long")


def written(changes, path, files):
    """The changes dealt at random into files, each of which is a micro-batch."""
    changes.repartition(files, F.rand(7)).write.mode("append").parquet(path)


def streamed(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def shown(df):
    return sorted((str(tuple(r)) for r in df.select(*MEMORY_RECORDS.names).collect()))


def test_stream_ends_as_the_batches_do(spark, tmp_path):
    rng = random.Random(3)
    records, path, base = some_records(spark, rng, 60), f"{tmp_path}/in", f"{tmp_path}/base"
    batches = [(T0 + timedelta(days=d), some_candidates(spark, rng, 30)) for d in (1, 2, 3)]
    want = records
    for at, given in batches:
        want = M.upsert_profiles(want, given, at)
    changes = S.record_changes(records, T0)
    for at, given in batches:
        changes = changes.unionByName(S.candidate_changes(given, at))
    written(changes, path, 3)
    # A first run sees nothing pass: the watermark stays behind.
    before = S.run(streamed(spark, path), "10 days", base=base)
    assert before.filter("purged").count() == 0
    written(S.tick(spark, changes, T0 + timedelta(days=30)), path, 1)
    log = S.run(streamed(spark, path), "10 days", base=base)  # goes on from the checkpoint
    assert shown(S.end_state(log)) == shown(want)
    assert log.groupBy("user_id", "memory_key", "seq").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("every", [None, timedelta(days=10)])
def test_passes_end_and_purge_records(spark, tmp_path, every):
    rng = random.Random(5)
    records, path = some_records(spark, rng, 80), f"{tmp_path}/in"
    first, end = T0 + timedelta(days=2), T0 + timedelta(days=63)
    times = [first] if every is None else [first + n * every for n in range(100) if first + n * every <= end]
    want = records
    for at in times:
        want = M.maintain(want, at)
    changes = S.record_changes(records, T0)
    written(changes, path, 2)
    written(S.tick(spark, changes, end + timedelta(days=1)), path, 1)
    got = S.end_state(S.run(streamed(spark, path), "1 day", first, every))
    state = lambda df: sorted(tuple(r) for r in df.select("memory_id", "status").collect())
    assert state(got) == state(want) and 0 < len(state(want)) < 80


def test_passes_are_found_by_halving():
    record = S.Record("event", "a", "a", None, None, 60.0, 0.0, 0.65, 0, "active", 1, None, None, None, 0, 0)
    for first, every, after in ((0, 3_600_000_000, -1), (5, 7 * S._DAY, 10), (10**15, 1000, 0), (0, None, -1), (300 * S._DAY, None, 0)):
        keeper = S.Keeper(first, every)
        got = keeper._pass_time(record, after)
        times = [first] if not every else [first + n * every for n in range(max(0, (after - first) // every - 2), 3000)]
        assert got == next((t for t in times if t > after and record.over(t)), None)
    steady = S.Record("profile", "a", "a", None, None, 100.0, 0.0, 1.0, 10**9, "active", 1, None, None, None, 0, 0)
    assert S.Keeper(0, S._DAY)._pass_time(S.Record(**{**steady.__dict__, "base_importance_score": 1e9}), 0) is not None
    assert S.Keeper(None, None)._pass_time(record, 0) is None


def test_a_group_of_keys_is_few_calls_of_the_state_store():
    import json

    import pandas as pd

    class Store:
        calls, value = 0, None

        def _called(self, *_):
            self.calls += 1

        registerTimer = deleteTimer = _called

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def getCurrentWatermarkInMs(self):
            return self.watermark

        def getExpiryTimeInMs(self):
            return self.value[0]

    given = {"kind": "record", "at_micros": 0, "memory_type": "event", "content": "a", "told": "a", "base_importance_score": 50.0, "importance_score": 0.0, "confidence_score": 0.65,
             "access_count": 0, "status": "active", "version": 1, "expires_at": 5, "created_at": 0, "updated_at": 0}
    rows = [json.dumps(given | {"memory_id": f"m{i}", "user_id": f"u{i % 100}", "memory_key": "k"}) for i in range(1000)]
    store, keeper = Store(), S.Keeper(10, None)
    keeper.init(store)
    store.watermark = -1
    came = [json.loads(e) for f in keeper.handleInputRows((0,), [pd.DataFrame({"change": rows})], store) for e in f["entry"]]
    store.watermark = 1
    ended = [json.loads(e) for f in keeper.handleExpiredTimer((0,), store, store) for e in f["entry"]]
    assert {e["status"] for e in came} == {"active"} and {e["status"] for e in ended} == {"expired"}
    assert len(came) == len(ended) == len({(e["user_id"], e["seq"]) for e in came + ended}) / 2 == 1000
    assert store.calls <= 6


def test_a_group_keeps_what_can_still_change():
    """Without passes: active profiles and the last candidate of each time; the log has every record all the same."""
    import json

    import pandas as pd

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Timers:
        def registerTimer(self, at):
            pass

        def getCurrentWatermarkInMs(self):
            return 0

    def record(i, kind, status):
        return json.dumps({"at_micros": 1, "kind": "record", "memory_id": f"m{i}", "user_id": "u", "memory_key": "k", "memory_type": kind, "content": "x", "told": "x", "status": status, "version": 1})

    def candidate(at, position):
        return json.dumps({"at_micros": at, "kind": "candidate", "user_id": "u", "memory_key": "k", "position": position, "memory_id": f"c{position}", "content": "y", "base_importance_score": 1.0, "confidence_score": 0.5})

    given = [record(i, kind, status) for i, (kind, status) in enumerate([("event", "active"), ("profile", "superseded"), ("profile", "active")] * 50)]
    given += [candidate(9, p) for p in (3, 7, 5)] + [candidate(8, 1)] + [record(2, "profile", "deleted")]
    keeper = S.Keeper(None, None)
    keeper.handle, keeper.group = Timers(), Value()
    log = [json.loads(e) for frame in keeper.handleInputRows((0,), iter([pd.DataFrame({"change": given})]), Timers()) for e in frame["entry"]]
    assert [e["memory_id"] for e in log] == [f"m{i}" for i in range(150)] + ["m2"] and [e["seq"] for e in log] == list(range(1, 152)) and not any(e["purged"] for e in log)
    [[_, _, (_, _, due, records, waiting)]] = json.loads(keeper.group.held[1])
    assert {m for m, *_ in records} == {f"m{i}" for i in range(5, 150, 3)} and due == 8
    assert sorted((w[0], w[1]) for w in waiting) == [(8, 1), (9, 7)]
