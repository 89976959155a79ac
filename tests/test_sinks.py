"""The batched sink and deletion under injected failures: each row once, or none; all of a document gone, or it is ready."""

import os
import sys
import time
from datetime import datetime
from functools import partial

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.sources import batched, deletion


class Flaky(batched.FolderStore):
    """Fails as its config says: busy a number of times for each batch, once for a task, or always."""

    def __init__(self, path, **config):
        super().__init__(path)
        self.config = config

    def _once(self, name, times):
        """Whether this is one of the first times, counted by files, as each attempt is another process."""
        os.makedirs(f"{self.path}/count", exist_ok=True)
        seen = [f for f in os.listdir(f"{self.path}/count") if f.startswith(f"{name}.")]
        if len(seen) < times:
            open(f"{self.path}/count/{name}.{len(seen)}", "x").close()
            return True
        return False

    def insert(self, write, attempt, number, rows):
        part = attempt.partition("-")[0]
        if self._once(f"busy-{part}-{number}", self.config.get("busy", 0)):
            raise RuntimeError("Rate limit exceeded: try later")
        super().insert(write, attempt, number, rows)
        if number == 2 and self._once(f"kill-{part}", self.config.get("kill", 0)):
            os._exit(1)  # the task's worker dies with rows inserted
        if number == 1 and self.config.get("broken"):
            raise RuntimeError("disk full")
        if self.config.get("slow"):
            time.sleep(self.config["slow"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests
FAST = {"firstWait": 0.01, "longestWait": 0.02}


def put(df, path, **config):
    batched.insert_rows(df, partial(Flaky, str(path), **config), **FAST)


def ids(spark, path):
    return sorted(r["id"] for r in batched.read_store(spark, str(path), "id long, text string, v array<double>").collect())


def rows(spark, n, first=0):
    return spark.range(first, first + n).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.array(F.lit(0.5)).alias("v")).repartition(3)


def test_batches_and_appends(spark, tmp_path):
    put(rows(spark, 100), tmp_path)
    put(rows(spark, 50, 100), tmp_path)
    assert ids(spark, tmp_path) == list(range(150))
    files = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "rows") for f in names]
    import pyarrow.parquet as pq

    assert all(pq.read_metadata(f).num_rows <= batched.BATCH for f in files)
    got = batched.read_store(spark, str(tmp_path), "id long, text string, v array<double>").filter("id = 7").first()
    assert got.asDict() == {"id": 7, "text": "t7", "v": [0.5]}
    put(rows(spark, 0), tmp_path)
    assert len(ids(spark, tmp_path)) == 150


def test_busy_stores_are_waited_for(spark, tmp_path):
    put(rows(spark, 90), tmp_path, busy=2)
    assert ids(spark, tmp_path) == list(range(90))
    with pytest.raises(Exception, match="limit exceeded"):
        batched.insert_rows(rows(spark, 9, 500), partial(Flaky, str(tmp_path / "b"), busy=9), retries=2, **FAST)
    assert ids(spark, tmp_path / "b") == []


def test_failed_jobs_leave_nothing(spark, tmp_path):
    put(rows(spark, 10), tmp_path)
    with pytest.raises(Exception, match="disk full"):
        put(rows(spark, 90, 100), tmp_path, broken=True)
    assert ids(spark, tmp_path) == list(range(10))
    assert len(os.listdir(tmp_path / "rows")) == 2 and len(os.listdir(tmp_path / "published")) == 1


def test_waits():
    assert batched.waits()[:5] == [0.5, 1.0, 2.0, 4.0, 5.0] and len(batched.waits()) == 6
    slept, tries = [], []

    def insert():
        tries.append(1)
        raise RuntimeError("Please slowdown and retry later" if len(tries) < 3 else "no such table")

    with pytest.raises(RuntimeError, match="no such table"):
        batched.insert_with_retry(insert, [1, 2, 3, 4], slept.append)
    assert slept == [1, 2]


def test_attempts_that_do_not_count_are_discarded(tmp_path):
    """A killed and a speculative attempt have inserted rows, too; only the attempts that the driver heard of are shown."""
    store = batched.FolderStore(str(tmp_path))
    for attempt in ("0-1", "0-5", "1-2"):
        store.insert("w", attempt, 0, [{"id": int(attempt[0])}])
        store.insert("w", attempt, 0, [{"id": int(attempt[0])}])  # a retry of the same batch replaces it
    assert store.folders() == []
    writer = batched.BatchedWriter({"store": batched.packed(partial(batched.FolderStore, str(tmp_path)))})
    writer.write_id = "w"
    writer.commit([batched.Attempt("0-5", 1), batched.Attempt("1-2", 1), batched.Attempt("2-9", 0), None])
    writer.commit([batched.Attempt("0-5", 1), batched.Attempt("1-2", 1)])
    assert [f.rpartition("/")[2] for f in store.folders()] == ["0-5", "1-2"]
    assert sorted(os.listdir(tmp_path / "rows" / "w")) == ["0-5", "1-2"]


def test_a_killed_task_leaves_each_row_once(tmp_path):
    """In a session of its own whose tasks may fail, as on a cluster: the worker of each partition dies once."""
    import subprocess
    import sys

    here = os.path.dirname(os.path.abspath(__file__))
    code = f"""
import sys; sys.path[:0] = [{here!r}, {os.path.dirname(here)!r}]
from pyspark.sql import SparkSession
from test_sinks import put, rows, ids
spark = SparkSession.builder.master('local[2,4]').config('spark.ui.enabled', 'false').getOrCreate()
put(rows(spark, 200), {str(tmp_path)!r}, kill=1)
assert ids(spark, {str(tmp_path)!r}) == list(range(200))
print('each once')
"""
    env = os.environ | {"PYTHONPATH": os.pathsep.join([here, os.path.dirname(here)])}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "each once" in out.stdout, out.stderr[-2000:]
    assert len([f for f in os.listdir(tmp_path / "count") if f.startswith("kill")]) >= 1
    assert all(len(os.listdir(tmp_path / "rows" / w)) <= 3 for w in os.listdir(tmp_path / "rows"))


# Deletion

DOCS = "document_id string, status string, error_message string, stored_path string"
AT = datetime(2024, 5, 1)


class World:
    """Chunks and files that steps remove, and the step that fails."""

    def __init__(self, spark, tmp_path, fail=None, partly=False):
        self.docs = spark.createDataFrame([(f"d{i}", "processing" if i == 4 else "ready", None, f"/f/d{i}") for i in range(5)], DOCS)
        self.chunks, self.files, self.fail, self.partly = {f"d{i}": 3 for i in range(5)}, {f"/f/d{i}" for i in range(5)}, fail, partly
        self.job = deletion.Deletion(f"{tmp_path}/journal", self.remove_chunks, self.remove_files)

    def remove_chunks(self, due):
        for r in due.collect():
            self.chunks.pop(r["document_id"], None)
            if self.fail == "chunks" and self.partly:
                raise RuntimeError("store is down")
        if self.fail == "chunks":
            raise RuntimeError("store is down")

    def remove_files(self, due):
        if self.fail == "file":
            raise RuntimeError("disk is gone")
        self.files -= {r["path"] for r in due.collect()}

    def ask(self, spark, *names):
        self.job.request(self.docs, spark.createDataFrame([(n,) for n in names], "document_id string"), AT)

    def state(self):
        return {r["document_id"]: (r["status"], r["error_message"]) for r in self.job.table(self.docs).collect()}


def test_documents_go_in_phases(spark, tmp_path):
    world = World(spark, tmp_path)
    world.ask(spark, "d1", "d2", "d4", "nobody", "d1")
    assert world.state() == {"d0": ("ready", None), "d1": ("deleting", None), "d2": ("deleting", None), "d3": ("ready", None), "d4": ("processing", None)}
    assert world.job.run(world.docs, AT) and world.job.run(world.docs, AT)  # a second run finds nothing to do
    assert set(world.state()) == {"d0", "d3", "d4"} and set(world.chunks) == {"d0", "d3", "d4"} and "/f/d1" not in world.files
    told = deletion.history(world.job.entries(world.docs)).filter("document_id = 'd1'").orderBy("n").collect()
    assert [r["phase"] for r in told] == list(deletion.PHASES)


@pytest.mark.parametrize("fail, partly, message", [("chunks", False, "删除失败: store is down"), ("chunks", True, "删除失败: store is down"), ("file", False, "删除失败: disk is gone")])
def test_a_failed_phase_restores(spark, tmp_path, fail, partly, message):
    world = World(spark, tmp_path, fail, partly)
    world.ask(spark, "d1", "d2")
    assert not world.job.run(world.docs, AT)
    assert world.state()["d1"] == ("ready", message) == world.state()["d2"]
    assert world.job.run(world.docs, AT)  # nothing is left to do, the documents are ready
    world.fail = None
    world.ask(spark, "d1")
    assert world.state()["d1"] == ("deleting", None)
    assert world.job.run(world.docs, AT)
    assert set(world.state()) == {"d0", "d2", "d3", "d4"} and world.state()["d2"] == ("ready", message)


def test_another_job_takes_up_where_one_ended(spark, tmp_path):
    world = World(spark, tmp_path)
    world.ask(spark, "d0", "d3")
    world.job._append(world.docs, spark.createDataFrame([("d0",)], "document_id string"), "chunks", AT)  # as far as the first job came
    world.ask(spark, "d0")  # asked for again meanwhile: already on its way
    assert deletion.Deletion(f"{tmp_path}/journal", world.remove_chunks, world.remove_files).run(world.docs, AT)
    assert set(world.state()) == {"d1", "d2", "d4"}
    assert "d0" in world.chunks and "d3" not in world.chunks  # d0's chunks were not removed a second time
