"""A sink for stores that take rows in small batches: a Python data source with retries, commit and abort.

Tasks insert their rows, a batch at a time, under the name of their own attempt; a store shows none of them. When all tasks
are done the driver publishes the attempts that count in one step, and what other attempts left is discarded. So a failed
batch, a killed task or a second, speculative attempt leaves each row once, and a failed job leaves none.
"""

from __future__ import annotations

import base64
import json
import pickle
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Rows of a batch, retries, the first and the longest wait in seconds, and what stores say when they are busy.
BATCH, RETRIES, FIRST_WAIT, LONGEST_WAIT = 16, 6, 0.5, 5.0
BUSY = ("rate limit exceeded", "reach the limit of request", "please slowdown and retry later")


class Store(Protocol):
    """What a store has to do. `write` names a job's write, `attempt` one task's attempt in it."""

    def insert(self, write: str, attempt: str, number: int, rows: list[dict]) -> None:
        """Keep a batch, unseen, under its number; the same number again replaces it."""

    def publish(self, write: str, attempts: list[str]) -> None:
        """Show the rows of these attempts, all at once; again is the same as once."""

    def discard(self, write: str, keep: list[str]) -> None:
        """Forget what attempts of this write other than `keep` have inserted."""


def is_busy(error: Exception) -> bool:
    return any(mark in str(error).lower() for mark in BUSY)


def waits(retries: int = RETRIES, first: float = FIRST_WAIT, longest: float = LONGEST_WAIT) -> list[float]:
    """Seconds before each retry: doubled from the first, up to the longest."""
    return [min(first * 2**n, longest) for n in range(retries)]


def insert_with_retry(insert: Callable[[], None], pauses: list[float], sleep: Callable[[float], None] = time.sleep) -> None:
    """Insert, and again after each pause while the store says that it is busy. Other errors, and the last one, are raised."""
    for pause in [*pauses, None]:
        try:
            return insert()
        except Exception as error:
            if pause is None or not is_busy(error):
                raise
        sleep(pause)


@dataclass
class Attempt(WriterCommitMessage):
    name: str
    rows: int


class BatchedWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.options, self.write_id = options, uuid.uuid4().hex

    def _store(self) -> Store:
        return pickle.loads(base64.b64decode(self.options["store"]))()

    def write(self, iterator: Iterator) -> Attempt:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, attempt = self._store(), f"{task.partitionId()}-{task.taskAttemptId()}"
        pauses = waits(int(self.options.get("retries", RETRIES)), float(self.options.get("firstwait", FIRST_WAIT)), float(self.options.get("longestwait", LONGEST_WAIT)))
        size, held, number, rows = int(self.options.get("batch", BATCH)), [], 0, 0

        def send() -> None:
            insert_with_retry(lambda: store.insert(self.write_id, attempt, number, held), pauses)

        for row in iterator:
            held.append(row.asDict(recursive=True))
            rows += 1
            if len(held) == size:
                send()
                held, number = [], number + 1
        if held:
            send()
        return Attempt(attempt, rows)

    def commit(self, messages: list) -> None:
        done = [m.name for m in messages if m is not None and m.rows]
        store = self._store()
        store.publish(self.write_id, done)
        store.discard(self.write_id, done)

    def abort(self, messages: list) -> None:
        self._store().discard(self.write_id, [])


class BatchedSource(DataSource):
    """Format `batched`; options: store (see `insert_rows`), batch, retries, firstWait, longestWait."""

    @classmethod
    def name(cls) -> str:
        return "batched"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("the sink appends only")
        return BatchedWriter({k.lower(): v for k, v in dict(self.options).items()})


def packed(make: Callable[[], Store]) -> str:
    """A function that makes the store's client, as an option; it is called once on the driver and in each task."""
    return base64.b64encode(cloudpickle.dumps(make)).decode()


def insert_rows(rows: DataFrame, make: Callable[[], Store], **options) -> None:
    """Append rows to a store in batches."""
    rows.sparkSession.dataSource.register(BatchedSource)
    rows.write.format("batched").mode("append").options(store=packed(make), **options).save()


class FolderStore:
    """A store of Parquet files under a folder that all machines share; a published write is a list of its attempts.

    `path` is a plain path or any address that pyarrow's file systems know.
    """

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def insert(self, write: str, attempt: str, number: int, rows: list[dict]) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        at = f"{self.path}/rows/{write}/{attempt}"
        self.files.create_dir(at)
        with self.files.open_output_stream(f"{at}/{number:09}.parquet") as out:
            pq.write_table(pa.Table.from_pylist(rows), out)

    def publish(self, write: str, attempts: list[str]) -> None:
        self.files.create_dir(f"{self.path}/published")
        with self.files.open_output_stream(f"{self.path}/published/{write}.tmp") as out:
            out.write(json.dumps(attempts).encode())
        self.files.move(f"{self.path}/published/{write}.tmp", f"{self.path}/published/{write}.json")

    def discard(self, write: str, keep: list[str]) -> None:
        from pyarrow import fs

        for info in self.files.get_file_info(fs.FileSelector(f"{self.path}/rows/{write}", allow_not_found=True)):
            if info.base_name not in keep:
                self.files.delete_dir(info.path)

    def folders(self) -> list[str]:
        """Folders of published rows."""
        from pyarrow import fs

        out = []
        for info in self.files.get_file_info(fs.FileSelector(f"{self.path}/published", allow_not_found=True)):
            if info.base_name.endswith(".json"):
                with self.files.open_input_stream(info.path) as held:
                    out += [f"{self.path}/rows/{info.base_name[:-5]}/{a}" for a in json.loads(held.read())]
        return sorted(out)


def read_store(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The published rows of a `FolderStore`."""
    store = FolderStore(path)
    scheme = path.partition(":")[0] + ":" if ":" in path.partition("/")[0] else ""
    folders = [f"{scheme}{f}" if scheme == "file:" else f for f in store.folders()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
