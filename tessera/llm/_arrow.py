"""Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches of at most about so many bytes leave room for texts of any length: their buffers live in the JVM and in Python.
BATCH_BYTES, _SETTING, _DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Texts are handed to the Python code in slices of about this many UTF-8 bytes, and of at most so many rows.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 14


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches to BATCH_BYTES, unless it has a setting of its own.

    The setting belongs to the session, so whoever owns it calls this (queries and pipeline do); operators don't.
    """
    if spark.conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        spark.conf.set(_SETTING, BATCH_BYTES)
    return spark


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `most` bytes of text and at most SLICE_ROWS rows, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64")
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > most or i - start == SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def taken(df: DataFrame, key: str, text: str, carry: bool = False) -> tuple[DataFrame, str, str, int | None]:
    """The columns an operator reads: key and text or, if rows are carried along, key and the whole row as one struct.

    Whatever other columns are called, they can't clash with those. Also returns the key's type, the schema of the
    carried column and the place of the text in it: a carried text isn't sent twice.
    """
    out = df.select(F.col(key).alias("key"), F.struct("*").alias("row") if carry else F.col(text).alias("text"))
    kind = out.schema["key"].dataType.simpleString()
    return (out, kind, f", row {out.schema['row'].dataType.simpleString()}", df.columns.index(text)) if carry else (out, kind, "", None)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together as long as they have `most` bytes at most."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def map_slices(
    df: DataFrame,
    work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str,
    text: str = "text",
    most: int = SLICE_BYTES,
    inner: int | None = None,
    gather: int = 0,
) -> DataFrame:
    """Apply a per-slice function over `df` on the executors.

    `work()` runs once per task and returns the function, so that models and caches are set up once. Rows stay
    where the scan put them: there is no shuffle, and a lost executor costs only its own partitions. With `inner` the
    text is that field of the last column, and the function sees it as the second column. With `gather` batches are put
    together up to so many bytes before they are cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in gathered(batches, gather) if gather else batches:
            if inner is not None:
                first, *rest = batch.columns
                batch = pa.RecordBatch.from_arrays([first, rest[-1].field(inner), *rest], names=["key", "text", *batch.schema.names[1:]])
            for part in slices(batch, text, most):
                out = step(part)
                if out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
