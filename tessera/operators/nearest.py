"""Best k by cosine in every task: what exact search and the vector index share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors are sent in blocks of at most this many and multiplied in turns of QUERY_TURN, with so many products held at a time.
QUERY_BLOCK, QUERY_TURN, PRODUCTS = 4096, 512, 1 << 19
#: Tasks whose best rows meet first, before the best of all such groups do.
TASKS = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dim:
        raise ValueError(f"a vector doesn't have {dim} entries, as the others do")
    return flat.reshape(len(column), dim)


def blocks(queries: DataFrame, vector: str) -> Iterator[tuple[list[str], np.ndarray]]:
    """Query ids and vectors, a stated set, in blocks of bounded size; null and empty vectors are left out."""
    asked = queries.select(F.col("query_id").cast("string"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    held = []
    for r in asked.toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            yield [h[0] for h in held], np.array([h[1] for h in held])
            held = []
    if held:
        yield [h[0] for h in held], np.array([h[1] for h in held])


def _cut(held: pa.Table, k: int) -> pa.Table:
    """The k best rows (query, key, score) of each query, in order."""
    held = held.take(pc.sort_indices(held, sort_keys=[("query", "ascending"), ("score", "descending"), ("key", "ascending")]))
    q = held["query"].to_numpy()
    at = np.arange(len(q))
    first = np.maximum.accumulate(np.where(np.append(True, q[1:] != q[:-1])[: len(q)], at, 0))
    return held.filter(pa.array(at - first < k))


def best_in_tasks(rows: DataFrame, names: list[str], vectors: np.ndarray, k: int, probes: np.ndarray | None = None) -> DataFrame:
    """Rows (query_id, key, score, part): each task's k best rows of `rows` (key, v) for each query, however many batches it has.

    Scores are compared at nine digits, ties go by key; zero vectors have no neighbours. With `probes` (queries by cells,
    bool) `rows` has the column `cell` too, and a query sees the rows of its cells alone. `part` numbers groups of tasks.
    """
    kind = rows.schema["key"].dataType.simpleString()
    live = np.linalg.norm(vectors, axis=1) > 0
    shared = rows.sparkSession.sparkContext.broadcast((names, unit(vectors), live, probes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names, q, live, probes = shared.value
        turn = min(QUERY_TURN, len(names))
        step, held, count, base = max(1, PRODUCTS // turn), [], 0, 0
        floor = np.full(len(names), np.finfo(np.float64).min)  # what a query's k-th best so far scores
        for whole in batches:
            for a, b in product(range(0, whole.num_rows, step), range(0, len(names), turn)):
                batch, asked = whole.slice(a, step), slice(b, b + turn)
                if b == 0:
                    raw = matrix(batch.column("v"), q.shape[1])
                    others, some = unit(raw).T, raw.any(1)
                score = q[asked] @ others
                np.round(score, 9, out=score)
                keep = (score >= floor[asked, None]) & some & live[asked, None]
                if probes is not None:
                    keep &= probes[asked, batch.column("cell").to_numpy()]
                many = np.flatnonzero(np.count_nonzero(keep, axis=1) > k)
                if len(many):  # whoever equals the k-th stays, so that keys decide
                    high = np.where(keep[many], score[many], -np.inf)
                    high.partition(high.shape[1] - k, axis=1)
                    keep[many] &= score[many] >= high[:, -k, None]
                query, row = np.nonzero(keep)
                if len(query):
                    found = pa.table([pa.array((query + b).astype(np.int32)), batch.column("key").take(pa.array(row)), pa.array(score[query, row])], names=["query", "key", "score"])
                    held.append(found)
                    count += found.num_rows
                if count > max(2 * base, 1 << 16):
                    held = [_cut(pa.concat_tables(held), k)]
                    count = base = held[0].num_rows
                    n = np.bincount(held[0]["query"].to_numpy(), minlength=len(names))
                    floor[n == k] = held[0]["score"].to_numpy()[np.cumsum(n)[n == k] - 1]
        if held:
            best = _cut(pa.concat_tables(held), k).combine_chunks()
            part = pa.array(np.full(best.num_rows, TaskContext.get().partitionId() // TASKS, np.int32))
            ids = pa.array(names, pa.string()).take(best["query"].combine_chunks())
            yield pa.RecordBatch.from_arrays([ids, best["key"].combine_chunks(), best["score"].combine_chunks(), part], names=["query_id", "key", "score", "part"])

    return rows.mapInArrow(run, f"query_id string, key {kind}, score double, part int")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query out of those of the tasks: query_id, key, score, rank."""
    best = [F.desc("score"), F.col("key")]
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*best))).filter(F.col("rank") <= k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return near.drop("part", "rank").withColumn("rank", place).filter(F.col("rank") <= k)
