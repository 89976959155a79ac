"""A vector index: cells of a trained coarse partitioning, vectors laid out by cell, and probes that read few files.

Cells are those of k-means on the unit sphere, trained by Lloyd steps that are Spark aggregations over a bounded sample;
every vector is then laid out in the folder of its nearest centre. A probe is a filter on that folder's column, so files of
other cells aren't opened. A cell also keeps the largest angle between its centre and a vector, which bounds what any vector
in it can score: so a search can be exact and still leave cells out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import nearest
from tessera.storage import stored

#: Cells at most, and vectors of the training sample for each cell: the centres are fitted on a bounded sample.
MOST_CELLS, SAMPLE_PER_CELL, STEPS = 4096, 256, 8
#: Rows of one file at most; a cell with a large share of all rows has several files.
FILE_ROWS = 1 << 18
#: What rounding may take from a bound.
SLACK = 1e-7


def _rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (key, v) of the vectors that have a length."""
    v = F.col(vector).cast("array<double>")
    return vectors.select(F.col(key).alias("key"), v.alias("v")).filter((F.size("v") > 0) & F.exists("v", lambda x: x != 0))


def assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """`rows` (key, v) with the number of the nearest centre and the angle to it; ties go to the smaller number."""
    kind = rows.schema["key"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        step = max(1, nearest.PRODUCTS // len(centres))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                score = np.round(nearest.unit(nearest.matrix(batch.column("v"), centres.shape[1])) @ centres.T, 12)
                cell = score.argmax(1)
                angle = np.arccos(np.clip(score[np.arange(len(cell)), cell] - 1e-12, -1, 1))  # not less than it is
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["key", "v", "cell", "angle"])

    return rows.mapInArrow(run, f"key {kind}, v array<double>, cell int, angle double")


def train(rows: DataFrame, n_cells: int, n_rows: int, steps: int = STEPS) -> np.ndarray:
    """Centres (unit vectors) of `n_cells` cells at most, by k-means over a sample of about SAMPLE_PER_CELL vectors a cell.

    The sample and the first centres are picked by a hash of the key, so the same vectors give the same index. A step is one
    aggregation of means by cell; only centres come to the driver. A cell that no vector is nearest to keeps its centre.
    """
    draw = F.xxhash64("key", F.lit("cells"))
    share = min(1.0, 1.2 * SAMPLE_PER_CELL * n_cells / max(1, n_rows))
    sample = rows if share >= 1 else rows.filter(F.pmod(draw, F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = stored(sample)
    first = sample.orderBy(draw, "key").limit(n_cells).toArrow()["v"].to_pylist()
    if not first:
        return np.zeros((0, 0))
    centres = np.unique(nearest.unit(np.array(first)), axis=0)
    for _ in range(steps):
        mean = Summarizer.mean(array_to_vector(F.transform("v", lambda x: x / F.col("size"))))
        sized = assign(sample, centres).withColumn("size", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
        means = sized.groupBy("cell").agg(vector_to_array(mean).alias("m")).toArrow()
        moved = centres.copy()
        moved[means["cell"].to_numpy()] = np.array(means["m"].to_pylist())
        moved = nearest.unit(moved)
        moved[~moved.any(1)] = centres[~moved.any(1)]
        if np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    return centres


@dataclass
class VectorIndex:
    """Vectors by cell under `path`; `centres` and each cell's largest angle and rows, which are on the driver."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    angles: np.ndarray
    counts: np.ndarray
    files: list[DataFrame] = field(default_factory=list)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", n_cells: int | None = None, steps: int = STEPS) -> VectorIndex:
        """Train cells and write all `vectors` by cell; null, empty and zero vectors have no neighbours and aren't written.

        There are about the square root of the number of vectors of cells, at most MOST_CELLS.
        """
        rows = _rows(vectors, key, vector)
        n = rows.count()
        centres = train(rows, min(MOST_CELLS, n_cells or max(1, round(n**0.5))), n, steps)
        out = cls(vectors.sparkSession, path, centres, np.zeros(len(centres)), np.zeros(len(centres), np.int64))
        if not len(centres):
            rows.withColumns({"angle": F.lit(0.0), "cell": F.lit(0)}).limit(0).write.parquet(f"{path}/vectors")
        else:
            out._write(rows, 0)
            return out
        out._save(0)
        return out

    def _write(self, rows: DataFrame, version: int) -> None:
        placed = stored(assign(rows, self.centres))
        told = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).toArrow()
        cell = told["cell"].to_numpy()
        self.counts[cell] += told["n"].to_numpy()
        self.angles[cell] = np.maximum(self.angles[cell], told["angle"].to_numpy())
        self._save(version)  # before the vectors: should their write fail, the bounds are only wider than need be
        # By ranges of (cell, hash): a large cell is dealt to several tasks, and a task writes few cells.
        dealt = placed.repartitionByRange("cell", F.xxhash64("key")).sortWithinPartitions("cell")
        dealt.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(f"{self.path}/vectors")

    def _save(self, version: int) -> None:
        """Cells as a small table of this version; the latest one counts."""
        held = [(version, i, c.tolist(), float(a), int(n)) for i, (c, a, n) in enumerate(zip(self.centres, self.angles, self.counts, strict=True))]
        cells = self.spark.createDataFrame(held or [(version, -1, [], 0.0, 0)], "version int, cell int, centre array<double>, angle double, n long")
        cells.coalesce(1).write.mode("append").parquet(f"{self.path}/cells")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        cells = spark.read.parquet(f"{path}/cells")
        held = cells.join(cells.agg(F.max("version").alias("version")), "version").filter("cell >= 0").orderBy("cell").toArrow()
        centres = np.array(held["centre"].to_pylist()) if held.num_rows else np.zeros((0, 0))
        return cls(spark, path, centres, held["angle"].to_numpy().copy(), held["n"].to_numpy().copy())

    def append(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        """Write more vectors into the cells that there are."""
        if not len(self.centres):
            raise ValueError("the index has no cells; build it from some vectors")
        last = self.spark.read.parquet(f"{self.path}/cells").agg(F.max("version")).first()[0]
        self._write(_rows(vectors, key, vector), last + 1)

    def table(self, cells: np.ndarray | None = None) -> DataFrame:
        """Rows (key, v, angle, cell), of some cells alone where they are given: then other cells' files aren't read."""
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        return rows if cells is None else rows.filter(F.col("cell").isin([int(c) for c in cells]))

    def order(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells by how near they are to each query, and what a vector in each cell may score at most."""
        score = nearest.unit(queries) @ self.centres.T
        angle = np.arccos(np.clip(score, -1, 1))
        bound = np.cos(np.maximum(0, angle - self.angles))
        return np.argsort(-np.where(self.counts > 0, score, -np.inf), axis=1, kind="stable"), np.where(self.counts > 0, bound, -np.inf)

    def _probe(self, names: list[str], queries: np.ndarray, k: int, probes: np.ndarray) -> DataFrame:
        rows = self.table(np.flatnonzero(probes.any(0)))
        self.files.append(rows)
        return nearest.best_in_tasks(rows.select("key", "v", "cell"), names, queries, k, probes)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """Cosine neighbours: query_id, key, score, rank. `queries` (query_id, vector) are a stated set, taken in blocks.

        With `probes`, each query reads the vectors of so many nearest cells. Without, the result is exact: after the
        nearest cells, those whose bound reaches the query's k-th score so far are read, and no others.
        """
        found = []
        for names, vectors in nearest.blocks(queries, vector):
            if not len(self.centres):
                break
            order, bound = self.order(vectors)
            asked = np.zeros(order.shape, bool)
            np.put_along_axis(asked, order[:, : probes or max(1, round(order.shape[1] ** 0.5))], True, axis=1)
            asked &= self.counts > 0
            near = self._probe(names, vectors, k, asked)
            if probes is None:
                near = stored(near)
                least = nearest.ranked(near, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k).toArrow()
                at = dict(zip(least["query_id"].to_pylist(), least["least"].to_pylist(), strict=True))
                reach = np.array([at.get(n, -np.inf) for n in names])
                more = (bound >= reach[:, None] - SLACK) & ~asked & (self.counts > 0)
                if more.any():
                    near = near.unionByName(self._probe(names, vectors, k, more))
            found.append(near)
        kind = self.table().schema["key"].dataType.simpleString()
        out = reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], f"query_id string, key {kind}, score double, part int")
        return nearest.ranked(out, k).withColumnRenamed("key", key)

    def probes_for(self, queries: DataFrame, exact: DataFrame, recall: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> int:
        """How many nearest cells each of `queries` must read so that none finds less than `recall` of its `exact` neighbours.

        `exact` (query_id, key) are the true neighbours, such as an exact search gives; the queries are a stated set.
        """
        true = exact.select("query_id", F.col(key).alias("key")).join(self.table().select("key", "cell"), "key").select("query_id", "cell").toArrow()
        cells: dict[str, list[int]] = {}
        for q, c in zip(true["query_id"].to_pylist(), true["cell"].to_pylist(), strict=True):
            cells.setdefault(q, []).append(c)
        most = 1
        for names, vectors in nearest.blocks(queries, vector):
            order, _ = self.order(vectors)
            for name, row in zip(names, order, strict=True):
                if name in cells:
                    place = np.sort(np.argsort(row)[cells[name]])
                    most = max(most, int(place[int(np.ceil(recall * len(place))) - 1]) + 1)
        return most

    def files_read(self) -> tuple[int, int]:
        """Files that the searches so far have opened, and files of the index."""
        count = lambda rows: rows.select(F.input_file_name().alias("f")).distinct().count()
        read = reduce(DataFrame.unionByName, [r.select(F.input_file_name().alias("f")) for r in self.files]).distinct().count() if self.files else 0
        return read, count(self.table())
