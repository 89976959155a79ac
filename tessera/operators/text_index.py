"""An index for contains: postings of byte trigrams by part of the data; what they let through is verified by contains.

Chunks are laid out in parts, folders of about PART_BYTES of text, in the order of document and chunk. A posting says that a
part has a trigram of UTF-8 bytes in its contents or in its source names. A term can only occur in parts that have all its
trigrams in one of the two, so other parts' files aren't read; the rows of those that are left are tested as ever. Terms of
under three bytes have no trigram: their queries read everything.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import recall

#: Bytes of text that a part stands for.
PART_BYTES = 16 << 20
#: Parts that are written into a plan as a filter at most; more are joined with.
MOST_PARTS = 10_000
FIELDS = ("content", "source_name")
_GRAMS = 1 << 24


def grams(text: bytes) -> np.ndarray:
    """The byte trigrams of a text as numbers, not yet distinct."""
    b = np.frombuffer(text, np.uint8).astype(np.int32)
    return (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, np.int32)


def _postings(chunks: DataFrame) -> DataFrame:
    """Rows (gram, part, field), each once a task and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, [np.zeros(_GRAMS, bool) for _ in FIELDS]

        def found() -> Iterator[pa.RecordBatch]:
            for n, held in enumerate(seen):
                at = np.flatnonzero(held)
                held[at] = False
                for a in range(0, len(at), 1 << 16):
                    some = pa.array(at[a : a + (1 << 16)].astype(np.int32))
                    same = [pa.array(np.full(len(some), v, np.int32)) for v in (now, n)]
                    yield pa.RecordBatch.from_arrays([some, *same], names=["gram", "part", "field"])

        for batch in batches:
            for part, *texts in zip(batch.column("part").to_pylist(), *(batch.column(c) for c in FIELDS), strict=True):
                if part != now:
                    if now is not None:
                        yield from found()
                    now = part
                for held, text in zip(seen, texts, strict=True):
                    if text.is_valid:
                        held[grams(text.as_buffer().to_pybytes())] = True
        if now is not None:
            yield from found()

    return chunks.select("part", *FIELDS).mapInArrow(run, "gram int, part int, field int")


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    read: list[DataFrame] = field(default_factory=list)

    @classmethod
    def build(cls, chunks: DataFrame, path: str, part_bytes: int = PART_BYTES) -> TextIndex:
        """Lay `chunks` (document_id, chunk_index, source_name, content, and more) out by parts under `path`, and their postings."""
        total = chunks.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        dealt = chunks.repartitionByRange(max(1, -(-total // part_bytes)), "document_id", "chunk_index").withColumn("part", F.spark_partition_id())
        dealt.write.partitionBy("part").parquet(f"{path}/chunks")
        out = cls(chunks.sparkSession, path)
        told = _postings(out.table()).withColumn("first", F.shiftright("gram", 16))
        # Files of the same first byte, sorted, so that a lookup opens few of them and few of their row groups.
        told.repartitionByRange("first", "gram", "part").dropDuplicates(["gram", "part", "field"]).sortWithinPartitions("gram").write.partitionBy("first").parquet(f"{path}/postings")
        return out

    def table(self, parts: Sequence[int] | None = None) -> DataFrame:
        """The chunks with their part; of some parts alone where they are given."""
        rows = self.spark.read.parquet(f"{self.path}/chunks")
        return rows if parts is None else rows.filter(F.col("part").isin(list(parts)))

    def parts_with(self, terms: Sequence[str]) -> DataFrame:
        """Rows (term, part): the parts that may have a term, each of three bytes or more."""
        own = {t: np.unique(grams(t.encode())).tolist() for t in terms}
        wanted = [(t, g, len(every)) for t, every in own.items() for g in every]
        asked = self.spark.createDataFrame(wanted, "term string, gram int, need int")
        firsts = sorted({g >> 16 for _, g, _ in wanted})
        held = self.spark.read.schema("gram int, part int, field int, first int").parquet(f"{self.path}/postings").filter(F.col("first").isin(firsts))
        found = held.join(F.broadcast(asked), "gram").groupBy("term", "field", "part", "need").count().filter(F.col("count") == F.col("need"))
        return found.select("term", "part").distinct()

    def candidates(self, terms: dict[str, Sequence[str]], limit: int) -> DataFrame:
        """The same rows as `recall.candidates` over all chunks, which reads only the parts that may have a term."""
        short = {q: t for q, t in terms.items() if any(len(x.encode()) < 3 for x in t)}
        long = {q: t for q, t in terms.items() if t and q not in short}
        found = []
        if long:
            parts = self.parts_with([t for every in long.values() for t in every]).select("part").distinct()
            few = [r["part"] for r in parts.limit(MOST_PARTS + 1).collect()]
            rows = self.table(sorted(few)) if len(few) <= MOST_PARTS else self.table().join(parts, "part", "left_semi")
            self.read.append(rows)
            found.append(recall.candidates(rows, long, limit))
        if short or not found:
            self.read.append(self.table())
            found.append(recall.candidates(self.table(), short, limit))
        return reduce(DataFrame.unionByName, found).drop("part")

    def files_read(self) -> tuple[int, int]:
        """Files of chunks that the lookups so far have opened, and all of them."""
        names = lambda rows: rows.select(F.input_file_name().alias("f"))
        read = reduce(DataFrame.unionByName, [names(r) for r in self.read]).distinct().count() if self.read else 0
        return read, names(self.table()).distinct().count()
