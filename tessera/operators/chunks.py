"""Chunking of document tables; each text is chunked where the scan put it, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import chunking as C


#: Characters of text whose chunks a task holds at once, besides those of one text.
MOST_HELD = 1 << 20


def in_parts(values: Iterable[tuple[int, object]], most: int = MOST_HELD) -> Iterator[pd.Series]:
    """Values as series, each ended by the value that brings its sum of sizes to `most`, however many rows a batch has."""
    held, size = [], 0
    for n, value in values:
        held.append(value)
        size += n
        if size >= most:
            yield pd.Series(held, dtype=object)
            held, size = [], 0
    if held:
        yield pd.Series(held, dtype=object)


def _column(split: Callable[[str | None, str | None], list], kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, types in batches:
            yield from in_parts((len(t or "") + 64, split(t, f)) for t, f in zip(texts, types, strict=True))

    return run


def split_documents(docs: DataFrame, size: int = C.SIZE, overlap: int = C.OVERLAP) -> DataFrame:
    """Chunks by the kind of file: document_id, source_name, file_type, chunk_index, content.

    `docs`: document_id, source_name, file_type, text. A null or blank text has no chunk.
    """
    split = _column(lambda t, f: C.split_document(t, size, overlap, f), "array<string>")
    return docs.select("document_id", "source_name", "file_type", F.posexplode(split("text", "file_type")).alias("chunk_index", "content"))


def parent_children(
    docs: DataFrame, parent: tuple[int, int] = (C.PARENT_SIZE, C.PARENT_OVERLAP), child: tuple[int, int] = (C.CHILD_SIZE, C.CHILD_OVERLAP)
) -> tuple[DataFrame, DataFrame]:
    """Parents and children of documents (document_id, source_name, file_type, text).

    Children are numbered through a document; ids are `<document>:p000000` and `<document>:c000000`.
    """

    def split(text, kind):
        out, n = [], 0
        for p, children in C.parent_children(text, kind, parent, child):
            out.append({"text": p, "first": n, "children": children})
            n += len(children)
        return out

    cut = _column(split, "array<struct<text:string,first:int,children:array<string>>>")
    held = docs.select(F.col("document_id").cast("string").alias("document_id"), "source_name", "file_type", F.posexplode(cut("text", "file_type")).alias("parent_index", "p"))
    name = lambda letter, n: F.concat(F.col("document_id"), F.lit(f":{letter}"), F.lpad(n.cast("string"), 6, "0"))
    held = held.withColumn("parent_id", name("p", F.col("parent_index")))
    parents = held.select("parent_id", "document_id", "parent_index", F.col("p.text").alias("parent_text"), "source_name", "file_type")
    children = held.select("parent_id", "document_id", "parent_index", "source_name", "file_type", F.col("p.first").alias("first"), F.posexplode("p.children").alias("at", "child_text"))
    children = children.withColumn("chunk_index", F.col("first") + F.col("at"))
    return parents, children.select(name("c", F.col("chunk_index")).alias("child_id"), "parent_id", "document_id", "parent_index", "chunk_index", "child_text", "source_name", "file_type")


def line_chunks(docs: DataFrame) -> DataFrame:
    """Lines that aren't blank as chunks: document_id, source_name, chunk_index, content."""
    from tessera.functions.text import lines

    return docs.select("document_id", "source_name", F.posexplode(lines(F.col("text"))).alias("chunk_index", "content"))
