"""Sections and sheets of documents as rows: headings, their paths and bodies by windows over lines, rows of tables.

`docs` has document_id and text. What `functions.chunking` does to one text in memory is here a table of lines, so that a
section or a row, and not a document, is what a task holds; only the packing of one section's sentences is Python.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import chunking as C
from tessera.storage import stored

#: A heading line has 140 characters at most, so its number has fewer levels than this.
MOST_LEVELS = 70
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lines(docs: DataFrame) -> DataFrame:
    """Stripped lines: document_id, n (from 0), line. Null texts have none."""
    return docs.select("document_id", F.posexplode(F.split("text", _BREAK)).alias("n", "line")).withColumn("line", _strip(F.col("line")))


def heading(line: Column) -> Column:
    """The level and title of a heading line, as a struct; null for other lines."""
    text = F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]+", " ")
    plain = (text != "") & (F.length(text) <= 140) & ~text.rlike("[。；;]")
    marks, numbers = r"^(#{1,6}) +(\S.{0,80})$", r"(?U)^(\d+(?:\.\d+)*)(?:、|[.．])\s*\S.{0,70}$"
    top = text.rlike(r"^第[一二三四五六七八九十百千万0-9]+[章节条部分][、.．\s:：-]*\S.{0,70}$") | text.rlike(r"^[一二三四五六七八九十]+[、.．]\s*\S.{0,70}$")
    second = text.rlike(r"^[（(][一二三四五六七八九十0-9]+[）)]\s*\S.{0,70}$")
    bare = F.trim(F.regexp_replace(F.when(text.rlike(marks), F.trim(F.regexp_extract(text, marks, 2))).otherwise(text), r"^#{1,6}\s*", ""))
    dots = F.regexp_extract(text, numbers, 1)
    level = (
        F.when(text.rlike(marks), F.length(F.regexp_extract(text, marks, 1)))
        .when(text.rlike(numbers), F.length(dots) - F.length(F.replace(dots, F.lit("."), F.lit(""))) + 1)
        .when(top, 1)
        .when(second, 2)
    )
    return F.when(plain & level.isNotNull(), F.struct(level.cast("int").alias("level"), bare.alias("title")))


def sections(docs: DataFrame) -> DataFrame:
    """Sections of documents that have headings: document_id, section_no, path (of titles), body.

    Text before the first heading has an empty path. Sections without a body go, but for a document's last one. A path
    holds, of each level above the heading's own, the last heading if none of a higher level came after it.
    """
    held = stored(lines(docs).withColumn("head", heading(F.col("line"))))
    most = held.agg(F.max("head.level")).first()[0]
    if most is None:
        return held.limit(0).select("document_id", F.lit(0).cast("long").alias("section_no"), F.lit("").alias("path"), F.lit("").alias("body"))
    begins = F.col("head").isNotNull().cast("int")
    along = Window.partitionBy("document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    numbered = held.withColumn("section_no", F.sum(begins).over(along))
    # Of each level the last heading of it or a higher one: it is on the path if its level is that very one.
    heads = numbered.filter("head is not null").select("document_id", "section_no", "n", "head.level", "head.title")
    own = Window.partitionBy("document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    above = [F.max(F.when(F.col("level") <= i, F.struct("n", "level", "title"))).over(own).alias(f"_l{i}") for i in range(1, min(most, MOST_LEVELS) + 1)]
    heads = heads.select("*", *above)
    steps = F.array(*(F.when((F.col(f"_l{i}.level") == i) & (F.col("level") > i), F.col(f"_l{i}.title")) for i in range(1, len(above) + 1)))
    heads = heads.select("document_id", "section_no", F.array_join(F.concat(F.array_compact(steps), F.array("title")), " / ").alias("path"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("head").isNull(), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    bodies = numbered.groupBy("document_id", "section_no").agg(joined.alias("body"))
    bodies = bodies.withColumn("body", F.regexp_replace(F.regexp_replace("body", "\n{3,}", "\n\n"), "^\n+|\n+$", ""))
    last = heads.groupBy("document_id").agg(F.max("section_no").alias("last"))
    found = bodies.join(last, "document_id").join(heads, ["document_id", "section_no"], "left").withColumn("path", F.coalesce("path", F.lit("")))
    return found.filter((F.col("body") != "") | (F.col("section_no") == F.col("last"))).select("document_id", "section_no", "path", "body")


def section_chunks(docs: DataFrame, size: int = C.ARTICLE_SIZE, overlap: int = C.ARTICLE_OVERLAP, separators: Sequence[str] = C.ARTICLE_SEPARATORS) -> DataFrame:
    """Chunks within sections, each with its path: document_id, section_no, at, content. Titles alone are no chunk."""

    @F.pandas_udf("array<string>")
    def split(paths: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for path, body in zip(paths, bodies, strict=True):
            prefix = C.SECTION_MARK + path.strip() if path.strip() else ""
            room = max(C.LEAST_BODY, size - len(prefix) - 1) if prefix else size
            cut = C.split_text(body, room, min(overlap, room // 3) if prefix else overlap, separators)
            out.append([f"{prefix}\n{c}".strip() for c in cut] if prefix else cut)
        return pd.Series(out, dtype=object)

    found = sections(docs)
    return found.select("document_id", "section_no", F.posexplode(split("path", "body")).alias("at", "content"))


def sheet_lines(docs: DataFrame) -> DataFrame:
    """Lines of documents with a sheet marker: document_id, sheet_no, sheet, row_no (0 is the header), line.

    Lines before the first marker are a sheet without a name; blank lines go.
    """
    held = lines(docs).filter("line <> ''").withColumn("mark", F.when(F.col("line").rlike(r"(?i)^\[Sheet\]\s*.+$"), F.trim(F.regexp_extract("line", r"(?i)^\[Sheet\]\s*(.+?)\s*$", 1))))
    along = Window.partitionBy("document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("sheet_no", F.sum(F.col("mark").isNotNull().cast("int")).over(along))
    marked = held.groupBy("document_id").agg(F.max("sheet_no").alias("sheets")).filter("sheets > 0").select("document_id")
    names = held.filter("mark is not null").select("document_id", "sheet_no", F.col("mark").alias("sheet"))
    rows = held.filter("mark is null").withColumn("row_no", F.row_number().over(Window.partitionBy("document_id", "sheet_no").orderBy("n")) - 1)
    rows = rows.join(marked, "document_id", "left_semi").join(names, ["document_id", "sheet_no"], "left")
    return rows.select("document_id", "sheet_no", F.coalesce("sheet", F.lit("")).alias("sheet"), "row_no", "line")


def row_chunks(docs: DataFrame) -> DataFrame:
    """A chunk for each data row of a table, with its marker and header: document_id, sheet_no, row_no, content.

    Rows that begin with a bracket are left out.
    """
    rows = sheet_lines(docs)
    heads = rows.filter("row_no = 0").select("document_id", "sheet_no", F.col("line").alias("header"))
    head = F.array_compact(F.array(F.when(F.col("sheet") != "", F.concat(F.lit("[Sheet] "), F.col("sheet"))), F.col("header"), F.col("line")))
    found = rows.filter((F.col("row_no") > 0) & ~F.col("line").startswith("[")).join(heads, ["document_id", "sheet_no"])
    return found.select("document_id", "sheet_no", "row_no", F.array_join(head, "\n").alias("content"))
