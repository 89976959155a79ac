"""Workbooks as a data source of rows, for batches and streams; headers, names and fill-down are DataFrame steps.

    spark.dataSource.register(SheetSource)
    rows = spark.read.format("sheets").load("/data/books")          # or readStream
    texts = sheet_texts(rows)

A row of a sheet is (document_id, source_name, sheet_no, sheet, row_no, cells). A file is one partition; a broken one has one
row with an error. Files are listed by pyarrow's file systems, so addresses are plain paths or those that pyarrow knows.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tessera.functions.sheet_rows import NOTE_MARK, SHEET_MARK
from tessera.lexicon import CHINESE, Lexicon
from tessera.operators import sheets
from tessera.sources import files

SCHEMA = "document_id string, source_name string, sheet_no int, sheet string, row_no long, cells array<string>, error string"
SUFFIXES = ("xlsx", "csv", "tsv")
#: Rows of an Arrow batch.
_BATCH = 4096


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[int, str]]:
    """(time of change in nanoseconds, path) of all workbooks under a path, in that order."""
    from pyarrow import fs

    system, at = _file_system(path)
    found = system.get_file_info(fs.FileSelector(at, recursive=True)) if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
    return sorted((int(f.mtime_ns or 0), f.path) for f in found if f.is_file and f.extension.lower() in SUFFIXES)


def sheet_rows_of(name: str, data: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet number, sheet, row number, cells) of a workbook; a text file is one sheet without a name."""
    kind = name.rpartition(".")[2].lower()
    if kind == "xlsx":
        for i, (sheet, rows) in enumerate(files.workbook_rows(data)):
            yield from ((i, sheet, n, cells) for n, cells in enumerate(rows))
    else:
        text = csv.reader(io.StringIO(files.read_text(data).removeprefix("﻿"), newline=""), delimiter="\t" if kind == "tsv" else ",")
        yield from ((0, "", n, [files.cell_text(c) for c in cells]) for n, cells in enumerate(text))


class File(InputPartition):
    def __init__(self, root: str, path: str) -> None:
        self.root, self.path = root, path


def _read(partition: File | None) -> Iterator[pa.RecordBatch]:
    if partition is None:  # what Spark asks for where there are no files
        return
    name = partition.path.rpartition("/")[2]
    document = hashlib.sha256(partition.path.encode()).hexdigest()[:32]
    rows: list[tuple] = []
    try:
        system, _ = _file_system(partition.root)
        with system.open_input_stream(partition.path) as held:
            data = held.read()
        for number, sheet, n, cells in sheet_rows_of(name, data):
            rows.append((document, name, number, sheet, n, cells, None))
            if len(rows) == _BATCH:
                yield _batch(rows)
                rows = []
    except Exception as error:  # noqa: BLE001  a broken file stops no other
        rows.append((document, name, None, None, None, None, f"{type(error).__name__}: {error}"))
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string())
    columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class SheetReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[File]:
        return [File(self.path, p) for _, p in listed(self.path)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class SheetStream(DataSourceStreamReader):
    """Offsets are (time, path) of the last file; files come in that order, so one must not get an earlier time than those before."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"at": json.dumps([-1, ""])}

    def latestOffset(self) -> dict:
        found = listed(self.path)
        return {"at": json.dumps(found[-1])} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[File]:
        after, upto = (tuple(json.loads(o["at"])) for o in (start, end))
        return [File(self.path, p) for t, p in listed(self.path) if after < (t, p) <= upto]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        pass


class SheetSource(DataSource):
    """Format `sheets`; the path is the one given to load()."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SheetStream(self.options["path"])


def sheet_texts(rows: DataFrame, lexicon: Lexicon = CHINESE) -> DataFrame:
    """Structured text of each document: document_id, text: per sheet its marker, header, notes above it and data in CSV.

    The header's row is inferred, its names made unique, columns that group rows are filled down. Blank rows, blank
    sheets and trailing blank columns go; documents of nothing else have no row. Rows are dealt out once, by 128 bits of their
    sheet's names, so that sorting compares numbers, and every step but the last works where they lie. They stay arrays of
    cells; only columns that may be filled down are cut into cells, each sorted on its own.
    """
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    by, named = ["k1", "k2"], ["document_id", "sheet_no", "sheet"]
    parts = [x for c in named for x in (F.col(c), F.col(c).isNull())]
    keys = [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("2"), *parts).alias("k2")]
    held = rows.filter("error is null").filter(F.exists("cells", lambda c: F.trim(c) != "")).select(*keys, F.struct(*named).alias("sheet"), "row_no", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))).alias("cells"))
    marked = sheets.with_header(held, by)
    last = F.array_max(F.transform("cells", lambda c, i: F.when(F.trim(c) != "", i + 1).otherwise(0)))
    head, over = F.col("row_no") == F.col("header_row"), Window.partitionBy(by)
    width, titles = F.max(F.when(F.col("row_no") >= F.col("header_row"), last)).over(over), F.first(F.when(head, F.struct("sheet", "cells")), True).over(over)
    marked = marked.select(*by, "row_no", "cells", "header_row", width.alias("width"), head.alias("head"), titles.alias("titles"))
    fitted = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("width"))), F.lit(1), F.col("width"))
    # Both readers of the rows take the names along, so that they share one shuffle.
    long = marked.filter("row_no >= header_row").select(*by, "head", "titles", F.posexplode(fitted).alias("position", "value"))
    columns = sheets.column_names(long.select(*by, "head", "position", F.coalesce(F.get("titles.cells", "position"), F.lit("")).alias("title"), "value"), by, lexicon)
    columns = columns.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("position", "name", "least"))).alias("columns"))
    cell = lambda c, value, least: F.struct(c["position"].alias("position"), value.alias("value"), least.alias("least"))
    stays = F.lit(None).cast("long")
    note = F.concat(F.lit(f"{NOTE_MARK} "), F.array_join(F.filter(F.transform("cells", clean), lambda c: c != ""), " "))
    own = F.when(F.col("head"), F.transform("columns", lambda c: cell(c, c["name"], stays)))
    own = own.when(F.col("row_no") < F.col("header_row"), F.array(F.struct(F.lit(0).alias("position"), note.alias("value"), stays.alias("least"))))
    own = own.otherwise(F.zip_with("columns", fitted, lambda c, v: cell(c, v, c["least"])))
    part = F.when(F.col("head"), 0).when(F.col("row_no") < F.col("header_row"), 1).otherwise(2)
    lines = marked.join(columns, by).select(*by, F.when(F.col("head"), F.col("titles.sheet")).alias("sheet"), part.alias("part"), "row_no", own.alias("own"))
    rest = F.struct(F.lit(-1).alias("position"), F.lit(None).cast("string").alias("value"), stays.alias("least"))
    pieces = lines.select(*by, "sheet", "part", "row_no", F.filter("own", lambda c: c["least"].isNull()).alias("rest"), F.explode(F.concat(F.array(rest), F.filter("own", lambda c: c["least"].isNotNull()))).alias("c"))
    pieces = pieces.select(*by, F.when(F.col("c.position") < 0, F.col("sheet")).alias("sheet"), "part", "row_no", F.when(F.col("c.position") < 0, F.transform("rest", lambda c: F.struct(c["position"], c["value"]))).alias("rest"), "c.*").withColumn("v", F.trim("value"))
    pieces = pieces.withColumn("n", F.count("*").over(Window.partitionBy(*by, "position", "v")))
    pieces = pieces.withColumn("most", F.max(F.when(F.col("v") != "", F.col("n"))).over(Window.partitionBy(*by, "position")))
    pieces = sheets.forward_fill(pieces, ["v"], [*by, "position"], "row_no")
    fill = F.when(F.col("least") == 0, True).otherwise(F.col("most") / F.col("least") >= 0.25)
    cells = F.coalesce("rest", F.array(F.struct("position", F.when(fill, F.coalesce("v", F.lit(""))).otherwise(F.col("value")).alias("value"))))
    lines = pieces.groupBy(*by, "part", "row_no").agg(F.first("sheet", True).alias("sheet"), F.sort_array(F.flatten(F.collect_list(cells))).alias("c"))
    quoted = lambda v: F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    line = F.array_join(F.transform("c", lambda c: quoted(c["value"])), ",")
    line = F.when((F.size("c") == 1) & (F.col("c")[0]["value"] == ""), '""').otherwise(line)
    mark = F.concat(F.lit(f"{SHEET_MARK} "), "sheet.sheet")
    line = F.when(F.col("part") == 1, F.col("c")[0]["value"]).when(F.col("part") == 0, F.array_join(F.array(mark, line), "\n")).otherwise(line)
    texts = lines.groupBy(*by).agg(F.first("sheet", True).alias("sheet"), F.sort_array(F.collect_list(F.struct("part", "row_no", line.alias("line")))).alias("l"))
    texts = texts.select("sheet.document_id", "sheet.sheet_no", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    whole = texts.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("sheet_no", "text"))).alias("t"))
    return whole.select("document_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))
