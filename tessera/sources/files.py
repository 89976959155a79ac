"""Files to text: a binary scan, and one Arrow function that picks the reader by suffix.

Text, Word, Excel and PowerPoint files are read with the standard library; readers of other kinds (PDF among them)
are given by the caller.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sheet_rows

Reader = Callable[[bytes], str]

# Encodings in the order they are tried, and the mark of a table.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb18030")
TABLE_MARK = "[表格]"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_text(data: bytes) -> str:
    """Decode by the first encoding that fits; a leading byte order mark stays."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    raise ValueError("the text fits none of the encodings")


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element:
    return ET.fromstring(archive.read(name))


def read_docx(data: bytes) -> str:
    """Paragraphs and tables of the body in order, parted by blank lines; a table's rows under a mark."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _xml(z, "word/document.xml").find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    blocks = []
    for part in body if body is not None else ():
        if part.tag == f"{_W}p":
            blocks.append(said(part))
        elif part.tag == f"{_W}tbl":
            rows = [" | ".join(said(c) for c in row.iter(f"{_W}tc")) for row in part.iter(f"{_W}tr")]
            blocks.append("\n".join([TABLE_MARK, *(r for r in rows if r.strip(" |"))]))
    return "\n\n".join(b for b in blocks if b)


def read_pptx(data: bytes) -> str:
    """The texts of each slide's shapes on lines, slides parted by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        slides = []
        for n in sorted(names, key=lambda n: int(re.search(r"\d+", n)[0])):
            texts = ("".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in _xml(z, n).iter(f"{_A}p"))
            slides.append("\n".join(t for t in texts if t))
    return "\n\n".join(s for s in slides if s)


def cell_text(value: object) -> str:
    """A cell as one line: whole numbers without a fraction, white space collapsed, nothing for missing values."""
    if value is None or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return " ".join(str(value).split())


def _column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook_rows(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(sheet name, rows of cell texts) of a workbook; merged cells have their first cell's text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _xml(z, "xl/sharedStrings.xml").iter(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target", "") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        for sheet in _xml(z, "xl/workbook.xml").iter(f"{_S}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            root = _xml(z, target if target.startswith("xl/") else f"xl/{target}")
            cells: dict[tuple[int, int], str] = {}
            for i, row in enumerate(root.iter(f"{_S}row")):
                y = int(row.get("r", i + 1)) - 1
                for j, c in enumerate(row.iter(f"{_S}c")):
                    x = _column_number(c.get("r", "")) if c.get("r") else j
                    kind, v = c.get("t"), c.find(f"{_S}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif v is None or v.text is None:
                        continue
                    elif kind == "s":
                        text = shared[int(v.text)]
                    elif kind in ("str", "e", "b"):
                        text = v.text
                    else:
                        text = float(v.text)
                    cells[y, x] = cell_text(text)
            used = [max((p[i] for p, v in cells.items() if v), default=-1) + 1 for i in (0, 1)]
            for merged in root.iter(f"{_S}mergeCell"):
                a, _, b = merged.get("ref", "A1").partition(":")
                (xa, ya), (xb, yb) = ((_column_number(r), int(re.search(r"\d+", r)[0]) - 1) for r in (a, b or a))
                # A merge may span whole rows or columns: only what the sheet uses is filled.
                for y in range(ya, min(yb + 1, used[0])):
                    for x in range(xa, min(xb + 1, used[1])):
                        cells.setdefault((y, x), cells.get((ya, xa), ""))
            height, width = (max((p[i] for p, v in cells.items() if v), default=-1) + 1 for i in (0, 1))
            yield sheet.get("name", ""), [[cells.get((y, x), "") for x in range(width)] for y in range(height)]


def read_xlsx(data: bytes) -> str:
    """Each sheet's marker, header, notes above it and data rows in CSV; see functions.sheet_rows."""
    return "\n".join(filter(None, (sheet_rows.sheet_text(name, rows) for name, rows in workbook_rows(data))))


READERS: dict[str, Reader] = {"txt": read_text, "md": read_text, "csv": read_text, "tsv": read_text, "docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx}


def read_files(spark: SparkSession, path: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Texts of all files under a path: document_id (of the path), source_name, file_type, file_size, text, error.

    A kind without a reader, a file that can't be read, and one without text have an error and a null text; no file
    stops the others.
    """
    known = READERS | (readers or {})

    @F.pandas_udf("text string, error string")
    def extract(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, data in zip(kinds, contents, strict=True):
            reader = known.get(kind)
            if reader is None:
                rows.append((None, f"no reader for {kind!r} files"))
                continue
            try:
                text = reader(bytes(data))
                rows.append((text, None) if text.strip() else (None, "no text"))
            except Exception as e:  # noqa: BLE001  whatever a broken file makes a parser raise belongs to its row
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    held = files.select(F.sha2("path", 256).substr(1, 32).alias("document_id"), name.alias("source_name"), kind.alias("file_type"), F.col("length").alias("file_size"), "content")
    return held.withColumn("e", extract("file_type", "content")).select("document_id", "source_name", "file_type", "file_size", "e.text", "e.error")
