"""The workbook source: rows by batch and stream, and sheets as DataFrame steps against sheets put together in memory."""

import os
import random
import zipfile
from xml.sax.saxutils import escape

import pytest

from tessera.functions import sheet_rows
from tessera.sources import files, sheets
from tessera.streaming.events import run_to_end

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letter(x):
    return (chr(64 + x // 26) if x >= 26 else "") + chr(65 + x % 26)


def workbook(path, named, merged=()):
    """Write a workbook of sheets {name: rows of texts and numbers}."""
    with zipfile.ZipFile(path, "w") as z:
        tags = "".join(f'<sheet name="{escape(n)}" r:id="r{i}"/>' for i, n in enumerate(named))
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>{tags}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(named))) + "</Relationships>")
        for i, rows in enumerate(named.values()):
            body = ""
            for y, row in enumerate(rows):
                for x, v in enumerate(row):
                    at = f'r="{letter(x)}{y + 1}"'
                    body += f'<row r="{y + 1}">' * (x == 0) + (f"<c {at}><v>{v}</v></c>" if isinstance(v, float) else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' if v else "")
                body += "</row>" if row else ""
            marks = "".join(f'<mergeCell ref="{m}"/>' for m in merged)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData><mergeCells>{marks}</mergeCells></worksheet>")


STAFF = [["Staff list"], [], ["部门", "name", "name", "", "工资"], ["研发", "a", "x", "q\"t", 1.0], ["", "b", "", "u, v", 2.5], ["", "c", "y", "", ""], ["测试", "d", "z", "w", 4.0]]


@pytest.fixture
def books(tmp_path):
    rng = random.Random(8)
    workbook(tmp_path / "staff.xlsx", {"员工": STAFF, "empty": [[], [""]], "one": [["only"]], "single": [["h"], ["1"], ["x"], ["2"]], "fill": [["部门", "name"], ["研发", "a"], ["", "b"]], "names": [["Title"], ["n", "n", "工资"], ["a", "x", 1.0], ["b", "", 2.0]]})
    for i in range(6):
        rows = [[rng.choice(["", "", "g1", "g2", "3", "text, more", " pad ", "Unnamed: 1", 7.0, 0.25]) for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(0, 14))]
        workbook(tmp_path / f"random{i}.xlsx", {f"s{i}": rows, "部门表": [["部门", "v"], ["a", "1"], ["", "2"], *rows]})
    (tmp_path / "t.csv").write_text('a,b\n1,"x, y"\n\n2,', encoding="utf-8")
    (tmp_path / "t.tsv").write_text("k\tv\nx\t1\n", encoding="gbk")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "note.txt").write_text("not a sheet")
    return tmp_path


def test_steps_give_the_text_that_memory_does(spark, books):
    spark.dataSource.register(sheets.SheetSource)
    rows = spark.read.format("sheets").load(str(books))
    names = {r["document_id"]: r["source_name"] for r in rows.select("document_id", "source_name").distinct().collect()}
    got = {names[r["document_id"]]: r["text"] for r in sheets.sheet_texts(rows).collect()}
    want = {}
    for name in os.listdir(books):
        if name.endswith(".xlsx") and name != "broken.xlsx":
            want[name] = files.read_xlsx((books / name).read_bytes())
    want["t.csv"] = sheet_rows.sheet_text("", [["a", "b"], ["1", "x, y"], [], ["2", ""]])
    want["t.tsv"] = sheet_rows.sheet_text("", [["k", "v"], ["x", "1"]])
    assert got == {k: v for k, v in want.items() if v}
    assert got["staff.xlsx"].endswith("[Sheet] fill\n部门,name\n研发,a\n研发,b\n[Sheet] names\nn,n_2,工资\n[说明] Title\na,x,1\nb,,2")
    bad = rows.filter("error is not null").collect()
    assert [(r["source_name"], r["cells"]) for r in bad] == [("broken.xlsx", None)] and "BadZipFile" in bad[0]["error"]
    assert rows.rdd.getNumPartitions() == 10


def test_new_files_arrive_by_stream(spark, books, tmp_path_factory):
    spark.dataSource.register(sheets.SheetSource)
    base = str(tmp_path_factory.mktemp("stream"))
    stream = lambda: spark.readStream.format("sheets").load(str(books))
    shown = lambda df: sorted(map(str, df.collect()))
    first = run_to_end(stream(), "append", base)
    assert shown(first) == shown(spark.read.format("sheets").load(str(books)))
    n = first.count()
    workbook(books / "later.xlsx", {"later": [["h1", "h2"], ["a", "b"]]})
    after = run_to_end(stream(), "append", base)
    assert after.count() == n + 2
    assert shown(sheets.sheet_texts(after)) == shown(sheets.sheet_texts(spark.read.format("sheets").load(str(books))))


def test_merges_of_whole_columns(tmp_path):
    workbook(tmp_path / "m.xlsx", {"s": [["g", "a"], ["", "b"], ["", "c"]]}, merged=["A1:A1048576", "C5:XFD1048576"])
    assert list(files.workbook_rows((tmp_path / "m.xlsx").read_bytes())) == [("s", [["g", "a"], ["g", "b"], ["g", "c"]])]


def test_no_sheets(spark, tmp_path):
    spark.dataSource.register(sheets.SheetSource)
    assert spark.read.format("sheets").load(str(tmp_path)).collect() == []
    assert sheets.sheet_texts(spark.createDataFrame([], sheets.SCHEMA)).collect() == []


def test_sheets_are_dealt_out_once(spark):
    cells = [["n", "n", "n_2"], ["x", "x", "1"], ["y", "", "2"], ["z", "x", "3"], ["w", "", "4"]]
    table = [("d", "d.xlsx", 0, "s", i, r, None) for i, r in enumerate(cells)] + [(None, "?", None, None, i, r, None) for i, r in enumerate([["h", "部门"], ["1", "p"], ["2", ""]])]
    texts = sheets.sheet_texts(spark.createDataFrame(table, sheets.SCHEMA))
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3  # by sheet, for both readers, and by document
    assert {r["document_id"]: r["text"] for r in texts.collect()} == {"d": sheet_rows.sheet_text("s", cells), None: "h,部门\n1,p\n2,p"}
    assert "y,x,2" in sheet_rows.sheet_text("s", cells)  # columns whose names end up equal are filled each on its own
