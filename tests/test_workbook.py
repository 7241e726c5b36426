"""Workbooks that the test writes itself, read back in ranges."""

import datetime
import zipfile
from xml.sax.saxutils import escape

import pytest

from lexispark.sources import io, workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(i):
    return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def written(path, sheets, late=False, dimension=True, references=True):
    """sheets: name -> rows of cells: text (shared), ('inline', text), number, boolean, ('error',), None."""
    shared = {}

    def cell(i, j, v):
        at = f' r="{letters(j)}{i + 1}"' if references else ""
        if v is None:
            return "" if references else "<c/>"
        if isinstance(v, bool):
            return f'<c{at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            return f'<c{at} t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'
        if isinstance(v, tuple):
            return f'<c{at} t="e"><v>#N/A</v></c>' if v[0] == "error" else f'<c{at} t="inlineStr"><is><r><t>{escape(v[1])}</t></r><rPh><t>no</t></rPh></is></c>'
        return f'<c{at}><v>{v!r}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{RELS}"><workbookPr date1904="{int(late)}"/><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="{RELS}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for k, rows in enumerate(sheets.values()):
            body = "".join(f"<row{f' r={chr(34)}{i + 1}{chr(34)}' if references else ''}>{''.join(cell(i, j, v) for j, v in enumerate(r))}</row>" for i, r in enumerate(rows) if r or not references)
            size = f'<dimension ref="A1:C{len(rows)}"/>' if dimension else ""
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {MAIN}>{size}<sheetData>{body}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared) + "</sst>")


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    workbook.register(spark)


@pytest.mark.parametrize("dimension", [True, False])
@pytest.mark.parametrize("references", [True, False])
def test_ranges(spark, tmp_path, dimension, references):
    rows = [["id", "descr", "x"], *([i, f"t{i} <&>" if i % 3 else ("inline", " a "), i / 4 if i % 5 else None] for i in range(1, 1001))]
    written(tmp_path / "a.xlsx", {"other": [["z"]], "lines": rows}, dimension=dimension, references=references)
    read = spark.read.format("workbook").option("sheet", "lines").option("rows", 137).schema("x double, id long, descr string, missing int").load(str(tmp_path / "a.xlsx"))
    assert read.rdd.getNumPartitions() == (8 if dimension else 1)
    want = [(i / 4 if i % 5 else None, i, f"t{i} <&>" if i % 3 else " a ", None) for i in range(1, 1001)]
    assert sorted((tuple(r) for r in read.collect()), key=lambda r: r[1]) == want


def test_types(spark, tmp_path):
    rows = [["s", "n", "b", "d", "t", "s"], [1.0, 2.5, True, 1, 45000.5, "second"], ["x", "7", "false", "2026-01-02", 59, None], [True, ("error",), ("error",), "no date", 61, None], [], [None, 1e300, 3, 1e12, None, None], [1e300]]
    written(tmp_path / "a.xlsx", {"a": rows})
    d, day = datetime.datetime, datetime.date
    want = [("1", None, True, day(1900, 1, 1), d(2023, 3, 15, 12)), ("x", 7, False, day(2026, 1, 2), d(1900, 2, 28)), ("true", None, None, None, d(1900, 3, 1)), (None, None, None, None, None), ("1e+300", None, None, None, None)]
    got = spark.read.format("workbook").schema("s string, n int, b boolean, d date, t timestamp_ntz").load(str(tmp_path / "a.xlsx")).collect()
    assert [tuple(r) for r in got] == want
    written(tmp_path / "b.xlsx", {"a": [["d"], [1]]}, late=True)
    assert spark.read.format("workbook").schema("d date").load(str(tmp_path / "b.xlsx")).first()[0] == day(1904, 1, 2)


def test_folders_headers_and_empty_sheets(spark, tmp_path):
    for n in "ab":
        written(tmp_path / f"{n}.xlsx", {"s": [["k", "v"], [n, 1]]})
    read = spark.read.format("workbook").load(str(tmp_path))
    assert read.columns == ["k", "v"] and sorted(tuple(r) for r in read.collect()) == [("a", "1"), ("b", "1")]
    assert spark.read.format("workbook").option("header", "false").load(f"file://{tmp_path}/a*.xlsx").collect() == [("k", "v"), ("a", "1")]
    written(tmp_path / "c.xlsx", {"s": []})
    assert spark.read.format("workbook").schema("k string").load(str(tmp_path / "c.xlsx")).count() == 0
    for broken in (lambda: spark.read.format("workbook").load(str(tmp_path / "none.xlsx")), lambda: spark.read.format("workbook").option("sheet", "no").load(str(tmp_path / "a.xlsx")), lambda: spark.read.format("workbook").schema("k binary").load(str(tmp_path / "a.xlsx")).count()):
        with pytest.raises(Exception, match="no workbook|no sheet|no type"):
            broken()


def test_landing(spark, tmp_path):
    written(tmp_path / "a.xlsx", {"s": [["batch", "descr"], ["b1", "one"], ["b2", "two"], ["b1", "three"]]})
    io.load_workbook(spark, str(tmp_path / "a.xlsx"), "batch string, descr string", "b1", "batch", str(tmp_path / "t"))
    assert sorted(r.descr for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["one", "three"]
    with pytest.raises(ValueError, match="xlsx"):
        io.load_workbook(spark, "a.xls", "a string", "b", "a", str(tmp_path / "t"))
