"""Workbooks (.xlsx) as a data source of Spark (S7): rows of sheets are read in ranges by the executors.

    register(spark)
    spark.read.format("workbook").schema("id long, descr string, day date").load("/landing/2026*.xlsx")

Options: path (a file, a folder or a pattern; a URI is opened by pyarrow), sheet (its name; default the first), header
(whether the first row names the columns, default true; columns of the schema are found by name then, else by place),
rows (rows of a range, 250000). Without a schema all columns are strings, named by the header of the first file, or c0,
c1 ... as wide as its first row.

The planner reads the list of sheets, their sizes and a header only. A task streams the XML of its sheet, so it holds one
row and the workbook's shared strings. A sheet is one compressed stream, so a task passes over the rows before its range;
a sheet has 1,048,576 rows at most. Empty rows give no row; empty cells, cells with errors and cells that are not of the
column's type give null; a missing column is null, a second column of one name is not read. Dates are counted from 1900, or
1904 where the workbook says so. The binary .xls format is not read."""

from __future__ import annotations

import datetime
import glob
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_ROWS = 1 << 20


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    """The workbooks that a path means, in the order of their names."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        if path.startswith("file:"):
            return _files(re.sub("^file:(//)?", "", path))
        system, inner = _file_system(path)
        if system.get_file_info(inner).type != fs.FileType.Directory:
            return [path]
        root = path[: len(path) - len(inner)] if path.endswith(inner) else path
        return sorted(root + f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".xlsx"))
    found = glob.glob(os.path.join(path, "*.xlsx")) if os.path.isdir(path) else glob.glob(path)
    if not found:
        raise FileNotFoundError(f"no workbook at {path}")
    return sorted(found)


def _opened(path: str) -> zipfile.ZipFile:
    if "://" in path:
        system, inner = _file_system(path)
        return zipfile.ZipFile(system.open_input_file(inner))
    return zipfile.ZipFile(path)


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _sheet(book: zipfile.ZipFile, name: str | None) -> tuple[str, bool]:
    """The member of the sheet of that name, or the first, and whether dates count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = {s.get("name"): next(v for k, v in s.attrib.items() if k.startswith("{") and k.endswith("}id")) for s in root.iter() if _tag(s) == "sheet"}
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    if name is not None and name not in sheets:
        raise ValueError(f"no sheet {name}; there are {', '.join(sheets)}")
    target = targets[sheets[name] if name is not None else next(iter(sheets.values()))]
    late = any(_tag(p) == "workbookPr" and p.get("date1904") in ("1", "true") for p in root.iter())
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", late


def _text(element) -> str:
    """The text of a string with its runs, without phonetic marks."""
    return "".join(t.text or "" for part in element for t in ([part] if _tag(part) == "t" else [x for x in part if _tag(x) == "t"] if _tag(part) == "r" else []))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, element in ElementTree.iterparse(f):
            if _tag(element) == "si":
                out.append(_text(element))
                element.clear()
    return out


def _place(reference: str) -> int:
    place = 0
    for sign in reference:
        if not sign.isalpha():
            break
        place = place * 26 + ord(sign.upper()) - 64
    return place - 1


def _rows(book: zipfile.ZipFile, member: str, shared: list[str], start: int, end: int) -> Iterator[tuple[int, dict[int, object]]]:
    """(number from 0, cells by place) of the rows from start up to end: strings, floats and booleans."""
    with book.open(member) as f:
        number, data = -1, None
        for event, element in ElementTree.iterparse(f, events=("start", "end")):
            tag = _tag(element)
            if event == "start":
                data = element if tag == "sheetData" else data
            elif tag == "row":
                number = int(element.get("r")) - 1 if element.get("r") else number + 1
                if number >= end:
                    return
                if number >= start:
                    yield number, _cells(element, shared)
                data.clear()


def _cells(row, shared: list[str]) -> dict[int, object]:
    out, place = {}, -1
    for cell in row:
        place = _place(cell.get("r")) if cell.get("r") else place + 1
        kind = cell.get("t", "n")
        inner = {_tag(x): x for x in cell}
        if kind == "inlineStr" and "is" in inner:
            out[place] = _text(inner["is"])
        elif "v" in inner and inner["v"].text is not None and kind != "e":
            said = inner["v"].text
            out[place] = shared[int(said)] if kind == "s" else said in ("1", "true") if kind == "b" else float(said) if kind == "n" else said
    return out


def _plain(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return value


def _when(value, late: bool) -> datetime.datetime | None:
    """A date by its number of days, to the microsecond, or by its ISO form. The 1900 count has a 29 February 1900."""
    if isinstance(value, str):
        return datetime.datetime.fromisoformat(value.strip()).replace(tzinfo=None)
    start = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30) if value >= 60 else datetime.datetime(1899, 12, 31)
    return start + datetime.timedelta(milliseconds=round(float(value) * 86_400_000))


_LONGEST = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _converted(value, kind: T.DataType, late: bool):
    try:
        if value is None or isinstance(kind, T.StringType):
            return None if value is None else _plain(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}.get(_plain(value).strip().lower())
        if isinstance(kind, tuple(_LONGEST)):
            number = int(value) if isinstance(value, float) and value.is_integer() else int(_plain(value))
            return number if -(1 << _LONGEST[type(kind)]) <= number < 1 << _LONGEST[type(kind)] else None
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(kind, T.DateType):
            return _when(value, late).date()
        return _when(value, late)
    except (ValueError, OverflowError, TypeError):
        return None


@dataclass
class Range(InputPartition):
    """Rows of one sheet; the rows before `start` are passed over."""

    path: str
    start: int
    end: int


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _header(self) -> bool:
        return self.options.get("header", "true").lower() == "true"

    def schema(self) -> T.StructType:
        with _opened(_files(self.options["path"])[0]) as book:
            member, _ = _sheet(book, self.options.get("sheet"))
            first = next(_rows(book, member, _shared(book), 0, MOST_ROWS), (0, {}))[1]
        if not self._header():
            return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(first, default=-1) + 1)])
        return T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(_plain(first[i]) for i in sorted(first))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kinds = (T.StringType, T.BooleanType, T.DoubleType, T.FloatType, T.DateType, T.TimestampType, T.TimestampNTZType, *_LONGEST)
        wrong = [f.name for f in schema if not isinstance(f.dataType, kinds)]
        if wrong:
            raise ValueError(f"a workbook has no type for {', '.join(wrong)}")
        return _Reader(schema, dict(self.options), self._header())


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str], header: bool):
        self.columns, self.path, self.sheet, self.header = [(f.name, f.dataType) for f in schema], options["path"], options.get("sheet"), header
        self.rows = int(options.get("rows", "250000"))

    def partitions(self) -> list[Range]:
        """As many ranges as the sheet says it has rows for; the last is open, in case it has more."""
        out = []
        for path in _files(self.path):
            with _opened(path) as book, book.open(_sheet(book, self.sheet)[0]) as f:
                said = re.search(rb'dimension[^>]*ref="[A-Z]*[0-9]*:[A-Z]+([0-9]+)"', f.read(1 << 14))
            starts = [*range(0, int(said[1]) if said else 1, self.rows)] or [0]
            out += [Range(path, a, b) for a, b in zip(starts, [*starts[1:], MOST_ROWS])]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        with _opened(partition.path) as book:
            member, late = _sheet(book, self.sheet)
            shared = _shared(book)
            places, skip = {i: i for i in range(len(self.columns))}, -1
            if self.header:
                skip, first = next(_rows(book, member, shared, 0, MOST_ROWS), (-1, {}))
                named = {_plain(first[i]): i for i in sorted(first, reverse=True)}
                places = {i: named.get(name, -1) for i, (name, _) in enumerate(self.columns)}
            for number, cells in _rows(book, member, shared, partition.start, partition.end):
                if number > skip and cells:
                    yield tuple(_converted(cells.get(places[i]), kind, late) for i, (_, kind) in enumerate(self.columns))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbook)
