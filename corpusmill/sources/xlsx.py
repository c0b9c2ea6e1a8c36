"""Spreadsheets as a Python data source: spark.read.format("xlsx_rows").load(folder or file).

One row per sheet row of the first sheet (least sheet number): path, row_no
(from 1), cells (0-based column to text).  Shared strings with rich text,
inline strings, numbers and booleans are text.  One partition a file; a row at
a time is parsed, so memory holds the shared strings and one row.  Paths are on
any file system that Arrow opens; write_sheets is the sink.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, a local one if it names none, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def rows(uri: str) -> Iterator[tuple[int, dict[int, str]]]:
    files, path = file_system(uri)
    with files.open_input_file(path) as opened, zipfile.ZipFile(opened) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == _NS + "si":
                        shared.append("".join(t.text or "" for t in e.iter(_NS + "t")))
                        e.clear()
        sheets = sorted((int(m[1]), x) for x in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", x)))
        if not sheets:
            return
        count = 0
        with z.open(sheets[0][1]) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != _NS + "row":
                    continue
                count += 1
                cells = {}
                for place, c in enumerate(e.iter(_NS + "c")):
                    kind, value = c.get("t"), c.find(_NS + "v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(_NS + "t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if kind == "s" else value.text
                    cells[column_number(c.get("r")) if c.get("r") else place] = text
                yield count, cells
                e.clear()


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class XlsxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """The workbooks of a folder by name, lock files left out, or the one file."""
        files, path = file_system(self.path)
        before = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        if files.get_file_info(path).type == pafs.FileType.File:
            return [_File(self.path)]
        found = sorted(x.path for x in files.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".xlsx") and not x.base_name.startswith("~$"))
        return [_File(before + x) for x in found] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.path:
            for number, cells in rows(partition.path):
                yield partition.path.removeprefix("file://"), number, cells


class XlsxRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_rows"

    def schema(self) -> str:
        return "path string, row_no long, cells map<int,string>"

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(self.options["path"])


#: The parts of a workbook besides its one sheet.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _sheet(rows: Iterable[list]) -> Iterator[str]:
    yield f'<worksheet xmlns="{_NS[1:-1]}"><sheetData>'
    for cells in rows:
        yield "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x or "")}</t></is></c>' for x in cells) + "</row>"
    yield "</sheetData></worksheet>"


def write_sheets(df: DataFrame, folder: str) -> DataFrame:
    """Writes (name, row_no, cells array<string>) as a workbook a name, rows in the order of row_no; returns (name, n_rows). A file appears under its name when it is whole."""

    def save(name: str, rows: list[list]) -> pd.DataFrame:
        files, path = file_system(folder)
        part = f"{path}/.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for place, text in _PARTS.items():
                z.writestr(place, text)
            with z.open("xl/worksheets/sheet1.xml", "w") as f:
                for text in _sheet(rows):
                    f.write(text.encode())
        files.move(part, f"{path}/{name}")
        return pd.DataFrame({"name": [name], "n_rows": [len(rows)]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []  # a sheet has a bounded number of rows
        for frame in frames:
            for name, cells in zip(frame["name"], frame["cells"]):
                if name != now and held:
                    yield save(now, held)
                    held = []
                now = name
                held.append(list(cells))
        if held:
            yield save(now, held)

    return df.select("name", "row_no", "cells").repartition("name").sortWithinPartitions("name", "row_no").mapInPandas(run, "name string, n_rows long")
