"""Spreadsheets (Office Open XML) as tables, parsed by tasks, a workbook each.

A workbook is a zip of XML parts: the list of sheets, the shared strings, and a part for each sheet.  Cells come as text; dates and
numbers are as they are stored, whole numbers without a fraction.  Readers cast what they need, as for delimited text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as X

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    """The number of a cell's column: A is 0, AA is 26."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def sheet_rows(raw: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a named sheet, or of the first one; blank rows are left out, and short ones end early."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = {s.get("name"): s.get(_REL) for s in X.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        if sheet is not None and sheet not in names:
            raise ValueError(f"no sheet {sheet!r}; there are {', '.join(names)}")
        wanted = names[sheet] if sheet is not None else next(iter(names.values()))
        target = next(r.get("Target") for r in X.fromstring(book.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == wanted)
        strings: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            # a string may come in runs; phonetic hints are no part of it
            for item in X.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                strings.append("".join(t.text or "" for part in item if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in part.iter(f"{_MAIN}t")))
        with book.open(target.removeprefix("/") if target.startswith("/") else f"xl/{target}") as part:
            for _, row in X.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                line: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(line)
                    line += [None] * (at + 1 - len(line))
                    value, kind = cell.find(f"{_MAIN}v"), cell.get("t", "n")
                    if kind == "inlineStr":
                        line[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is not None and value.text is not None:
                        line[at] = strings[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[value.text] if kind == "b" else _number(value.text) if kind == "n" else None if kind == "e" else value.text
                if any(v not in (None, "") for v in line):
                    yield line
                row.clear()


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet with a header row as string columns; of several workbooks, those with the first one's header in any order.

    Only the first workbook's header is read on the driver.  A column without a name is ``_c`` and its number.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    head = files.orderBy("path").limit(1)

    def names_of(raw: bytes) -> list[str]:
        first = next(sheet_rows(raw, sheet), [])
        return [str(v).strip() if v not in (None, "") else f"_c{k}" for k, v in enumerate(first)]

    def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([names_of(raw) for raw in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["names"])

    found = head.mapInArrow(header, "names array<string>").first()
    if found is None or not found["names"]:
        raise ValueError(f"no rows in {path}")
    columns = list(found["names"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                own = names_of(raw)
                spots = [own.index(c) if c in own else -1 for c in columns]
                lines = list(sheet_rows(raw, sheet))[1:]
                yield pa.RecordBatch.from_arrays([pa.array([line[k] if 0 <= k < len(line) and line[k] != "" else None for line in lines], pa.string()) for k in spots], names=columns)

    return files.mapInArrow(rows, ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)).select(*(F.col(f"`{c.replace('`', '``')}`") for c in columns))
