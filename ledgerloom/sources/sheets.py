"""Workbooks and HTML tables as rows of cells. Files come as (file, content), content binary, as Spark's binaryFile reader gives them from any store.

A workbook is read in one task, by the standard library's zip and XML readers, a sheet's rows one after another. HTML is cut by expressions.
"""

from __future__ import annotations

import functools
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = "file string, sheet string, row_no long, cells array<string>, fault string"
#: Rows of a sheet in one Arrow batch, and cells that one merged range may fill.
BATCH, MOST_MERGED = 1_000, 100_000
#: Bytes of a sheet that is parsed as a whole; a larger one is read as a stream.
WHOLE = 1 << 20
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(letters: str) -> int:
    out = 0
    for c in letters:
        out = out * 26 + ord(c) - 64
    return out - 1


@functools.lru_cache(1 << 14)
def _spot(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", ref.replace("$", "")).groups()
    return int(digits), column_number(letters)


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _nodes(book: zipfile.ZipFile, part: str, small: ElementTree.Element | None, name: str) -> Iterator[ElementTree.Element]:
    """The elements of one name of a sheet, from its tree if it is small; rows of a stream are emptied behind the reader."""
    if small is not None:
        yield from small.iter(f"{_MAIN}{name}")
        return
    with book.open(part) as held:
        for _, node in ElementTree.iterparse(held):
            if node.tag == f"{_MAIN}{name}":
                yield node
            if node.tag == f"{_MAIN}row":
                node.clear()


def _merged(nodes: Iterator[ElementTree.Element]) -> dict[tuple[int, int], tuple[int, int]]:
    """Each cell of a merged range but its first, with that first one."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for node in nodes:
        first, _, last = node.get("ref").partition(":")
        (top, left), (bottom, right) = _spot(first), _spot(last or first)
        if (bottom - top + 1) * (right - left + 1) <= MOST_MERGED:
            out.update({(r, c): (top, left) for r in range(top, bottom + 1) for c in range(left, right + 1) if (r, c) != (top, left)})
    return out


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells) of every filled row of every sheet; the cells of a merged range all have the value of its first."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(_REL)].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        small = ElementTree.fromstring(book.read(part)) if book.getinfo(part).file_size <= WHOLE else None
        merged = _merged(_nodes(book, part, small, "mergeCell"))
        firsts, values = set(merged.values()), {}
        filled: dict[int, list[int]] = {}
        for r, c in merged:
            filled.setdefault(r, []).append(c)
        at = 0
        for node in _nodes(book, part, small, "row"):
            at = int(node.get("r") or at + 1)
            cells: dict[int, str] = {}
            for k, c in enumerate(node.iter(f"{_MAIN}c")):
                col = _spot(c.get("r"))[1] if c.get("r") else k
                value, kind = c.find(f"{_MAIN}v"), c.get("t")
                text = _text(c) if kind == "inlineStr" else value.text if value is not None else None
                if text is not None:
                    cells[col] = shared[int(text)] if kind == "s" else text
            for col in cells:
                if (at, col) in firsts:
                    values[at, col] = cells[col]
            for col in filled.get(at, ()):
                if col not in cells and merged[at, col] in values:
                    cells[col] = values[merged[at, col]]
            if cells:
                yield sheet.get("name"), at, [cells.get(k) for k in range(max(cells) + 1)]


def workbooks(files: DataFrame) -> DataFrame:
    """Rows of CELLS of all sheets of (file, content); a file that is no workbook gives one row with its fault."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "sheet", "row_no", "cells", "fault"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for sheet, at, cells in workbook_rows(content.as_py() or b""):
                        rows.append((file, sheet, at, cells, None))
                        if len(rows) >= BATCH:
                            yield table(rows)
                            rows = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, AttributeError) as fault:
                    rows.append((file, None, None, None, type(fault).__name__))
        if rows:
            yield table(rows)

    return files.select("file", F.col("content").cast("binary").alias("content")).mapInArrow(run, CELLS)


def workbook_bytes(sheet: str, rows: list[list[str | None]], merges: list[str] | None = None) -> bytes:
    """A workbook of one sheet with texts in line; merges are ranges such as A1:B2."""

    def letters(k: int) -> str:
        return (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)

    body = "".join(f'<row r="{r}">' + "".join(f'<c r="{letters(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for k, v in enumerate(cells) if v is not None) + "</row>" for r, cells in enumerate(rows, 1))
    merged = f'<mergeCells count="{len(merges)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in merges) + "</mergeCells>" if merges else ""
    main, rel = _MAIN.strip("{}"), "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    types = "http://schemas.openxmlformats.org/package/2006/content-types"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{types}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData>{merged}</worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            # deflating a few hundred bytes costs more than it saves
            book.writestr(name, text, zipfile.ZIP_STORED if len(text) < 512 else None)
    return out.getvalue()


def unescaped(x: Column) -> Column:
    """Text of HTML without tags, with its commonest entities and single blanks."""
    x = F.regexp_replace(x, r"(?s)<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def html_rows(pages: DataFrame, key: str, html: str, table: str = "table", row: str = "tr", cell: str = "t[dh]") -> DataFrame:
    """(key, table_no, row_no, cells) of each table, or other list of elements, that holds none of its own kind; numbers are from 0.

    Comments and scripts are taken out first. A row without a cell is its own cell, so lists are read with an empty `cell`.
    """
    bare = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")

    def elements(x: Column, name: str) -> Column:
        return F.regexp_extract_all(x, F.lit(rf"(?is)<{name}(?:\s[^>]*)?>(.*?)(?:</{name}>|(?=<{name}[\s>])|$)"), F.lit(1))

    tables = pages.select(key, F.posexplode(F.regexp_extract_all(bare, F.lit(rf"(?is)<{table}(?:\s[^>]*)?>(.*?)</{table}>"), F.lit(1))).alias("table_no", "t"))
    rows = tables.select(key, "table_no", F.posexplode(elements(F.col("t"), row)).alias("row_no", "r"))
    cells = F.transform(elements(F.col("r"), cell), unescaped) if cell else F.array(unescaped(F.col("r")))
    return rows.select(key, F.col("table_no").cast("long").alias("table_no"), F.col("row_no").cast("long").alias("row_no"), cells.alias("cells"))
