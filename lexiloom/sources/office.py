"""Paragraphs, tables, headers, text boxes and sheets of DOCX and XLSX files, read from their XML.

Files are listed as binaryFile, so the cluster spreads them, and each is parsed whole in a worker with the standard
library. A file that is no such archive raises an error, or gives no rows with ``skip_broken``. Empty files of a valid
form give no rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# --- fixed values: namespaces of the formats ----------------------------------------------------------------------------
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

PARAGRAPHS = "path string, para_index int, text string, style string, outline int, is_table_cell boolean"
CELLS = "path string, table_index int, row_index int, col_index int, text string, col_span int"
MARGINS = "path string, part string, section int, type string, text string"
BOXES = "path string, textbox_index int, para_in_textbox int, text string"
ROWS = "path string, sheet_index int, sheet string, row_index int, cells array<string>"

Element = ElementTree.Element


def _xml(z: zipfile.ZipFile, name: str) -> Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Files that a part refers to, by id."""
    folder, _, name = part.rpartition("/")
    links = _xml(z, f"{folder}/_rels/{name}.rels")
    at = lambda t: t.lstrip("/") if t.startswith("/") else f"{folder}/{t}"
    return {} if links is None else {e.get("Id"): at(e.get("Target", "")) for e in links}


def _said(p: Element) -> str:
    """A paragraph's own text; text boxes anchored in it are not part of it."""
    out = []
    for r in p:
        runs = [r] if r.tag == f"{WORD}r" else r.findall(f"{WORD}r") if r.tag == f"{WORD}hyperlink" else []
        for e in (e for run in runs for e in run):
            out.append((e.text or "") if e.tag == f"{WORD}t" else "\t" if e.tag == f"{WORD}tab" else "\n" if e.tag in (f"{WORD}br", f"{WORD}cr") else "")
    return "".join(out)


def _value(e: Element | None, path: str) -> str | None:
    found = None if e is None else e.find(path)
    return None if found is None else found.get(f"{WORD}val")


def _grid(table: Element) -> list[list[tuple[str, int]]]:
    """Rows of (text, columns spanned), one entry per grid column: a merged cell stands in every place that it covers."""
    rows: list[list[tuple[str, int]]] = []
    for tr in table.findall(f"{WORD}tr"):
        row: list[tuple[str, int]] = []
        for tc in tr.findall(f"{WORD}tc"):
            mine = tc.find(f"{WORD}tcPr")
            span = int(_value(mine, f"{WORD}gridSpan") or 1)
            merge = None if mine is None else mine.find(f"{WORD}vMerge")
            below = merge is not None and merge.get(f"{WORD}val", "continue") == "continue" and rows and len(rows[-1]) > len(row)
            cell = rows[-1][len(row)] if below else ("\n".join(_said(p) for p in tc.findall(f"{WORD}p")).strip(), span)
            row += [cell] * span
        rows.append(row)
    return rows


def _body(z: zipfile.ZipFile) -> Element:
    return _xml(z, "word/document.xml").find(f"{WORD}body")


def _tables(z: zipfile.ZipFile) -> Iterator[tuple]:
    for t, table in enumerate(_body(z).findall(f"{WORD}tbl")):
        for r, row in enumerate(_grid(table)):
            yield from ((t, r, c, text, span) for c, (text, span) in enumerate(row))


def _paragraphs(z: zipfile.ZipFile) -> Iterator[tuple]:
    styles = _xml(z, "word/styles.xml")
    names = {} if styles is None else {s.get(f"{WORD}styleId"): _value(s, f"{WORD}name") for s in styles.findall(f"{WORD}style")}
    i = 0
    for i, p in enumerate(_body(z).findall(f"{WORD}p"), 1):
        mine = p.find(f"{WORD}pPr")
        style, outline = _value(mine, f"{WORD}pStyle"), _value(mine, f"{WORD}outlineLvl")
        yield i, _said(p), names.get(style) or style or "Normal", -1 if outline is None else int(outline), False
    cells = (text for *_, text, _ in _tables(z) if text)
    yield from ((i + n, text, "TABLE_CELL", -1, True) for n, text in enumerate(cells, 1))


def _margins(z: zipfile.ZipFile) -> Iterator[tuple]:
    files = _targets(z, "word/document.xml")
    for n, section in enumerate(_body(z).iter(f"{WORD}sectPr"), 1):
        for part in ("header", "footer"):
            own = {e.get(f"{WORD}type", "default"): files.get(e.get(LINK), "") for e in section.findall(f"{WORD}{part}Reference")}
            for kind in ("default", "first"):  # a section without a reference of its own goes on with the one before
                page = _xml(z, own[kind]) if kind in own else None
                texts = [] if page is None else [_said(p).strip() for p in page.findall(f"{WORD}p")]
                yield from ((part, n, kind, t) for t in texts if t)


def _boxes(z: zipfile.ZipFile) -> Iterator[tuple]:
    for b, box in enumerate(_xml(z, "word/document.xml").iter(f"{WORD}txbxContent")):
        for i, p in enumerate(box.findall(f"{WORD}p")):
            text = "".join(t.text or "" for t in p.iter(f"{WORD}t")).strip()
            if text:
                yield b, i, text


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple]:
    shared = _xml(z, "xl/sharedStrings.xml")
    strings = [] if shared is None else ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in shared.findall(f"{SHEET}si")]
    files = _targets(z, "xl/workbook.xml")
    for s, sheet in enumerate(_xml(z, "xl/workbook.xml").iter(f"{SHEET}sheet")):
        page = _xml(z, files.get(sheet.get(LINK), ""))
        for n, row in enumerate(() if page is None else page.iter(f"{SHEET}row"), 1):
            cells: list[str | None] = []
            for c in row.findall(f"{SHEET}c"):
                value, kind = c.findtext(f"{SHEET}v"), c.get("t")
                text = strings[int(value)] if kind == "s" and value else "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if kind == "inlineStr" else value
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = text
            yield s, sheet.get("name"), int(row.get("r", n)), cells


def _parsed(spark: SparkSession, path: str, kind: str, parse: Callable[[zipfile.ZipFile], Iterator[tuple]], schema: str, skip_broken: bool) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, data in zip(f["path"], f["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        rows = [(at, *r) for r in parse(z)]
                except (zipfile.BadZipFile, ElementTree.ParseError, AttributeError) as e:
                    if skip_broken:
                        continue
                    raise ValueError(f"no readable {kind} file: {at}") from e
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", True).load(path)
    return files.filter(r"path not rlike '/~[$]'").select("path", "content").mapInPandas(run, schema)


def docx_paragraphs(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """Body paragraphs, blank ones too, numbered from 1, then non-empty table cells with style TABLE_CELL."""
    return _parsed(spark, path, "docx", _paragraphs, PARAGRAPHS, skip_broken)


def docx_tables(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """A row per grid place of each table of the body, from 0; merged cells repeat and say how many columns they span."""
    return _parsed(spark, path, "docx", _tables, CELLS, skip_broken)


def docx_headers_footers(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """Non-blank lines of default and first-page headers and footers per section from 1; inherited ones are left out."""
    return _parsed(spark, path, "docx", _margins, MARGINS, skip_broken)


def docx_text_boxes(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """Non-blank paragraphs of text boxes; both numbers are from 0, and blank paragraphs count."""
    return _parsed(spark, path, "docx", _boxes, BOXES, skip_broken)


def xlsx_rows(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """Rows of every sheet with their cells as text, as the file holds it (dates are day numbers); empty cells are null."""
    return _parsed(spark, path, "xlsx", _sheets, ROWS, skip_broken)
