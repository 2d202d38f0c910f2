"""Workbooks, documents and slides from their zip entries, as streams of XML events.

Every function takes a file's bytes. A damaged file raises ``ValueError``.
"""

from __future__ import annotations

import io
import math
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

#: Number formats that stand for dates and times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_DATE_LETTER = re.compile(r"[dmhysDMHYS]")
_NO_LETTER = re.compile(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]|_.|\*.', re.IGNORECASE)
_CELL = re.compile(r"([A-Z]+)([0-9]+)")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _named(attributes: dict, name: str) -> str | None:
    return next((v for k, v in attributes.items() if _local(k) == name), None)


class Package:
    """A zip of XML parts."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise ValueError(f"no zip file: {e}") from e
        self.names = set(self.zip.namelist())

    def events(self, name: str, ends: set[str]) -> Iterator[ET.Element]:
        """The elements of these local names as they end; what has been given is forgotten."""
        if name not in self.names:
            return
        try:
            with self.zip.open(name) as part:
                depth: list[ET.Element] = []
                for event, element in ET.iterparse(part, ("start", "end")):
                    if event == "start":
                        depth.append(element)
                        continue
                    depth.pop()
                    if _local(element.tag) in ends:
                        yield element
                        element.clear()
                        if depth:
                            depth[-1].remove(element)
        except (ET.ParseError, zipfile.BadZipFile, zlib.error, EOFError) as e:
            raise ValueError(f"{name} is damaged: {e}") from e

    def relations(self, part: str) -> dict[str, str]:
        """Relation id -> name of the part it points at."""
        folder, name = posixpath.split(part)
        found = {}
        for r in self.events(f"{folder}/_rels/{name}.rels".lstrip("/"), {"Relationship"}):
            target = r.get("Target", "")
            found[r.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        return found


def _text(element: ET.Element, skip: tuple[str, ...] = ("rPh", "phoneticPr")) -> str:
    """The text of all ``t`` below, in order, without readings."""
    if _local(element.tag) in skip:
        return ""
    return "".join([element.text or ""] if _local(element.tag) == "t" else [_text(child, skip) for child in element])


def _is_date(code: str) -> bool:
    return bool(_DATE_LETTER.search(_NO_LETTER.sub("", code))) and code.lower() != "general"


def _date_styles(package: Package) -> list[bool]:
    """For each cell style whether it shows a date."""
    codes, styles = {}, []
    for e in package.events("xl/styles.xml", {"numFmt", "cellXfs"}):
        if _local(e.tag) == "numFmt":
            codes[int(e.get("numFmtId", 0))] = e.get("formatCode", "")
        else:
            styles = [int(x.get("numFmtId", 0)) for x in e]
    return [n in DATE_FORMATS or _is_date(codes.get(n, "")) for n in styles]


def _number(text: str, is_date: bool, first_day: datetime) -> str:
    value = float(text)
    if is_date and math.isfinite(value) and abs(value) < 3e6:
        if 0 <= value < 1:
            return str((datetime.min + timedelta(seconds=round(value * 86_400))).time())
        # the calendar counts a 29 February 1900, so days before it lie one further on
        return str(first_day + timedelta(days=int(value) + (value < 60 and first_day.year == 1899), seconds=round(value % 1 * 86_400)))
    return str(int(value)) if math.isfinite(value) and value == int(value) else repr(value)


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook_rows(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet, its name, row number from 1, cells) of every row of every sheet, all cells as text.

    Empty cells, and all cells of a merged range but its first, are empty text; rows without a cell are left out. Whole
    numbers have no point, dates are ISO, truth values ``True`` and ``False``, errors empty.
    """
    package = Package(content)
    if "xl/workbook.xml" not in package.names:
        raise ValueError("no workbook inside")
    shared = [_text(e) for e in package.events("xl/sharedStrings.xml", {"si"})]
    dates, parts, sheets, first_day = _date_styles(package), package.relations("xl/workbook.xml"), [], datetime(1899, 12, 30)
    for e in package.events("xl/workbook.xml", {"sheet", "workbookPr"}):
        if _local(e.tag) == "sheet":
            sheets.append((e.get("name", ""), parts.get(_named(e.attrib, "id") or "", "")))
        elif e.get("date1904") in ("1", "true"):
            first_day = datetime(1904, 1, 1)

    def shown(cell: ET.Element) -> str:
        kind, value = cell.get("t", "n"), next((x.text for x in cell if _local(x.tag) == "v"), None)
        if kind == "inlineStr":
            return "".join(_text(x) for x in cell if _local(x.tag) == "is")
        if value is None or kind == "e":
            return ""
        if kind == "s":
            return shared[int(value)] if int(value) < len(shared) else ""
        if kind == "b":
            return str(value == "1")
        if kind != "n":
            return value
        style = int(cell.get("s", 0))
        return _number(value, style < len(dates) and dates[style], first_day)

    for number, (name, part) in enumerate(sheets):
        at = 0
        for row in package.events(part, {"row"}):
            at = int(row.get("r", at + 1))
            cells: list[str] = []
            for cell in row:
                if _local(cell.tag) != "c":
                    continue
                place = _CELL.fullmatch(cell.get("r", ""))
                column = column_number(place[1]) if place else len(cells)
                cells += [""] * (column - len(cells))
                cells.append(shown(cell))
            while cells and not cells[-1]:
                cells.pop()
            if cells:
                yield number, name, at, cells


def header_names(cells: list[str], width: int) -> list[str]:
    """Names of ``width`` columns from a sheet's first row: empty ones are numbered, repeated ones told apart."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i in range(width):
        name = cells[i] if i < len(cells) and cells[i] else f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def _run_text(paragraph: ET.Element) -> str:
    out = []
    for e in paragraph.iter():
        name = _local(e.tag)
        if name == "t":
            out.append(e.text or "")
        elif name in ("tab", "br", "cr") and (name != "tab" or "pos" not in {_local(k) for k in e.attrib}):
            out.append("\t" if name == "tab" else "\n")
    return "".join(out)


def document_parts(content: bytes) -> Iterator[tuple[str, str | None, list[list[str]] | str]]:
    """("paragraph", style, text) and ("table", None, rows) of a document's body, in order; blank paragraphs are left out.

    A cell over several columns stands in each of them, one that goes on from the row above has its text.
    """
    package = Package(content)
    if "word/document.xml" not in package.names:
        raise ValueError("no document inside")
    styles = {}
    for e in package.events("word/styles.xml", {"style"}):
        name = next((x for x in e if _local(x.tag) == "name"), None)
        styles[_named(e.attrib, "styleId")] = _named(name.attrib, "val") if name is not None else None

    def properties(e: ET.Element, of: str) -> dict[str, str | None]:
        return {_local(x.tag): _named(x.attrib, "val") for p in e if _local(p.tag) == of for x in p}

    for body in package.events("word/document.xml", {"body"}):
        for e in body:
            if _local(e.tag) == "p":
                text = _run_text(e).strip()
                if text:
                    yield "paragraph", styles.get(properties(e, "pPr").get("pStyle")) or "Normal", text
            elif _local(e.tag) == "tbl":
                rows: list[list[str]] = []
                for row in (x for x in e if _local(x.tag) == "tr"):
                    cells: list[str] = []
                    for cell in (x for x in row if _local(x.tag) == "tc"):
                        of = properties(cell, "tcPr")
                        text = "\n".join(_run_text(p) for p in cell if _local(p.tag) == "p").strip()
                        if "vMerge" in of and of["vMerge"] != "restart" and rows and len(cells) < len(rows[-1]):
                            text = rows[-1][len(cells)]
                        cells += [text] * int(of.get("gridSpan") or 1)
                    rows.append(cells)
                yield "table", None, rows


def slide_texts(content: bytes) -> Iterator[tuple[int, str]]:
    """(slide from 1, text) of each shape that has text, slides in the order in which they are shown."""
    package = Package(content)
    if "ppt/presentation.xml" not in package.names:
        raise ValueError("no presentation inside")
    parts = package.relations("ppt/presentation.xml")
    slides = [parts.get(_named({k: v for k, v in e.attrib.items() if "}" in k}, "id") or "", "") for e in package.events("ppt/presentation.xml", {"sldId"})]
    for number, part in enumerate(slides, 1):
        for tree in package.events(part, {"spTree"}):
            for shape in (x for x in tree if _local(x.tag) == "sp"):
                for body in (x for x in shape if _local(x.tag) == "txBody"):
                    text = "\n".join(_run_text(p) for p in body if _local(p.tag) == "p").strip()
                    if text:
                        yield number, text
