"""Parsed files as a table: ``spark.read.format("parsed_files").load(folder)``.

A row is a part of a file: a paragraph, a table row, a sheet's row, a slide's text, or what a header says. Tasks get files
of about ``partition_bytes`` together. Conditions on ``path`` and ``file_type`` choose files before any is opened. A
file of an unsupported type, or one that its parser refuses, is a row with an ``error``.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from lodestar.sources import files, media, office

SCHEMA = "path string, file_type string, file_size long, part int, kind string, name string, number long, text string, cells array<string>, info map<string,string>, error string"
_FIELDS = ("kind", "name", "number", "text", "cells", "info")
PARTITION_BYTES = 64 << 20

#: Extensions of each type, and what files of a type begin with.
EXTENSIONS = {
    "pdf": ["pdf"], "docx": ["docx"], "doc": ["doc"], "pptx": ["pptx"], "txt": ["txt"], "md": ["md", "markdown"], "excel": ["xlsx", "xls", "csv"],
    "image": ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif"], "audio": ["mp3", "wav", "m4a", "flac", "aac", "ogg", "wma", "opus"],
    "video": ["mp4", "avi", "mov", "mkv", "webm", "flv", "wmv", "m4v"],
}
STARTS = {"pdf": [b"%PDF"], "image": [b"\xff\xd8\xff", b"\x89PNG", b"GIF", b"BM", b"II*\0", b"MM\0*", b"II\0*", b"MM*\0"]}


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rpartition(".")[2].lower() if "." in name.strip(".") else ""


def type_by_name(path: str) -> str | None:
    own = extension(path)
    return next((kind for kind, known in EXTENSIONS.items() if own in known), None)


def file_type(path: str, start: bytes) -> str:
    """By extension, then by the first bytes, else ``unknown``."""
    if kind := type_by_name(path):
        return kind
    if start[:4] == b"RIFF" and start[8:12] == b"WEBP":
        return "image"
    return next((kind for kind, heads in STARTS.items() if start.startswith(tuple(heads))), "unknown")


def _lines(content: bytes) -> str:
    return content.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")


def parse_text(content: bytes, path: str) -> Iterator[dict]:
    for n, p in enumerate(x.strip() for x in _lines(content).split("\n\n") if x.strip()):
        yield {"kind": "paragraph", "number": n + 1, "text": p}


def parse_markdown(content: bytes, path: str) -> Iterator[dict]:
    """The whole text, each line that begins with ``#`` as a header, and each fenced block."""
    text = _lines(content)
    yield {"kind": "content", "text": text}
    fenced, block, blocks = False, [], 0
    for n, line in enumerate(text.split("\n"), 1):
        if line.startswith("#"):
            yield {"kind": "header", "name": str(len(line) - len(line.lstrip("#"))), "number": n, "text": line.lstrip("#").strip()}
        if line.strip().startswith("```"):
            if fenced and block:
                blocks += 1
                yield {"kind": "code", "number": blocks, "text": "\n".join(block)}
                block = []
            fenced = not fenced
        elif fenced:
            block.append(line)
    if block:
        yield {"kind": "code", "number": blocks + 1, "text": "\n".join(block)}


def parse_sheet(content: bytes, path: str) -> Iterator[dict]:
    """Each sheet's header, then its rows by their number in the sheet."""
    own = extension(path)
    if own == "xls":
        raise ValueError("binary workbooks of the old kind can't be read")
    if own == "csv":
        import csv

        csv.field_size_limit(1 << 30)
        text = content.decode(files.encoding_of(content))
        rows = ((0, "Sheet1", n, cells) for n, cells in enumerate((r for r in csv.reader(io.StringIO(text, newline="")) if r), 1))
    else:
        rows = office.workbook_rows(content)
    sheet, names = None, []
    for number, name, at, cells in rows:
        if number != sheet:
            sheet, names = number, office.header_names(cells, len(cells))
            yield {"kind": "headers", "name": name, "number": at, "cells": names}
        else:
            yield {"kind": "row", "name": name, "number": at, "cells": cells + [""] * (len(names) - len(cells))}


def parse_document(content: bytes, path: str) -> Iterator[dict]:
    for n, (kind, style, what) in enumerate(office.document_parts(content), 1):
        if kind == "paragraph":
            yield {"kind": kind, "name": style, "number": n, "text": what}
        else:
            for cells in what:
                yield {"kind": "table_row", "number": n, "cells": cells}


def parse_slides(content: bytes, path: str) -> Iterator[dict]:
    for slide, text in office.slide_texts(content):
        yield {"kind": "paragraph", "name": f"slide {slide}", "number": slide, "text": text}


def _told(info: dict) -> dict:
    return {"kind": "info", "info": {k: None if v is None else str(v) for k, v in info.items()}}


def parse_image(content: bytes, path: str) -> Iterator[dict]:
    yield _told(media.image_info(io.BytesIO(content)))


def parse_audio(content: bytes, path: str) -> Iterator[dict]:
    yield _told(media.audio_info(io.BytesIO(content), extension(path)))


def parse_video(content: bytes, path: str) -> Iterator[dict]:
    yield _told(media.video_info(io.BytesIO(content), extension(path)))


Parser = Callable[[bytes, str], Iterator[dict]]
PARSERS: dict[str, Parser] = {
    "txt": parse_text, "md": parse_markdown, "excel": parse_sheet, "docx": parse_document, "pptx": parse_slides, "image": parse_image, "audio": parse_audio,
    "video": parse_video,
}


def register_parser(kind: str, parser: Parser, extensions: list[str] | None = None) -> None:
    """``parser(content, path)`` gives dictionaries with some of the fields kind, name, number, text, cells, info."""
    PARSERS[kind] = parser
    if extensions:
        EXTENSIONS[kind] = [e.lower().lstrip(".") for e in extensions]


def get_parser(kind: str) -> Parser | None:
    return PARSERS.get(kind)


def supported_types() -> list[str]:
    return list(PARSERS)


def rows_of(path: str, kind: str, size: int, content: bytes, parsers: dict[str, Parser]) -> Iterator[tuple]:
    """A file's rows; what its parser gave before it failed stays, and the error follows."""
    part = -1
    parser = parsers.get(kind)
    try:
        if parser is None:
            raise ValueError(f"unsupported type {kind}")
        for part, row in enumerate(parser(content, path)):
            yield (path, kind, size, part, *(row.get(f) for f in _FIELDS), None)
    except Exception as e:  # noqa: BLE001  any failure of a parser is the file's, told in its row
        yield (path, kind, size, part + 1, "error", None, None, None, None, None, f"{type(e).__name__}: {e}")


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]] = field(default_factory=list)


class Reader(DataSourceReader):
    def __init__(self, options, parsers: dict[str, Parser], extensions: dict[str, list[str]]):
        self.path, self.parsers, self.known = options.get("path", ""), parsers, extensions
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.paths, self.types, self.prefixes = None, None, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            own = getattr(f, "attribute", None)
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if own == ("path",) and values is not None:
                self.paths = values if self.paths is None else self.paths & values
            elif own == ("file_type",) and values is not None:
                self.types = values if self.types is None else self.types & values
            elif own == ("path",) and isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            yield f  # Spark holds rows against all of them once more

    def _filesystem(self):
        scheme = re.match(r"([a-z0-9+.-]+):", self.path)
        return fs.FileSystem.from_uri(self.path) if scheme else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Files]:
        system, root = self._filesystem()
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [Files()], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            own = next((kind for kind, known in self.known.items() if extension(f.path) in known), None)
            if self.paths is not None and f.path not in self.paths or any(not f.path.startswith(p) for p in self.prefixes) or self.types is not None and own and own not in self.types:
                continue
            if out[-1].files and size + f.size > self.partition_bytes:
                out.append(Files())
                size = 0
            out[-1].files.append((f.path, f.size))
            size += f.size
        return [p for p in out if p.files]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self._filesystem()
        schema = pa.schema([
            ("path", pa.string()), ("file_type", pa.string()), ("file_size", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("name", pa.string()),
            ("number", pa.int64()), ("text", pa.string()), ("cells", pa.list_(pa.string())), ("info", pa.map_(pa.string(), pa.string())), ("error", pa.string()),
        ])
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [[list(x.items()) if isinstance(x, dict) else x for x in c] for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for path, size in partition.files:
            with system.open_input_file(path) as f:
                kind = next((k for k, known in self.known.items() if extension(path) in known), None) or file_type(path, f.read(16))
                if self.types is not None and kind not in self.types:
                    continue
                f.seek(0)
                content = f.read() if kind in self.parsers else b""
            for row in rows_of(path, kind, size, content, self.parsers):
                held.append(row)
                if len(held) >= 2048:
                    yield batch()
                    held = []
        if held:
            yield batch()


class ParsedFiles(DataSource):
    """Options: ``path`` (a folder or file, local or of a file system that Arrow knows), ``partition_bytes``."""

    parsers: dict[str, Parser] = {}
    extensions: dict[str, list[str]] = {}

    @classmethod
    def name(cls) -> str:
        return "parsed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options, self.parsers, self.extensions)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with the parsers that are registered now, and let conditions reach it."""
    own = type("ParsedFiles", (ParsedFiles,), {"parsers": dict(PARSERS), "extensions": {k: list(v) for k, v in EXTENSIONS.items()}})
    spark.dataSource.register(own)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, **options):
    register(spark)
    return spark.read.format("parsed_files").options(**options).load(path)
