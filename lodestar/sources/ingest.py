"""From a folder of text files to the points of a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import folds
from lodestar.operators import chunks
from lodestar.session import saved
from lodestar.sources import files, parsed


def text_points(found: DataFrame, kb_id: str) -> DataFrame:
    """Chunks of the text files among ``found`` (path, content) as rows of ``files.POINT``; the vectors are still to be given."""
    typed = found.filter(files.file_type(F.col("path"), F.col("content")).isin("txt", "markdown"))
    docs = typed.select(F.sha2("path", 256).alias("file_id"), T.newlines(files.decoded("content")).alias("text"))
    cut = chunks.split(docs, id_col="file_id")
    return cut.select(
        chunks.chunk_id(F.col("file_id"), F.col("chunk_index")).alias("id"), F.lit(kb_id).alias("kb_id"), "file_id", F.col("file_id").alias("source_file_id"),
        "chunk_index", F.col("text").alias("text_content"), F.lit(None).cast("array<float>").alias("vec"),
    )


def upload(spark: SparkSession, source: str, path: str, kb_id: str, max_files: int | None = None, **kw) -> None:
    """Read a folder, cut its texts and let the knowledge base hold exactly them, none if the folder has none: a repeated upload
    changes nothing. Every file is read unless ``max_files`` says otherwise."""
    files.replace_kbs(text_points(files.folder(spark, source, max_files=max_files, **kw), kb_id), path, kbs=[kb_id])


def _file_chunks(parts: list[dict] | None) -> list[tuple[str]]:
    """The chunks of one parsed file: Markdown by its parts, sheets by blocks of rows under their header, all else by paragraphs."""
    out: list[str] = []
    sheets: dict[str, tuple[list[str], list[list[str]]]] = {}
    texts: list[str] = []
    for p in parts or []:
        if p["kind"] == "content":
            out += [c for part in folds.markdown_parts(p["text"]) for c in folds.recursive_split(part, folds.MAX_CHUNK)]
        elif p["kind"] == "headers":
            sheets[p["name"]] = p["cells"], []
        elif p["kind"] == "row":
            sheets[p["name"]][1].append(p["cells"])
        elif p["kind"] == "paragraph":
            texts.append(p["text"])
        elif p["kind"] == "table_row":
            texts.append(" | ".join(p["cells"]))
    for name, (header, rows) in sheets.items():
        out += [f"# {name}\n{block}" for _, _, block in folds.row_blocks(header, rows, folds.MAX_CHUNK)]
    out += [c for text in folds.pack_parts(texts, folds.MERGE) for c in folds.recursive_split(text, folds.MAX_CHUNK)]
    return [(c,) for c in out if c.strip()]


def parsed_points(rows: DataFrame, kb_id: str) -> DataFrame:
    """Chunks of the files among parsed ``rows`` as rows of ``files.POINT``. A file's rows are put together as the file itself was."""
    part = F.struct("part", "kind", "name", "text", "cells")
    held = rows.filter(F.col("error").isNull()).groupBy("path").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    cut = chunks.folded(held.select(F.sha2("path", 256).alias("file_id"), "parts"), "parts", _file_chunks, "text_content string")
    return cut.select(
        chunks.chunk_id(F.col("file_id"), F.col("place")).alias("id"), F.lit(kb_id).alias("kb_id"), "file_id", F.col("file_id").alias("source_file_id"),
        F.col("place").alias("chunk_index"), "text_content", F.lit(None).cast("array<float>").alias("vec"),
    )


def upload_folder(spark: SparkSession, source: str, path: str, kb_id: str, **options) -> DataFrame:
    """Read a folder of files of any known type and let the knowledge base hold exactly their chunks.

    Returns a row per file: ``path``, ``file_type``, ``file_size``, ``chunks``, ``info`` of media, ``error``. A file that can't be read takes
    no other down with it.
    """
    rows = saved(parsed.read(spark, source, **options), "parsed")
    points = saved(parsed_points(rows, kb_id), "points")
    files.replace_kbs(points, path, kbs=[kb_id])
    counts = points.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
    each = rows.groupBy("path", "file_type", "file_size").agg(F.max_by("info", F.when(F.col("kind") == "info", 1)).alias("info"), F.max("error").alias("error"))
    report = each.withColumn("file_id", F.sha2("path", 256)).join(counts, "file_id", "left").fillna(0, ["chunks"])
    return report.select("path", "file_type", "file_size", "chunks", "info", "error")
