"""Documents to chunks: parts, ids, neighbours, overlap and splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.functions import folds
from lodestar.functions import text as T


def chunk_id(file_id: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", file_id.cast("string"), index.cast("string")), 256)


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "\n\n") -> DataFrame:
    """A row per part that isn't blank: id, chunk_index from 0, text."""
    return docs.select(id_col, F.posexplode(T.paragraphs(F.col(text_col), mark)).alias("chunk_index", "text"))


def records(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids from a hash of (file, index), so a chunk's neighbours are known without a second pass."""
    w = Window.partitionBy(id_col).orderBy("chunk_index")
    own = lambda shift: F.when(shift.isNotNull(), chunk_id(F.col(id_col), shift))
    return chunks.select("*", chunk_id(F.col(id_col), F.col("chunk_index")).alias("id"), own(F.lag("chunk_index").over(w)).alias("prev_id"), own(F.lead("chunk_index").over(w)).alias("next_id"))


def overlapped(chunks: DataFrame, n: int = folds.OVERLAP, id_col: str = "doc_id", alone: str | None = None) -> DataFrame:
    """Each chunk between the end of the one before and the start of the one after, where those are longer than ``n``, blank lines
    between them. Chunks marked in the column ``alone`` neither take nor give."""
    w = Window.partitionBy(id_col).orderBy("chunk_index")
    apart = F.lit(False) if alone is None else F.coalesce(F.col(alone), F.lit(False))
    given = F.when(~apart & (F.length("text") > n), F.col("text"))
    rows = chunks.withColumn("_apart", apart).withColumn("_before", F.lag(given).over(w)).withColumn("_after", F.lead(given).over(w))
    head = F.when(F.col("_before").isNotNull() & ~F.col("_apart"), F.concat(F.right("_before", F.lit(n)), F.lit("\n\n"))).otherwise("")
    tail = F.when(F.col("_after").isNotNull() & ~F.col("_apart"), F.concat(F.lit("\n\n"), F.left("_after", F.lit(n)))).otherwise("")
    return rows.select(id_col, "chunk_index", F.concat(head, "text", tail).alias("text"))


def folded(rows: DataFrame, column: str, fold: Callable, schema: str) -> DataFrame:
    """Each row's ``column`` through ``fold``, a function of one value that gives a list of tuples: the other columns repeat for
    each, followed by the place from 0 and the tuple's values, which ``schema`` names. Work and memory are a row's at a time."""
    others = [c for c in rows.columns if c != column]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place, values = [], [], []
            for i, x in enumerate(batch.column(len(others)).to_pylist()):
                for k, value in enumerate(fold(x)):
                    at.append(i)
                    place.append(k)
                    values.append(value)
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(len(others))]
            columns = [pa.array(list(v)) for v in zip(*values, strict=True)] if values else [pa.nulls(0)] * len(names)
            whole = pa.Table.from_arrays([*kept, pa.array(place, pa.int32()), *columns], names=[*others, "place", *names])
            yield from whole.cast(target).to_batches() if values else []

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)
    out = f"{kinds}, place int, {schema}"
    target = to_arrow_schema(rows.sparkSession.createDataFrame([], out).schema)
    return rows.select(*others, column).mapInArrow(run, out)


def policy(file_type: Column, has_markdown: Column, has_headers: Column) -> Column:
    """(splitter, merge): how a file's text is cut, and whether short neighbours are put together afterwards."""
    marked = file_type.isin("pdf", "docx", "pptx", "md") & has_markdown
    splitter = F.when(file_type == "excel", "sheet").when(marked, "markdown").when(file_type == "pdf", "pages")
    splitter = splitter.when(file_type.isin("docx", "pptx", "txt", "md"), "paragraphs").otherwise("none")
    merge = F.when(splitter == "markdown", ~has_headers & (file_type == "md")).when(splitter == "paragraphs", (file_type != "md") | ~has_headers)
    return F.struct(splitter.alias("splitter"), F.coalesce(merge, F.lit(False)).alias("merge"))


def split(docs: DataFrame, limit: int = folds.MAX_CHUNK, id_col: str = "doc_id", text_col: str = "text", overlap: int = folds.OVERLAP) -> DataFrame:
    """Recursive split of each text, packed parts overlapping; nothing visible is lost. Null and blank texts give no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, k, chunk) for i, text in enumerate(batch.column(1).to_pylist()) for k, chunk in enumerate(folds.recursive_split(text or "", limit, overlap=overlap))]
            row, index, text = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(index, pa.int32()), pa.array(text, pa.string())], names=[id_col, "chunk_index", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, text string")


def sheet_summary(name: Column, n_rows: Column, columns: list[str], summary: Column) -> Column:
    """A sheet's chunk: its name, size, columns and summary, or that there is none."""
    listed = " | ".join(columns) if columns else "（无）"
    size = F.concat(F.lit("规模："), n_rows.cast("string"), F.lit(f" 行 × {len(columns)} 列"))
    return F.concat_ws("\n", F.concat(F.lit("# "), name), size, F.lit(f"列名：{listed}"), F.concat(F.lit("摘要："), F.coalesce(F.nullif(summary, F.lit("")), F.lit("（未生成）"))))


def sheet_preview(rows: DataFrame, sheet: str, order: str, cells: str, header: list[str], most: int = 200) -> DataFrame:
    """(sheet, preview): the first rows of each sheet as a Markdown table, with a note where there are more."""
    escaped = F.transform(cells, lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    line = F.concat(F.lit("| "), F.array_join(escaped, " | "), F.lit(" |"))
    place = F.row_number().over(Window.partitionBy(sheet).orderBy(order))
    counts = rows.groupBy(sheet).agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("k", place).filter(F.col("k") <= most).groupBy(sheet).agg(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("l"))
    head = "| " + " | ".join(header) + " |\n|" + "|".join(["---"] * len(header)) + "|\n"
    note = F.when(F.col("n") > most, F.concat(F.lit(f"\n\n_（仅展示前 {most} 行，原始共 "), F.col("n").cast("string"), F.lit(" 行）_"))).otherwise("")
    return first.join(counts, sheet).select(sheet, F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), note).alias("preview"))


def column_portraits(sheet: DataFrame, order: str, columns: list[str], name: str, examples: int = 5) -> DataFrame:
    """(name, chunk) of each column: its kind, filled and distinct values, the first distinct ones, and for numbers their range.

    All columns are profiled in one pass over (column, value) pairs: values are counted once each, so that a column's
    summary works on distinct values.
    """
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(c, F.lit("")).alias("v")) for c in columns])).alias("p")
    values = sheet.select(order, pair).groupBy("p.name", "p.v").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    held, number = F.col("v") != "", F.expr("try_cast(nullif(v, '') AS double)")
    profile = values.groupBy("name").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("held"), F.count_if(held).alias("distinct"),
        F.coalesce(F.sum(F.when(number.isNotNull(), F.col("n"))), F.lit(0)).alias("numbers"), F.min(number).alias("low"), F.max(number).alias("high"),
        (F.sum(number * F.col("n")) / F.sum(F.when(number.isNotNull(), F.col("n")))).alias("mean"),
    )
    place = F.row_number().over(Window.partitionBy("name").orderBy("first"))
    shown = F.when(F.length("v") <= 60, F.col("v")).otherwise(F.concat(F.left("v", F.lit(57)), F.lit("...")))
    first = values.filter(held).withColumn("k", place).filter(F.col("k") <= examples).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("k", shown.alias("v")))).alias("e"))
    numeric = (F.col("held") > 0) & (F.col("numbers") >= 0.8 * F.col("held"))
    kind = F.when(numeric, "numeric").when((F.col("distinct") > 0) & (F.col("distinct") <= F.greatest(F.lit(20), F.floor(0.1 * F.col("held")))), "categorical").otherwise("text")
    whole = F.concat(F.lit("类型："), kind, F.lit("；非空："), F.col("held").cast("string"), F.lit("/"), F.col("rows").cast("string"), F.lit("；唯一值："), F.col("distinct").cast("string"))
    listed = F.when(F.size("e") > 0, F.concat(F.lit("示例："), F.array_join(F.transform("e", lambda x: x["v"]), " | ")))
    span = F.when(numeric, F.concat(F.lit("统计：min="), T.number_text(F.col("low")), F.lit(" max="), T.number_text(F.col("high")), F.lit(" mean="), T.mean_text(F.col("mean"))))
    return profile.join(first, "name", "left").select("name", F.concat_ws("\n", F.concat(F.lit(f"# {name}."), "name"), whole, listed, span).alias("chunk"))


def audio_text(transcript: Column, description: Column) -> Column:
    both = F.concat(F.coalesce(transcript, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit("")))
    return F.coalesce(F.nullif(F.regexp_replace(both, r"^[ \n]+|[ \n]+$", ""), F.lit("")), F.lit("音频文件"))


def frames_every(frames: Column, fps: Column, seconds: int) -> Column:
    """Numbers of the frames at a fixed interval."""
    step = F.greatest(F.lit(1), F.floor(fps * seconds).cast("int"))
    return F.when(frames > 0, F.sequence(F.lit(0), frames.cast("int") - 1, step))


def attachment_block(items: DataFrame, key: str, place: str, kind: str, name: str, summary: str, most: int = 3, each: int = 300, cap: int = 900) -> DataFrame:
    """(key, block): a labelled line for each of a message's first attachments, cut with an ellipsis."""
    label = F.when(F.col(kind) == "image", "图片").otherwise("音频")
    line = F.concat(F.lit("[附件"), F.col(place).cast("string"), F.lit(" "), label, F.lit(" "), F.col(name), F.lit("] "), F.left(summary, F.lit(each)))
    lines = items.filter(F.col(place) <= most).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place, line.alias("line")))).alias("l"))
    return lines.select(key, T.trimmed(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), cap).alias("block"))


def topic_digest(items: DataFrame, key: str, place: str, title: Column, url: Column, content: Column, day: str, cap: int = 2000) -> DataFrame:
    """(key, digest): search results as Markdown sections with their source and the beginning of their text."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), r"^[ \n]+|[ \n]+$", "")
    cut = F.when(F.length(text) > cap, F.concat(F.left(text, F.lit(cap)), F.lit("..."))).otherwise(text)
    head = F.concat(F.lit("## "), F.col(place).cast("string"), F.lit(". "), title)
    source = F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("来源：["), title, F.lit("]("), url, F.lit(")")))
    section = F.concat(F.concat_ws("\n\n", head, source, F.nullif(cut, F.lit(""))), F.lit("\n"))
    sections = items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place, section.alias("s")))).alias("l"))
    return sections.select(key, F.concat(F.lit(f"# 每日热点摘要 {day}\n\n"), F.array_join(F.transform("l", lambda x: x["s"]), "\n")).alias("digest"))


def page_score(title: Column, body: Column) -> Column:
    """What a candidate for a page's text is worth beside its base: length, title, headers."""
    held = F.length(body)
    marks = F.when(F.contains(body, F.lit("# ")), 20).otherwise(0) + F.when(F.contains(body, F.lit("## ")), 15).otherwise(0)
    return F.least(F.floor(held / 160), F.lit(140)) + F.when(F.coalesce(title, F.lit("")) != "", 30).otherwise(0) + marks
