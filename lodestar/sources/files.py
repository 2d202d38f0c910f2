"""Reading folders, tables and files, and writing, replacing and deleting points."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import text

#: What a file starts with (hexadecimal) and its type; types by extension.
MAGIC = [("25504446", "pdf"), ("FFD8FF", "image"), ("89504E47", "image"), ("47494638", "image"), ("424D", "image"), ("49492A00", "image"), ("4D4D002A", "image"), ("4949002A", "image"), ("4D4D2A00", "image")]
TYPES = {"pdf": "pdf", "docx": "docx", "doc": "doc", "pptx": "pptx", "txt": "txt", "md": "markdown", "csv": "sheet", "xlsx": "sheet", "xls": "sheet"}
ENCODINGS = ["utf-8", "utf-8-sig", "gbk", "gb18030", "latin-1"]

POINT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kb_id", T.StringType()), T.StructField("file_id", T.StringType()), T.StructField("source_file_id", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()), T.StructField("text_content", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType())),
])

PARSERS: dict = {}


def register_parser(kind: str, parser) -> None:
    """``parser(files: DataFrame) -> DataFrame`` for files of that type."""
    PARSERS[kind] = parser


def parse_files(files: DataFrame) -> dict[str, DataFrame]:
    """Each registered type's files through its parser."""
    typed = files.withColumn("file_type", file_type(F.col("path"), F.col("content")))
    return {kind: parser(typed.filter(F.col("file_type") == kind)) for kind, parser in PARSERS.items()}


def file_type(path: Column, content: Column) -> Column:
    """By extension, then by the first bytes, else unknown."""
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[text.extension(path)]
    media = F.when(text.modality(path) != "doc", text.modality(path))
    start = F.hex(F.substring(content, 1, 12))
    magic = F.when(start.startswith("52494646") & F.substring(start, 17, 8).eqNullSafe("57454250"), "image")
    for head, kind in MAGIC:
        magic = magic.when(start.startswith(head), kind)
    return F.coalesce(known, media, magic, F.lit("unknown"))


def folder(spark: SparkSession, path: str, extensions: list[str] | None = None, exclude: list[str] | None = None, max_files: int | None = 500, recursive: bool = True) -> DataFrame:
    """Files below a folder; ``exclude`` holds globs for a file's or its folder's name.

    ``max_files`` is the feature's own cap, by path. Paths are listed, filtered and capped first; contents are read
    only of the files that stay.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if extensions:
        files = files.filter(text.extension(F.col("path")).isin([e.lower().lstrip(".") for e in extensions]))
    for glob in exclude or []:
        pattern = "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in glob) + "$"
        parts = F.split("path", "/")
        files = files.filter(~(F.element_at(parts, -1).rlike(pattern) | F.element_at(parts, -2).rlike(pattern)))
    if not max_files:
        return files
    first = files.select("path").orderBy("path").limit(max_files)  # at most max_files paths
    return files.join(F.broadcast(first), "path", "left_semi")


def encoding_of(content: bytes) -> str:
    """The first of ENCODINGS that reads all of it; a mark of byte order asks for the encoding that drops it."""
    for name in ENCODINGS:
        try:
            content.decode(name)
        except UnicodeDecodeError:
            continue
        return "utf-8-sig" if name == "utf-8" and content.startswith(b"\xef\xbb\xbf") else name
    return ENCODINGS[-1]


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes in the first encoding that fits."""
    return content.map(lambda b: None if b is None else bytes(b).decode(encoding_of(bytes(b))))


#: Encodings that Spark's own reader takes, by its names.
READABLE = {"utf-8": "utf-8", "utf-8-sig": "utf-8", "latin-1": "iso-8859-1"}


@F.pandas_udf(T.StringType())
def _encodings(content: pd.Series) -> pd.Series:
    return content.map(lambda b: encoding_of(bytes(b)))


def csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Every column as text, empty and missing fields as empty text. Without ``encoding`` each file is read in the first that fits it.

    Spark's own reader takes the files whose encoding it knows; the others are parsed whole by the task that reads them.
    """
    found = spark.read.format("binaryFile").load(path)
    if encoding is None:
        kinds = found.select("path", _encodings("content").alias("encoding")).groupBy("encoding").agg(F.sort_array(F.collect_list("path")).alias("paths"))
        by = {r["encoding"]: r["paths"] for r in kinds.collect()}  # the paths that the driver lists anyway
    else:
        by = {encoding: [path]}
    tables = [_csv_in(spark, paths, name) for name, paths in sorted(by.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).fillna("")


def _csv_in(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    if encoding in READABLE:
        return spark.read.csv(paths, header=True, inferSchema=False, encoding=READABLE[encoding])
    files = spark.read.format("binaryFile").load(paths)
    first = files.select(F.substring("content", 1, 1 << 16).alias("b")).first()
    columns = list(pd.read_csv(io.BytesIO(bytes(first["b"])), encoding=encoding, nrows=0, encoding_errors="ignore").columns)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.read_csv(io.BytesIO(bytes(content)), encoding=encoding, dtype=str, keep_default_na=False).reindex(columns=columns, fill_value="")

    return files.select("content").mapInPandas(parse, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), text.newlines(F.col("value")).alias("text"))


def checked(df: DataFrame, schema: T.StructType = POINT) -> DataFrame:
    """Only the declared columns, in order; a missing or differently typed one is an error, never a reason to drop the collection."""
    for field in schema:
        if field.name not in df.columns or df.schema[field.name].dataType != field.dataType:
            raise ValueError(f"column {field.name} isn't {field.dataType.simpleString()}")
    return df.select([f.name for f in schema])


def append(points: DataFrame, path: str, schema: T.StructType = POINT) -> None:
    checked(points, schema).write.mode("append").partitionBy("kb_id").parquet(path)


def replace_kbs(points: DataFrame, path: str, schema: T.StructType = POINT, kbs: list | None = None) -> None:
    """The knowledge bases that occur in ``points`` hold these rows afterwards; others stay. Of ``kbs`` those that don't occur are emptied."""
    checked(points, schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").parquet(path)
    spark = points.sparkSession
    held = {str(r["kb_id"]) for r in points.filter(F.col("kb_id").isin(kbs)).select("kb_id").distinct().collect()} if kbs else set()
    for kb in [k for k in kbs or [] if str(k) not in held]:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kb_id={kb}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def progress(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows as lines of JSON, one an event, as progress streams send them."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def without(points: DataFrame, gone: DataFrame) -> DataFrame:
    """Points less those of the files in ``gone`` (file_id), by either file field."""
    left = points.join(gone.select("file_id").distinct(), "file_id", "left_anti")
    return left.join(gone.select(F.col("file_id").alias("source_file_id")).distinct(), "source_file_id", "left_anti").select(points.columns)
