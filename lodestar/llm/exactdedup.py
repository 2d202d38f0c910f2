"""Exact dedup by content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters on (start of the normalised text, its digest, salt): a short key,
so that the sample which picks splitters stays small however long texts are. Within a partition Spark's external
sort puts rows in the order of their whole normalised texts, and a window over them compares neighbours in full.

A text with so many copies that they would overfill a partition has several salts, all others have one. Each salt
is a piece of the group; a piece has one row that represents it. The representatives carry their whole text, are
compared in full like any rows, and give the pieces the group's id and size. There are at most ``16 x partitions``
pieces of salted texts, whatever the input, since at most ``8 x partitions`` texts can have that many copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import discard, materialize, shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START_CHARS = 24


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _pieces(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with their piece's ``_n`` and ``_max`` and their ``_rank`` in it, and the pieces of salted texts with
    ``group_size`` and ``keep_id`` of the whole group."""
    parts = shuffle_partitions(docs.sparkSession)
    norm = normalised(F.col("_text"))
    row = [F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row")] if carried else []
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *row).withColumn("_norm", norm)
    keyed = keyed.withColumn("_sha", F.sha2(F.col("_norm").cast("binary"), 256)).withColumn("_start", F.left("_norm", F.lit(START_CHARS))).drop("_norm")
    keyed = materialize(keyed.withColumn("_row_number", F.monotonically_increasing_id()), "exact-keyed")

    copies = materialize(keyed.groupBy("_sha").agg(F.count(F.lit(1)).alias("_copies")), "exact-digests")
    most = max(1.0, (copies.agg(F.sum("_copies")).first()[0] or 0) / (8 * parts))
    many = F.broadcast(copies.filter(F.col("_copies") > most).select("_sha", F.ceil(F.col("_copies") / most).alias("_salts")))
    salted = keyed.join(many, "_sha", "left").withColumn("_salt", F.pmod(F.xxhash64("_row_number"), F.coalesce("_salts", F.lit(1))))
    ranged = salted.repartitionByRange("_start", "_sha", "_salt").withColumn("_norm", norm)

    equal = Window.partitionBy("_start", "_norm", "_sha", "_salt")
    order = equal.orderBy(F.col("_id").desc_nulls_last(), "_row_number")
    ranked = ranged.select(
        "_id", "_sha", F.when(F.col("_salts").isNotNull(), F.col("_salt")).alias("_salt"), *["_row", "_text"] * bool(carried),
        F.row_number().over(order).alias("_rank"), F.count(F.lit(1)).over(equal).alias("_n"), F.max("_id").over(equal).alias("_max"), "_norm",
    )
    first = F.col("_rank") == 1
    ranked = ranked.withColumn("_norm", F.when(first & F.col("_salt").isNotNull(), F.col("_norm")))
    ranked = materialize(ranked.filter(first) if carried else ranked, "exact-pieces")
    discard(keyed, copies)

    pieces = ranked.filter(first & F.col("_salt").isNotNull())
    whole = Window.partitionBy("_sha", "_norm")
    size, keeper = F.sum("_n").over(whole).alias("_size"), F.max("_max").over(whole).alias("_keeper")
    winner = F.row_number().over(whole.orderBy(F.col("_max").desc_nulls_last(), "_salt")) == 1
    return ranked.drop("_norm"), pieces.select(F.col("_sha").alias("_of"), F.col("_salt").alias("_at"), F.col("_max").alias("_piece"), size, keeper, winner.alias("_winner"))


def _merged(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    ranked, pieces = _pieces(docs, id_col, text_col, carried)
    same = (F.col("_sha") == F.col("_of")) & (F.col("_salt") == F.col("_at")) & F.col("_max").eqNullSafe(F.col("_piece"))
    merged = ranked.join(F.broadcast(pieces), same, "left")
    kept = (F.col("_rank") == 1) & F.coalesce("_winner", F.lit(True))
    return merged.withColumn("kept", kept).withColumn("group_size", F.coalesce("_size", "_n")).withColumn("keep_id", F.when(F.col("_size").isNull(), F.col("_max")).otherwise(F.col("_keeper")))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays; null ids are smaller than any, and of rows that repeat
    with the same id one stays. Null text equals empty text. An empty table gives an empty result. Very long texts
    are sorted and compared whole. Other columns aren't read.
    """
    merged = _merged(docs, id_col, text_col, [])
    return merged.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = _merged(docs, id_col, text_col, [c for c in docs.columns if c != text_col] or [text_col]).filter("kept")
    return kept.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS r
  FROM t
)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
