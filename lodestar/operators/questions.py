"""Banks of questions, one a knowledge base: merged by what is asked, bounded, emptied by file, and snapshots that age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.sources.snapshots import SnapshotTable

MOST, SNAPSHOT_TTL = 800, 24 * 3600
SCHEMA = "kb_id string, id string, text string, kb_name string, source string, file_id string, created_at timestamp, place long"


def question_id(kb_id: Column, file_id: Column, text: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", kb_id.cast("string"), F.coalesce(file_id.cast("string"), F.lit("")), text), 256), F.lit(16))


def merged(bank: DataFrame, new: DataFrame, source: str, now: Column, most: int = MOST) -> DataFrame:
    """A bank with new questions (kb_id, text, kb_name, file_id, place): normalised, each once by what is asked, the last ``most``.

    What the bank has stays as it is; of new ones that ask the same the first by ``place`` comes in. Blank ones don't.
    """
    text = T.question(F.col("text"))
    fresh = new.withColumn("text", text).select(
        "kb_id", question_id(F.col("kb_id"), F.col("file_id"), F.col("text")).alias("id"), "text", F.coalesce("kb_name", F.col("kb_id").cast("string")).alias("kb_name"),
        F.lit(source).alias("source"), "file_id", now.alias("created_at"), "place",
    )
    both = bank.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1))).withColumn("_key", T.canonical_key(F.col("text"))).filter("_new = 0 OR _key <> ''")
    first = F.row_number().over(Window.partitionBy("kb_id", "_key").orderBy("_new", "place"))
    once = both.withColumn("_first", first).filter("_new = 0 OR _first = 1")
    order = Window.partitionBy("kb_id").orderBy(F.desc("_new"), F.desc("place"))
    kept = once.withColumn("_back", F.row_number().over(order)).filter(F.col("_back") <= most)
    place = F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("_back")))
    return kept.withColumn("place", place.cast("long")).select([c.split()[0] for c in SCHEMA.split(", ")])


class QuestionStore:
    """The banks as a snapshot table, so that a failed change leaves what was there."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = SnapshotTable(spark, path, SCHEMA)

    def add(self, new: DataFrame, source: str, now: Column, most: int = MOST) -> int:
        keys = [r["kb_id"] for r in new.select("kb_id").distinct().collect()]  # of one upload or refresh
        return self.table.update(lambda bank: merged(bank, new, source, now, most), keys)

    def remove_file(self, kb_id: str, file_id: str) -> int:
        return self.table.update(lambda bank: bank.filter(~F.col("file_id").eqNullSafe(F.lit(file_id))), [kb_id])

    def remove_kb(self, kb_id: str) -> int:
        return self.table.remove([kb_id])

    def fresh(self, now: Column, ttl_seconds: int = SNAPSHOT_TTL) -> DataFrame:
        """The questions of banks whose last change isn't older than the time to live."""
        last = self.table.read().groupBy("kb_id").agg(F.max("created_at").alias("last"))
        young = last.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros("last") <= ttl_seconds * 1_000_000)
        return self.table.read().join(young.select("kb_id"), "kb_id", "left_semi")
