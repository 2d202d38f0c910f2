"""What files that a user selected bring into a search, before anything is compared with the question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Files that count, points of a document and of any other file, and the scores by place.
FILES, DOC_POINTS, OTHER_POINTS = 8, 2, 1
FIRST, LEAST, PER_FILE, PER_ITEM = 1.0, 0.82, 0.03, 0.01


def candidates(selected: DataFrame, points: DataFrame) -> DataFrame:
    """query_id, file_id, id, item (from 0), score, origin.

    selected (query_id, nth from 0, kb_id, file_id, kind, preview), points (id, kb_id, file_id, source_file_id, chunk_index). A file's points
    are those that name it in either field; those of the selected knowledge base, if it has some, else of any (``origin``
    kb or any). A file without points comes in with its preview, if that isn't blank, under an id made from its own.
    """
    few = selected.filter(F.col("nth") < FILES)
    named = points.select(F.col("id").cast("string").alias("id"), F.col("kb_id").alias("_kb"), "chunk_index", F.explode(F.array_distinct(F.array("file_id", "source_file_id"))).alias("file_id"))
    found = few.join(named.filter(F.col("file_id").isNotNull()), "file_id").withColumn("_own", F.col("_kb").eqNullSafe(F.col("kb_id")))
    file = Window.partitionBy("query_id", "nth")
    found = found.withColumn("_some", F.max("_own").over(file)).filter(F.col("_own") == F.col("_some"))
    place = F.row_number().over(file.orderBy(F.asc_nulls_last("chunk_index"), "id")) - 1
    most = F.when(F.col("kind") == "doc", DOC_POINTS).otherwise(OTHER_POINTS)
    held = found.withColumn("item", place).filter(F.col("item") < most).withColumn("origin", F.when(F.col("_own"), "kb").otherwise("any"))
    held = held.select("query_id", "nth", "file_id", "id", "item", "origin")
    bare = few.join(held.select("query_id", "nth").distinct(), ["query_id", "nth"], "left_anti").filter(F.trim(F.coalesce("preview", F.lit(""))) != "")
    made = bare.select("query_id", "nth", "file_id", F.concat(F.lit("selected:"), F.col("file_id").cast("string")).alias("id"), F.lit(0).alias("item"), F.lit("preview").alias("origin"))
    score = F.greatest(F.lit(LEAST), F.round(FIRST - PER_FILE * F.col("nth") - PER_ITEM * F.col("item"), 4))
    return held.unionByName(made).select("query_id", "file_id", "id", F.col("item").cast("int").alias("item"), score.alias("score"), "origin")
