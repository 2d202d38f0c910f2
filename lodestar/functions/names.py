"""Names, identifiers and small tables of them: which knowledge base is meant, which video owns a frame, what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types that are fetched as bytes.
BINARY_EXT = ["pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "zip", "png", "jpg", "jpeg", "gif", "webp", "mp3", "mp4"]
#: The most characters of a fetched text that are kept.
TEXT_CHARS = 2_000_000


def resolved(asked: DataFrame, kbs: DataFrame) -> DataFrame:
    """asked (token, ..), kbs (id, name in lower case) -> kb_id and outcome (found, ambiguous, unknown, empty).

    An id wins over a name, and a whole name over the beginning of one; a name or beginning that several have finds
    none. Tokens are looked up once each, by equality and by every prefix of a name, so nothing is paired with all.
    """
    token = F.lower(F.trim(F.coalesce("token", F.lit(""))))
    keyed = asked.withColumn("_t", token)
    ids = kbs.select(F.lower("id").alias("_t"), F.col("id").alias("_id")).groupBy("_t").agg(F.min("_id").alias("_by_id"))
    names = kbs.groupBy(F.col("name").alias("_t")).agg(F.count(F.lit(1)).alias("_exact"), F.min("id").alias("_by_name"))
    prefixes = kbs.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.col("name"), F.lit(1), i))).alias("_t"))
    prefixes = prefixes.groupBy("_t").agg(F.count(F.lit(1)).alias("_begun"), F.min("id").alias("_by_start"))
    for found in (ids, names, prefixes):
        keyed = keyed.join(found, "_t", "left")
    exact, begun = F.coalesce("_exact", F.lit(0)), F.coalesce("_begun", F.lit(0))
    kb = F.when(F.col("_by_id").isNotNull(), F.col("_by_id")).when(exact == 1, F.col("_by_name")).when((exact == 0) & (begun == 1), F.col("_by_start"))
    outcome = F.when(F.col("_t") == "", "empty").when(kb.isNotNull(), "found").when((exact > 1) | (begun > 1), "ambiguous").otherwise("unknown")
    return keyed.withColumn("kb_id", kb).withColumn("outcome", outcome).drop("_t", "_by_id", "_exact", "_by_name", "_begun", "_by_start")


def with_video(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """frames (path), videos (uuid, name): each frame with the name of the video whose identifier its path holds."""
    return frames.withColumn("uuid", F.regexp_extract("path", "frames/([^/]+)/", 1)).join(videos, "uuid", "left")


def changed(rows: DataFrame, given: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows after updates (fields that are null keep their value), insertions and deletions by key."""
    both = rows.alias("o").join(given.alias("n"), key, "full")
    merged = both.select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rows.columns if c != key])
    return merged.join(gone.select(key), key, "left_anti")


def without_empty(fields: Column) -> Column:
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (F.trim(v) != ""))


def url_extension(url: Column) -> Column:
    """The type that an address's path ends in, in lower case; empty if its last part has none."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def is_binary(url: Column) -> Column:
    return url_extension(url).isin(BINARY_EXT)
