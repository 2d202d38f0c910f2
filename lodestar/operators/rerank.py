"""Candidates before and after a cross-encoder, and the choice of knowledge bases that isn't made by portraits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.search import every_pair

SCORED_CHARS, COARSE = 1000, 50
SCORES = "array<struct<index:int,relevance_score:double,score:double,relevance:double,rank_score:double>>"


def total_score(total: Column, scores: Column, score: Column) -> Column:
    """The total a candidate brings, else the sum of its scores by route, else its score."""
    summed = F.when(F.size(scores) > 0, F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x))
    return F.coalesce(total, summed, score, F.lit(0.0))


def coarse(candidates: DataFrame, order: Column, limit: int = COARSE) -> DataFrame:
    """candidates (query_id, id, content_type, total): one per id, the first by ``order`` unless a later one is a video (then
    the last such), the ``limit`` with the largest totals, numbered by ``place`` from 1."""
    video = F.col("content_type") == "video"
    first = Window.partitionBy("query_id", "id").orderBy(F.coalesce(video, F.lit(False)).desc(), F.when(video, -order).otherwise(order))
    once = candidates.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("total"), "id"))
    return once.withColumn("place", place).filter(F.col("place") <= limit)


def scored_text(kind: Column, path: Column, content: Column, description: Column) -> Column:
    """The text by which a candidate is scored, at most SCORED_CHARS long."""
    path, content, description = (F.coalesce(c, F.lit("")) for c in (path, content, description))
    head = lambda name: F.concat(F.lit(f"[{name}] 来源: "), path)
    shown = F.when(kind == "audio", F.concat(head("音频/歌曲"), F.lit("\n转写/歌词: "), content, F.lit("\n描述: "), description))
    shown = shown.when(kind == "video", F.concat(head("视频"), F.lit("\n描述: "), content))
    shown = shown.when(kind == "image", F.concat(head("图片描述"), F.lit("\n描述: "), content)).otherwise(F.concat(head("文档片段"), F.lit("\n内容: "), content))
    return F.when(F.length(shown) > SCORED_CHARS, F.concat(F.left(shown, F.lit(SCORED_CHARS - 3)), F.lit("..."))).otherwise(shown)


def answer_scores(answer: Column) -> Column:
    """(idx, score) of a reranker's answer: a JSON list, or one under ``results``, ``data``, ``data.results`` or in a chat message,
    anywhere in the text. Without positions the list's own order counts; a score may go by several names."""
    text = F.coalesce(answer, F.lit(""))
    message = F.get_json_object(text, "$.choices[0].message.content")
    body = F.nullif(F.regexp_extract(F.coalesce(message, text), r"(?s)[\[{].*[\]}]", 0), F.lit(""))
    under = [F.from_json(F.get_json_object(body, path), SCORES) for path in ("$.results", "$.data", "$.data.results")]
    inside = F.from_json(F.nullif(F.regexp_extract(body, r"(?s)\[.*\]", 0), F.lit("")), SCORES)
    found = F.when(body.startswith("["), F.from_json(body, SCORES)).otherwise(F.coalesce(*[F.when(F.size(x) > 0, x) for x in under], inside))
    score = lambda x: F.coalesce(*[F.nullif(x[n], F.lit(0.0)) for n in ("relevance_score", "score", "relevance", "rank_score")], F.lit(0.0))
    return F.transform(found, lambda x, i: F.struct(F.coalesce(x["index"], i).alias("idx"), score(x).alias("score")))


def routed(queries: DataFrame, scopes: DataFrame, decided: DataFrame, kbs: DataFrame) -> DataFrame:
    """query_id, kb_id, method, confidence.

    queries (query_id, embedded, with_portraits), scopes (query_id, kb_id) given by hand, decided (query_id, kb_id, norm,
    method) by portraits, kbs (kb_id). A scope wins; a query without a vector gets every knowledge base, or
    ``no_kb_available`` where there is none; without portraits there is a row without a knowledge base.
    """
    explicit = scopes.select("query_id", "kb_id", F.lit("explicit").alias("method"), F.lit(1.0).alias("confidence"))
    left = queries.join(scopes.select("query_id").distinct(), "query_id", "left_anti")
    blind = left.filter("NOT embedded").select("query_id")
    every = blind.join(every_pair(blind, kbs.select("kb_id"), ["query_id"], ["kb_id"]).select("query_id", "kb_id"), "query_id", "left")
    known = F.col("kb_id").isNotNull()
    default = every.select("query_id", "kb_id", F.when(known, "default_all").otherwise("no_kb_available").alias("method"), F.when(known, 1.0).alias("confidence"))
    left = left.filter("embedded")
    none = left.filter("NOT with_portraits").select("query_id", F.lit(None).cast(kbs.schema["kb_id"].dataType).alias("kb_id"), F.lit("no_portraits").alias("method"), F.lit(None).cast("double").alias("confidence"))
    chosen = decided.join(left.filter("with_portraits").select("query_id"), "query_id").select("query_id", "kb_id", "method", F.col("norm").alias("confidence"))
    return explicit.unionByName(default).unionByName(none).unionByName(chosen)


def canonical_kbs(given: Column, stored: Column) -> Column:
    """Ids as points carry them: those that ``stored`` (a map) knows are replaced, blank ones go, each stands once and in order."""
    ids = F.filter(given, lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(F.coalesce(stored[x], x))), lambda x: x != ""))
