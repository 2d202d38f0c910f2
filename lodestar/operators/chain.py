"""Retrieval from question to cut: intent, routing, search, fusion, coarse list, cross-encoder scores, merge, final rows.

Many questions run as one job. What a model would answer (the cross-encoder's scores) comes in as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import intent as I
from lodestar.operators import rerank
from lodestar.operators import search as S
from lodestar.operators.segment import query_keywords
from lodestar.session import saved

FUSIONS = ("raw", "rrf")


def prepared(questions: DataFrame) -> DataFrame:
    """questions (query_id, text, ...) with refined_query, intent_type, is_complex, an intent by modality, and keywords."""
    text = F.trim(F.coalesce("text", F.lit("")))
    asked = {f"{m}_intent": I.validated(F.lit(None).cast("string"), text, m) for m in ("visual", "audio", "video")}
    mixed = sum(((c != I.NONE).cast("int") for c in asked.values()), F.lit(0))
    return questions.withColumns({"refined_query": text, "intent_type": I.intent_type(text), "is_complex": mixed > 1, **asked, "keywords": query_keywords(text)})


def routed(questions: DataFrame, portraits: DataFrame, kbs: DataFrame) -> DataFrame:
    """query_id, kb_id, raw, norm, method, query_vec. Saved, as every route of the search starts from it."""
    scores = S.route_scores(S.nearest_portraits(questions.select("query_id", "query_vec"), portraits))
    return saved(S.route_decision(scores, kbs).join(questions.select("query_id", "query_vec"), "query_id"), "routing")


def searched(scope: DataFrame, points: DataFrame, query_terms: DataFrame, terms: DataFrame, dense: int = 20, sparse: int = 15) -> DataFrame:
    """Hits (query_id, id, kb_id, score, rank, route) of the dense and the sparse route over each question's knowledge bases.

    points (id, kb_id, vec), query_terms (query_id, tokens, weights), terms (id, kb_id, tokens, weights).
    """
    own = query_terms.join(scope.select("query_id", "kb_id"), "query_id")
    columns = ["query_id", "id", "kb_id", F.col("score").cast("double").alias("score"), "rank"]
    near = S.dense_search(scope, points, dense).select(*columns, F.lit("dense").alias("route"))
    return near.unionByName(S.sparse_search(own, terms, sparse, ("kb_id",)).select(*columns, F.lit("sparse").alias("route")))


def candidates(hits: DataFrame, kinds: DataFrame | None = None, fusion: str = "raw", limit: int = rerank.COARSE, weights: Column | None = None) -> DataFrame:
    """query_id, id, content_type, total, place (from 1): what goes to the cross-encoder.

    ``raw`` takes each route's own score, of the first route that has a row (a video's, if a later one is a video);
    ``rrf`` takes the weighted rank fusion. kinds (id, content_type) names what isn't a document.
    """
    if fusion not in FUSIONS:
        raise ValueError(f"fusion is one of {FUSIONS}, not {fusion!r}")
    if fusion == "rrf":
        rows = S.weighted_rrf(hits, weights, limit).select("query_id", "id", F.col("score").alias("total"), F.lit(0).alias("place_of_route"))
    else:
        order = F.array_position(F.lit(list(S.ROUTE_WEIGHTS)), F.col("route"))
        rows = hits.select("query_id", "id", F.col("score").alias("total"), order.alias("place_of_route"))
    rows = rows.withColumn("content_type", F.lit("doc")) if kinds is None else rows.join(kinds, "id", "left").fillna("doc", ["content_type"])
    return rerank.coarse(rows, F.col("place_of_route"), limit).drop("place_of_route")


def cross_scored(coarse: DataFrame, answers: DataFrame) -> DataFrame:
    """The candidates with ``ce``, joined by their position in the answer (query_id, answer).

    An answer whose entries have no position counts them in order; a candidate that it leaves out, and the first of
    several entries of one position, score 0 and as they say. A question without an answer keeps its totals.
    """
    entries = answers.select("query_id", F.posexplode(rerank.answer_scores(F.col("answer"))).alias("nth", "e")).select("query_id", "nth", "e.*")
    named = F.max(F.col("idx") >= 0).over(Window.partitionBy("query_id"))
    entries = entries.withColumn("idx", F.when(named, F.col("idx")).otherwise(F.col("nth"))).groupBy("query_id", "idx").agg(F.min_by("score", "nth").alias("ce"))
    answered = answers.select("query_id", F.lit(True).alias("answered")).distinct()
    both = coarse.withColumn("idx", F.col("place") - 1).join(entries, ["query_id", "idx"], "left").join(answered, "query_id", "left")
    return both.withColumn("ce", F.when(F.col("answered"), F.coalesce("ce", F.lit(0.0))).otherwise(F.col("total"))).drop("idx", "answered")


def cut(scored: DataFrame, protected: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """query_id, id, content_type, total, ce, final, position. ``protected`` (query_id): questions that images only enrich."""
    if protected is not None:
        scored = scored.join(protected.select("query_id", F.lit(True).alias("guarded")).distinct(), "query_id", "left")
    guard = F.lit(False) if protected is None else F.coalesce("guarded", F.lit(False))
    scored = scored.withColumn("guarded", guard).withColumn("is_image", F.col("content_type") == "image")
    merged = S.merge_scores(scored.select("query_id", "id", "total", "ce", "guarded", "is_image"), F.col("is_image") & F.col("guarded"))
    final = merged.join(scored.select("query_id", "id", "content_type", "guarded", "is_image"), ["query_id", "id"])
    return S.final_cut(final, limit, protect=F.col("guarded")).select("query_id", "id", "content_type", "total", "ce", "final", "position")
