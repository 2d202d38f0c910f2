"""The whole retrieval as one query, with either fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import chain
from lodestar.operators import selected as chosen
from lodestar.plans import retrieval as R
from lodestar.plans.registry import query, table


def _sql(fusion: str) -> str:
    raw = """u AS (SELECT query_id, id, score AS total, 0 AS o FROM dn UNION ALL SELECT query_id, id, score::DOUBLE, 1 FROM sn),
f AS (SELECT query_id, id, arg_min(total, o) AS score FROM u GROUP BY ALL)"""
    head = f"WITH {R._E}, {R._P}, {R._R}, {R._C}, {R._D}, {R._S}, {raw if fusion == 'raw' else R._F}"
    return head + """, co AS (SELECT query_id, id, score AS total, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS idx FROM f QUALIFY idx
< 50),
m AS (SELECT query_id, id, total, CASE WHEN query_id % 500 = 0 THEN total WHEN idx % 3 <> 2 THEN round((id % 97) / 97.0, 4) ELSE 0 END AS ce, id % 5 = 0
AS is_image, query_id % 200 = 0 AS enriched FROM co),
o AS""" + R._CUT.split("\no AS", 1)[1] + """
SELECT query_id, id, CASE WHEN is_image THEN 'image' ELSE 'doc' END AS content_type, round(total, 6) AS total, round(ce, 6) AS ce, round(final, 6) AS final,
position FROM z"""


def answers(coarse: DataFrame) -> DataFrame:
    """What a cross-encoder says of the candidates, as its JSON: every third one left out, none at all for every fifth question."""
    entry = F.struct((F.col("place") - 1).alias("index"), F.round((F.col("id") % 97) / 97.0, 4).alias("relevance_score"))
    said = coarse.filter("query_id % 500 <> 0").groupBy("query_id").agg(F.sort_array(F.collect_list(F.when((F.col("place") - 1) % 3 != 2, entry))).alias("results"))
    return said.select("query_id", F.to_json(F.struct("results")).alias("answer"))


def retrieved(spark, sf_dir: str, fusion: str) -> DataFrame:
    p, docs = R.points(spark, sf_dir), table(spark, sf_dir, "documents")
    questions = R.asked(p)
    scope = chain.routed(questions, R.portraits(p), p.select("kb_id").distinct())
    terms = R.postings(docs, p)
    own = R.tokens(docs.filter(F.col("doc_id") % R.EVERY == 0), "query_id", F.col("text"))
    kinds = p.filter(R.IS_IMAGE).select("id", F.lit("image").alias("content_type"))
    coarse = chain.saved(chain.candidates(chain.searched(scope, p, own, terms), kinds, fusion), "coarse")
    scored = chain.cross_scored(coarse, answers(coarse))
    return chain.cut(scored, questions.filter(R.ENRICHED)).select("query_id", "id", "content_type", *[R.r6(c) for c in ("total", "ce", "final")], "position")


@query(_sql("raw"))
def retrieval_chain(spark, sf_dir):
    """Question to cut, with each route's own scores as totals, as the system whose results are matched does it."""
    return retrieved(spark, sf_dir, "raw")


@query(_sql("rrf"))
def retrieval_chain_rrf(spark, sf_dir):
    """The same with the weighted rank fusion that its description promises."""
    return retrieved(spark, sf_dir, "rrf")


@query(
    """WITH s AS (SELECT c_custkey // 12 AS query_id, (c_custkey % 12)::INT AS nth, 'src' || (c_custkey % 7) AS kb_id, c_custkey % 400 AS file_id, CASE c_custkey % 3 WHEN 0
THEN 'doc' ELSE 'image' END AS kind, CASE c_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE c_name END AS preview FROM customer),
p0 AS (SELECT doc_id, source, doc_id // 4 AS file_id, CASE WHEN doc_id % 4 = 3 THEN doc_id // 4 + 150 END AS other, doc_id % 4 AS pos FROM documents),
p AS (SELECT doc_id, source, pos, file_id FROM p0 UNION SELECT doc_id, source, pos, other FROM p0 WHERE other IS NOT NULL),
f AS (SELECT query_id, nth, s.file_id, kind, doc_id, pos, source = kb_id AS own FROM s JOIN p USING (file_id) WHERE nth < 8),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, nth ORDER BY pos, doc_id::VARCHAR) - 1 AS item FROM (SELECT *, bool_or(own) OVER (PARTITION BY query_id, nth) AS best FROM f)
WHERE own = best), h AS (SELECT query_id, nth, file_id, doc_id::VARCHAR AS id, item, CASE WHEN own THEN 'kb' ELSE 'any' END AS origin FROM k WHERE item < CASE kind WHEN 'doc' THEN 2 ELSE 1 END),
a AS (SELECT * FROM h UNION ALL SELECT query_id, nth, file_id, 'selected:' || file_id, 0, 'preview' FROM s WHERE nth < 8 AND trim(coalesce(preview, '')) <> '' AND NOT EXISTS (SELECT 1 FROM
h WHERE h.query_id = s.query_id AND h.nth = s.nth))
SELECT query_id, file_id, id, item::INT AS item, greatest(0.82, round(1 - 0.03 * nth - 0.01 * item, 4))::DOUBLE AS score, origin FROM a"""
)
def selected_candidates(spark, sf_dir):
    """Points of selected files: of the selected knowledge base, else of any, else the file's preview."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    selected = c.select(
        F.expr("c_custkey div 12").alias("query_id"), (n % 12).cast("int").alias("nth"), F.concat(F.lit("src"), n % 7).alias("kb_id"), (n % 400).alias("file_id"),
        F.when(n % 3 == 0, "doc").otherwise("image").alias("kind"), F.when(n % 5 == 0, " ").when(n % 5 > 1, F.col("c_name")).alias("preview"),
    )
    file = F.expr("doc_id div 4")
    points = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("kb_id"), file.alias("file_id"), F.when(F.col("doc_id") % 4 == 3, file + 150).alias("source_file_id"), (F.col("doc_id") % 4).alias("chunk_index"))
    return chosen.candidates(selected, points)
