"""Retrieval queries: routing, search routes, fusion, merging, cuts and context.

Queries are the vectors whose id is divisible by 100. A point's text is the document of the same id.
"""

from __future__ import annotations

import weakref

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import search as S
from lodestar.plans.registry import query, table
from lodestar.session import saved

EVERY, CLUSTERS = 100, 5

_E = """e AS (SELECT vec_id AS id, label AS kb_id, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT id AS query_id, v AS qv FROM e WHERE id % 100 = 0)"""
_P = f"""x AS (SELECT kb_id, id % {CLUSTERS} AS m, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM e),
a AS (SELECT kb_id, m, i, avg(c) AS c FROM x GROUP BY ALL), p AS (SELECT kb_id, m, list(c ORDER BY i) AS v FROM a GROUP BY ALL)"""
_R = """h0 AS (SELECT query_id, kb_id, m, list_cosine_similarity(v, qv) AS sim FROM p, q),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, kb_id, m) AS nth FROM h0) WHERE nth <= 30),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY sim DESC) AS n FROM h),
raw AS (SELECT query_id, kb_id, sum(sim * pow(0.9, n - 1)) / sum(pow(0.9, n - 1)) AS raw FROM hr WHERE n <= 5 GROUP BY ALL),
s AS (SELECT *, CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 1.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS norm
FROM raw WINDOW w AS (PARTITION BY query_id))"""
_C = """r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY norm DESC, kb_id) AS place, max(raw) OVER (PARTITION BY query_id) AS best FROM s),
g AS (SELECT *, max(CASE WHEN place = 1 THEN norm END) OVER (PARTITION BY query_id)
- coalesce(max(CASE WHEN place = 2 THEN norm END) OVER (PARTITION BY query_id), 0) AS gap FROM r),
d AS (SELECT *, CASE WHEN best < 0.08 THEN 'low_confidence' WHEN gap >= 0.3 THEN 'single_kb_dominant' ELSE 'dual_kb' END AS method FROM g),
c AS (SELECT query_id, kb_id, raw, norm, method FROM d WHERE method <> 'low_confidence' AND place <= CASE WHEN method = 'dual_kb' THEN 2 ELSE 1 END
UNION ALL SELECT l.query_id, k.kb_id, s.raw, 1.0, 'low_confidence' FROM (SELECT DISTINCT query_id FROM d WHERE method = 'low_confidence') l
CROSS JOIN (SELECT DISTINCT kb_id FROM e) k LEFT JOIN s ON s.query_id = l.query_id AND s.kb_id = k.kb_id)"""
_D = """dn AS (SELECT * FROM (SELECT query_id, id, kb_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM
(SELECT c.query_id, e.id, e.kb_id, list_cosine_similarity(e.v, q.qv) AS score FROM c JOIN q USING (query_id) JOIN e USING (kb_id)) WHERE score >= 0)
WHERE rank < 20)"""
#: A second view of a query: its vector turned by half its length.
_D2 = """vn AS (SELECT * FROM (SELECT query_id, id, kb_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM
(SELECT c.query_id, e.id, e.kb_id, list_cosine_similarity(e.v, list_concat(q.qv[33:64], q.qv[1:32])) AS score FROM c JOIN q USING (query_id) JOIN e
USING (kb_id))
WHERE score >= 0) WHERE rank < 20)"""
#: The sparse route: tokens of a point's text, and of the query's own.
_S = """tk AS (SELECT id, token, count(*) AS weight FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}|[一-龥]')) AS token FROM
documents) GROUP BY ALL),
qt AS (SELECT query_id, token, count(*) AS weight FROM
(SELECT doc_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}|[一-龥]')) AS token FROM documents WHERE doc_id % 100 = 0) GROUP BY
ALL),
sn AS (SELECT * FROM (SELECT query_id, id, kb_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM
(SELECT c.query_id, e.id, e.kb_id, sum(tk.weight * qt.weight)::BIGINT AS score FROM c JOIN qt USING (query_id) JOIN e USING (kb_id) JOIN tk ON tk.id =
e.id AND tk.token = qt.token
GROUP BY ALL)) WHERE rank < 15)"""
_F = """f AS (SELECT query_id, id, sum(w / (60 + rank)) AS score, string_agg(route, ',' ORDER BY route) AS routes FROM
(SELECT query_id, id, rank, 1.0 AS w, 'dense' AS route FROM dn UNION ALL SELECT query_id, id, rank, 0.8, 'sparse' FROM sn) GROUP BY ALL)"""


def points(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kb_id"), F.col("embedding").alias("vec"))


def asked(p: DataFrame) -> DataFrame:
    return p.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))


def tokens(docs: DataFrame, key: str, text, own: str = "doc_id") -> DataFrame:
    """(key, tokens, weights): how often each word occurs."""
    return S.sparse_vectors(docs.withColumn(key, F.col(own)), key, text)


def postings(docs: DataFrame, p: DataFrame) -> DataFrame:
    """(id, tokens, weights, kb_id) of the documents that are points, saved: others aren't cut into words."""
    own = docs.select(F.col("doc_id").alias("id"), "text").join(p.select("id", "kb_id"), "id")
    return saved(S.sparse_vectors(own, "id", F.col("text"), ("kb_id",)), "postings")


def portraits(p: DataFrame, clusters: int = CLUSTERS) -> DataFrame:
    """A mean vector per knowledge base and remainder of the id: few rows, whatever the number of points."""
    rows = p.select("kb_id", (F.col("id") % clusters).alias("cluster"), array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    return rows.groupBy("kb_id", "cluster").agg(Summarizer.mean(F.col("v")).alias("m")).select("kb_id", "cluster", vector_to_array("m").alias("vec"))


def routes(p: DataFrame) -> DataFrame:
    return S.route_scores(S.nearest_portraits(asked(p), portraits(p)))


def decided(p: DataFrame) -> DataFrame:
    return S.route_decision(routes(p), p.select("kb_id").distinct())


_scopes: weakref.WeakKeyDictionary[DataFrame, DataFrame] = weakref.WeakKeyDictionary()


def scoped(p: DataFrame) -> DataFrame:
    """The routed knowledge bases of each query. All routes of a search over the same points need them, so they are computed once and saved."""
    if p not in _scopes:
        _scopes[p] = saved(decided(p).join(asked(p), "query_id").select("query_id", "kb_id", "query_vec"), "routing")
    return _scopes[p]


def turned(v):
    return F.concat(F.slice(v, 33, 32), F.slice(v, 1, 32))


def both_views(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    scope = scoped(p)
    return S.dense_search(scope, p, 20), S.dense_search(scope.withColumn("query_vec", turned(F.col("query_vec"))), p, 20)


def hybrid(spark, sf_dir: str, p: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The dense and the sparse route over the same routed knowledge bases."""
    p, docs = p or points(spark, sf_dir), table(spark, sf_dir, "documents")
    scope = scoped(p)
    terms = postings(docs, p)
    asking = tokens(docs.filter(F.col("doc_id") % EVERY == 0), "query_id", F.col("text")).join(scope.select("query_id", "kb_id"), "query_id")
    return S.dense_search(scope, p, 20), S.sparse_search(asking, terms, 15, ("kb_id",))


def tagged(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Both routes' hits as rows (query_id, id, rank, route)."""
    columns = ["query_id", "id", "rank"]
    return dense.select(*columns, F.lit("dense").alias("route")).unionByName(sparse.select(*columns, F.lit("sparse").alias("route")))


def r6(c: str):
    return F.round(c, 6).alias(c)


_HYBRID = f"WITH {_E}, {_P}, {_R}, {_C}, {_D}, {_S}, {_F}"


@query(
    _HYBRID + """, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM f)
SELECT query_id, id, round(score, 6) AS score, routes, rank FROM t WHERE rank < 10"""
)
def routed_hybrid_search(spark, sf_dir):
    return S.weighted_rrf(tagged(*hybrid(spark, sf_dir))).filter("rank < 10").select("query_id", "id", r6("score"), "routes", "rank")


@query(_HYBRID.replace(_F, "z AS (SELECT 1)") + " SELECT query_id, id, kb_id, score, rank FROM sn")
def sparse_route(spark, sf_dir):
    return hybrid(spark, sf_dir)[1].select("query_id", "id", "kb_id", "score", "rank")


@query(
    _HYBRID + """, n AS (SELECT q.query_id, count(dn.id) AS dense FROM q LEFT JOIN dn USING (query_id) GROUP BY ALL), m AS (SELECT query_id, count(*)
AS sparse FROM sn GROUP BY ALL),
u AS (SELECT query_id, count(*) AS fused FROM f GROUP BY ALL)
SELECT query_id, dense, coalesce(sparse, 0) AS sparse, coalesce(fused, 0) AS fused, 'hybrid_' || ((dense > 0)::INT + (coalesce(sparse, 0) > 0)::INT)
|| '_way' AS strategy
FROM n LEFT JOIN m USING (query_id) LEFT JOIN u USING (query_id)"""
)
def search_diagnostics(spark, sf_dir):
    """How many hits each route and the fusion gave, and the label of the strategy."""
    dense, sparse = hybrid(spark, sf_dir)
    hits = tagged(dense, sparse)
    counts = hits.groupBy("query_id").agg(*[F.count_if(F.col("route") == r).alias(r) for r in ("dense", "sparse")], F.countDistinct("id").alias("fused"))
    every = asked(points(spark, sf_dir)).select("query_id").join(counts, "query_id", "left").fillna(0)
    ways = (F.col("dense") > 0).cast("int") + (F.col("sparse") > 0).cast("int")
    return every.select("query_id", "dense", "sparse", "fused", F.format_string("hybrid_%d_way", ways).alias("strategy"))


@query(f"WITH {_E}, {_P}, {_R} SELECT query_id, kb_id, round(raw, 6) AS raw, round(norm, 6) AS norm FROM s")
def route_scores(spark, sf_dir):
    return routes(points(spark, sf_dir)).select("query_id", "kb_id", r6("raw"), r6("norm"))


@query(f"WITH {_E}, {_P}, {_R}, {_C} SELECT query_id, kb_id, round(raw, 6) AS raw, round(norm, 6) AS norm, method FROM c")
def route_decisions(spark, sf_dir):
    return decided(points(spark, sf_dir)).select("query_id", "kb_id", r6("raw"), r6("norm"), "method")


@query(
    f"""WITH {_E}, {_P}, {_R}, {_C}, o AS (SELECT query_id, method, count(*) AS kbs, max(norm) AS best FROM c GROUP BY ALL)
SELECT method, count(*) AS queries, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent, round(avg(kbs), 6) AS kbs, round(avg(best), 6) AS
confidence FROM o GROUP BY method"""
)
def routing_statistics(spark, sf_dir):
    per = decided(points(spark, sf_dir)).groupBy("query_id", "method").agg(F.count(F.lit(1)).alias("kbs"), F.max("norm").alias("best"))
    counts = per.groupBy("method").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("kbs"), 6).alias("kbs"), F.round(F.avg("best"), 6).alias("confidence"))
    return counts.withColumn("percent", F.round(100.0 * F.col("queries") / F.sum("queries").over(Window.partitionBy(F.lit(1))), 2))


@query(
    f"""WITH {_E}, {_P}, {_R}, {_C}, {_D}, {_D2}, u AS (SELECT query_id, id, 1.0 / (60 + rank) AS w FROM dn UNION ALL SELECT query_id, id, 0.8 / (60 +
rank) FROM vn),
f2 AS (SELECT query_id, id, sum(w) AS score FROM u GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) -
1 AS rank FROM f2) SELECT query_id, id, round(score, 8) AS score, rank FROM t WHERE rank < 10"""
)
def multi_query_fusion(spark, sf_dir):
    """The views of a query fused by rank, the first with the larger weight."""
    dense, other = both_views(points(spark, sf_dir))
    hits = dense.withColumn("route", F.lit("main")).unionByName(other.withColumn("route", F.lit("view")))
    return S.weighted_rrf(hits, {"main": 1.0, "view": 0.8}, 10).select("query_id", "id", F.round("score", 8).alias("score"), "rank")


@query(f"WITH {_E}, {_P}, {_R}, {_C}, {_D} SELECT query_id, id, kb_id, round(score, 6) AS score, rank FROM dn")
def dense_search(spark, sf_dir):
    return both_views(points(spark, sf_dir))[0].select("query_id", "id", "kb_id", r6("score"), "rank")


_VIEWS = f"WITH {_E}, {_P}, {_R}, {_C}, {_D}, {_D2}"


@query(
    _VIEWS + """, u AS (SELECT query_id, id, CASE WHEN query_id % 300 = 0 THEN max(score) ELSE sum(1.0 / (2 + rank)) END AS score FROM
(SELECT query_id, id, rank, score FROM dn UNION ALL SELECT query_id, id, rank, NULL FROM vn WHERE query_id % 300 <> 0) GROUP BY query_id, id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM u WHERE score >= 0.3) SELECT query_id, id,
round(score, 6) AS score, rank FROM t WHERE rank < 20"""
)
def dual_route_search(spark, sf_dir):
    """Two vectors of each image, fused by rank with the threshold on the fused score; queries without the second vector go by the first alone."""
    dense, other = both_views(points(spark, sf_dir))
    single = F.col("query_id") % 300 == 0
    fused = S.store_fusion(dense.filter(~single).select("query_id", "id", "rank").union(other.filter(~single).select("query_id", "id", "rank")), 20, 0.3)
    alone = dense.filter(single & (F.col("score") >= 0.3)).select("query_id", "id", "score", "rank")
    return fused.select("query_id", "id", "score", "rank").union(alone).select("query_id", "id", r6("score"), "rank")


@query(
    _VIEWS + """, u AS (SELECT query_id, id, score, 0 AS view, rank FROM dn UNION ALL SELECT query_id, id, score, 1, rank FROM vn),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY view, rank) AS n FROM u)
SELECT query_id, id, round(score, 6) AS score, view, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM k WHERE n = 1"""
)
def multi_query_dense(spark, sf_dir):
    """Hits of a query's views, the first view's where both have a point, by score."""
    dense, other = both_views(points(spark, sf_dir))
    every = dense.withColumn("view", F.lit(0)).unionByName(other.withColumn("view", F.lit(1)))
    first = S.first_per(every, ("query_id", "id"), F.col("view"), F.col("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return first.withColumn("place", place).select("query_id", "id", r6("score"), "view", "place")


@query(
    f"""WITH {_E}, {_P}, {_R}, {_C}, {_D}, k AS (SELECT *, id % 7 AS segment, row_number() OVER (PARTITION BY query_id, kb_id, id % 7 ORDER BY score
DESC, id) AS n FROM dn) SELECT query_id, kb_id, segment, id, round(score, 6) AS score FROM k WHERE n = 1"""
)
def segment_best(spark, sf_dir):
    hits = both_views(points(spark, sf_dir))[0].withColumn("segment", F.col("id") % 7)
    return S.first_per(hits, ("query_id", "kb_id", "segment"), F.desc("score"), F.col("id")).select("query_id", "kb_id", "segment", "id", r6("score"))


_M = _HYBRID + """, m AS (SELECT f.query_id, f.id, f.score * 30 AS total, coalesce(dn.score, 0) AS ce, f.id % 5 = 0 AS is_image, f.query_id % 200 = 0
AS enriched FROM f LEFT JOIN dn USING (query_id, id)),
o AS (SELECT *, row_number() OVER w AS place, (total - lead(total) OVER w) / nullif(total, 0) AS gap FROM m WINDOW w AS (PARTITION BY query_id ORDER
BY total DESC, id)),
ww AS (SELECT *, place = 1 AND coalesce(gap > 0.2, false) AS ahead FROM o),
wp AS (SELECT *, CASE WHEN ahead THEN least(0.5, 0.3 * (1 + gap)) ELSE 0.3 END AS wt, CASE WHEN ahead THEN least(2.0, 0.45 * (1 + gap)) ELSE 0.45 END
AS pt FROM ww),
mm AS (SELECT query_id, id, total, ce, is_image, enriched, CASE WHEN is_image AND enriched THEN CASE WHEN ahead THEN 1 - (pt - 0.45) ELSE 0.35 END *
ce + pt * total
ELSE (1 - wt) * ce + wt * total END AS final FROM wp)"""

IS_IMAGE, ENRICHED = "id % 5 = 0", "query_id % 200 = 0"


def merged(spark, sf_dir: str) -> DataFrame:
    """Fused candidates with the dense score in the cross-encoder's place; every second query is only enriched by images."""
    dense, sparse = hybrid(spark, sf_dir)
    c = S.weighted_rrf(tagged(dense, sparse)).select("query_id", "id", (F.col("score") * 30).alias("total"))
    scored = c.join(dense.select("query_id", "id", F.col("score").alias("ce")), ["query_id", "id"], "left").fillna(0.0, ["ce"])
    return S.merge_scores(scored, F.expr(f"{IS_IMAGE} AND {ENRICHED}"))


@query(_M + " SELECT query_id, id, round(total, 6) AS total, round(ce, 6) AS ce, round(final, 6) AS final FROM mm")
def rerank_merge(spark, sf_dir):
    return merged(spark, sf_dir).select("query_id", "id", r6("total"), r6("ce"), r6("final"))


_CUT = _M + """, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_image ORDER BY final DESC, id) AS n, row_number() OVER (PARTITION BY
query_id ORDER BY final DESC, id) AS overall,
least(10, sum(is_image::INT) OVER (PARTITION BY query_id)) AS images FROM mm),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY enriched AND is_image, final DESC, id) AS position FROM k
WHERE CASE WHEN enriched THEN CASE WHEN is_image THEN n <= images ELSE n <= 10 - images END ELSE overall <= 10 END)"""


def cut(spark, sf_dir: str) -> DataFrame:
    return S.final_cut(merged(spark, sf_dir).withColumn("is_image", F.expr(IS_IMAGE)), protect=F.expr(ENRICHED))


@query(_CUT + " SELECT query_id, id, is_image, round(final, 6) AS final, position FROM z")
def final_cut_with_images(spark, sf_dir):
    return cut(spark, sf_dir).select("query_id", "id", "is_image", r6("final"), "position")


@query(
    _CUT + """, y AS (SELECT *, CASE WHEN is_image THEN 'image' WHEN id % 7 = 3 THEN 'audio' WHEN id % 7 = 5 THEN 'video' ELSE 'doc' END AS
content_type FROM z),
k2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_type ORDER BY final DESC, id) AS nth FROM y),
l AS (SELECT * FROM k2 WHERE content_type NOT IN ('doc', 'image') OR nth <= CASE WHEN content_type = 'doc' THEN 15 WHEN enriched THEN 6 ELSE 5 END)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY list_position(['doc', 'image', 'audio', 'video'], content_type), final DESC, id) AS
ref_id, id, content_type FROM l"""
)
def context_references(spark, sf_dir):
    """References numbered by modality, within the quotas of documents and images."""
    kind = F.when(F.col("is_image"), "image").when(F.col("id") % 7 == 3, "audio").when(F.col("id") % 7 == 5, "video").otherwise("doc")
    most = F.when(F.col("content_type") == "doc", 15).when(F.col("content_type") == "image", F.when(F.expr(ENRICHED), 6).otherwise(5))
    n = F.row_number().over(Window.partitionBy("query_id", "content_type").orderBy(F.desc("final"), "id"))
    limited = cut(spark, sf_dir).withColumn("content_type", kind).withColumn("n", n).filter(most.isNull() | (F.col("n") <= most))
    place = F.array_position(F.lit(["doc", "image", "audio", "video"]), F.col("content_type"))
    ref = F.row_number().over(Window.partitionBy("query_id").orderBy(place, F.desc("final"), "id"))
    return limited.withColumn("ref_id", ref).select("query_id", "ref_id", "id", "content_type")


@query(
    f"""WITH {_E}, {_P}, {_R}, {_C}, {_D} SELECT query_id, count(*) AS hits, round(min(score), 6) AS low, round(max(score), 6) AS high,
round(avg(score), 6) AS mean FROM dn GROUP BY query_id"""
)
def hit_statistics(spark, sf_dir):
    return both_views(points(spark, sf_dir))[0].groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high"), F.round(F.avg("score"), 6).alias("mean"))


@query(
    f"""WITH {_E} SELECT id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squared, round(v[1] / sqrt(list_sum(list_transform(v, lambda x:
x * x))), 6) AS first FROM e"""
)
def unit_vectors(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("id", F.round(S.dot(F.col("vec"), F.col("vec")), 6).alias("squared"), F.round(S.unit(F.col("vec"))[0], 6).alias("first"))


@query("""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}|[一-龥]')) AS token FROM documents), t AS (SELECT doc_id, token,
count(*) AS weight FROM d GROUP BY ALL),
q0 AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}|[一-龥]')) AS token FROM benchmark), q AS (SELECT item_id, token, count(*) AS weight
FROM q0 GROUP BY ALL),
s AS (SELECT q.item_id AS query_id, t.doc_id AS id, sum(q.weight * t.weight) AS score FROM q JOIN t USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s) SELECT query_id, id, score::BIGINT AS score,
rank FROM r WHERE rank < 15""")
def sparse_search(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return S.sparse_search(tokens(items, "query_id", F.col("text"), "item_id"), saved(tokens(docs, "id", F.col("text")), "postings"))


@query("SELECT vec_id AS id, label AS kb_id FROM embeddings WHERE label IN (1, 3, 5) AND (vec_id % 2 IN (0) OR vec_id % 7 IN (0))")
def scope_filter(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kb_id"), (F.col("vec_id") % 2).alias("file_id"), (F.col("vec_id") % 7).alias("source_file_id"))
    return S.scope_filter(p, [1, 3, 5, 3], [0], ("file_id", "source_file_id")).select("id", "kb_id")


@query("""WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS c, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT label, i,
avg(c) AS c FROM x GROUP BY ALL), p AS (SELECT label, list(c ORDER BY i) AS m FROM a GROUP BY ALL),
d AS (SELECT label AS kb_id, vec_id AS id, list_distance(embedding::DOUBLE[], m) AS distance, count(*) OVER (PARTITION BY label) AS size FROM
embeddings JOIN p USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY distance, id) AS n FROM d) SELECT kb_id, id, round(distance, 6) AS distance, n FROM r
WHERE n <= least(15, greatest(10, size))""")
def nearest_members(spark, sf_dir):
    p = points(spark, sf_dir)
    means = portraits(p, 1).select("kb_id", F.col("vec").alias("mean"))
    apart = F.zip_with("vec", "mean", lambda x, y: x.cast("double") - y)
    far = p.join(means, "kb_id").select("kb_id", "id", F.sqrt(S.dot(apart, apart)).alias("distance"))
    size = far.groupBy("kb_id").agg(F.count(F.lit(1)).alias("size"))
    ranked = far.withColumn("n", F.row_number().over(Window.partitionBy("kb_id").orderBy("distance", "id"))).filter("n <= 15").join(size, "kb_id")
    return ranked.filter(F.col("n") <= F.least(F.lit(15), F.greatest(F.lit(10), F.col("size")))).select("kb_id", "id", r6("distance"), "n")
