"""Searches of single modalities, fusion by intent, and the choice of knowledge bases by scope, default and name.

Of the points, every fourth id from 1 is an image's, from 2 an audio's, from 3 a video segment's. What a query asks
for goes by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import intent as I
from lodestar.operators import rerank as K
from lodestar.operators import search as S
from lodestar.plans import retrieval as R
from lodestar.plans.registry import query, table

_BASE = f"WITH {R._E}, {R._P}, {R._R}, {R._C}"
_TURNED_Q, _TURNED_E = "list_concat(q.qv[33:64], q.qv[1:32])", "list_concat(e.v[33:64], e.v[1:32])"
_IMAGE, _AUDIO, _VIDEO = "id % 4 = 1", "id % 4 = 2", "id % 4 = 3"


def _hits(name: str, where: str, limit: int, low: str = "0", qv: str = "q.qv", ev: str = "e.v") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank
FROM
(SELECT c.query_id, e.id, list_cosine_similarity({ev}, {qv}) AS score FROM c JOIN q USING (query_id) JOIN e USING (kb_id) WHERE e.{where}) WHERE score
>= {low}) WHERE rank < {limit})"""


def _fused(name: str, routes: list[str], limit: str, low: str) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, id, rank FROM {r}" for r in routes)
    return f"""{name}0 AS (SELECT query_id, id, sum(1.0 / (2 + rank)) AS score FROM ({union}) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM {name}0 WHERE score >= {low})
WHERE rank < {limit})"""


def intent(shift: int = 0):
    """A query's intent, by its number."""
    kinds = F.array(*[F.lit(x) for x in (I.EXPLICIT, I.IMPLICIT, I.NONE)])
    return F.get(kinds, ((F.col("query_id") / R.EVERY).cast("int") + shift) % 3)


def _intent(shift: int = 0) -> str:
    return f"['explicit_demand', 'implicit_enrichment', 'unnecessary'][(query_id // 100 + {shift}) % 3 + 1]"


def route(p: DataFrame, where: str, limit: int, asking=None, stored=None) -> DataFrame:
    """A dense route over the points of one modality, with another of the query's or the points' vectors if told so."""
    scope = R.scoped(p)
    scope = scope if asking is None else scope.withColumn("query_vec", asking(F.col("query_vec")))
    base = p.filter(where)
    return S.dense_search(scope, base if stored is None else base.withColumn("vec", stored(F.col("vec"))), limit).select("query_id", "id", "score", "rank")


def fuse(routes: list[DataFrame], limit: int = 20, low: float = 0.0) -> DataFrame:
    every = routes[0].select("query_id", "id", "rank")
    for other in routes[1:]:
        every = every.union(other.select("query_id", "id", "rank"))
    return S.store_fusion(every, limit, low)


_DUAL = ", ".join([_hits("t", _IMAGE, 40), _hits("k", _IMAGE, 40, qv=_TURNED_Q), _fused("fz", ["t", "k"], "20", "0")])


@query(
    f"""{_BASE}, {_DUAL} SELECT fz.query_id, fz.id, round(fz.score, 6) AS score, round(coalesce(t.score, 0), 6) AS text_vec, round(coalesce(k.score,
0), 6) AS clip_vec
FROM fz LEFT JOIN t USING (query_id, id) LEFT JOIN k USING (query_id, id)"""
)
def image_score_details(spark, sf_dir):
    """Each fused image with its score by either vector, 0 where that route has not got it."""
    p = R.points(spark, sf_dir)
    text, clip = route(p, _IMAGE, 40), route(p, _IMAGE, 40, asking=R.turned)
    out = fuse([text, clip])
    for name, one in (("text_vec", text), ("clip_vec", clip)):
        out = out.join(one.select("query_id", "id", F.col("score").alias(name)), ["query_id", "id"], "left")
    return out.select("query_id", "id", R.r6("score"), *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("text_vec", "clip_vec")])


@query(
    f"""{_BASE}, {_hits('t', _AUDIO, 40)}, {_hits('k', _AUDIO, 40, qv=_TURNED_Q)},
u AS (SELECT *, {_intent()} AS asked FROM (SELECT query_id, id, rank FROM t UNION ALL SELECT query_id, id, rank FROM k WHERE query_id % 500 <> 0)),
f AS (SELECT query_id, id, asked, sum(1.0 / (2 + rank)) AS score FROM u WHERE asked <> 'unnecessary' GROUP BY ALL),
gz AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM f WHERE query_id % 500 = 0 OR asked =
'explicit_demand' OR score >= 0.2)
SELECT query_id, id, round(score, 6) AS score, rank FROM gz WHERE rank < CASE WHEN query_id % 500 <> 0 AND asked = 'implicit_enrichment' THEN 20 ELSE
10 END"""
)
def audio_search(spark, sf_dir):
    """Nothing where audio isn't asked for; text and sound vectors fused, with twice the rows and a threshold where it only enriches;
    the text vector alone where the sound vector is missing."""
    p = R.points(spark, sf_dir)
    single, enriching = F.col("query_id") % 500 == 0, intent() == I.IMPLICIT
    hits = route(p, _AUDIO, 40).union(route(p, _AUDIO, 40, asking=R.turned).filter(~single)).filter(intent() != I.NONE)
    least = F.when(~single & enriching, 0.2).otherwise(0.0)
    scored = S.store_fusion(hits.select("query_id", "id", "rank"), 80).filter(F.col("score") >= least)
    return scored.filter(F.col("rank") < F.when(~single & enriching, 20).otherwise(10)).select("query_id", "id", R.r6("score"), "rank")


@query(
    f"""{_BASE}, {_hits('va', _VIDEO, 40)}, {_hits('vb', _VIDEO, 40, ev=_TURNED_E)}, {_hits('vk', _VIDEO, 40, qv=_TURNED_Q)},
{_fused('f', ['va', 'vb', 'vk'], '20', '0')}
SELECT query_id, id, round(score, 6) AS score, rank FROM f"""
)
def video_search(spark, sf_dir):
    """One text vector on the fields of scene and frame, and a picture vector, fused."""
    p = R.points(spark, sf_dir)
    return fuse([route(p, _VIDEO, 40), route(p, _VIDEO, 40, stored=R.turned), route(p, _VIDEO, 40, asking=R.turned)]).select("query_id", "id", R.r6("score"), "rank")


@query(
    f"""{_BASE}, {_hits('t', _IMAGE, 40)}, {_hits('k', _IMAGE, 40, qv=_TURNED_Q)}, {_hits('va', _VIDEO, 40)}, {_hits('vk', _VIDEO, 40, qv=_TURNED_Q)},
{_fused('fz', ['t', 'k'], '20', "CASE WHEN " + _intent() + " = 'implicit_enrichment' THEN 0.3 ELSE 0 END")},
{_fused('fv', ['va', 'vk'], '20', "CASE WHEN " + _intent() + " = 'implicit_enrichment' THEN 0.3 ELSE 0 END")}
SELECT query_id, id, round(score, 6) AS score, false AS from_keyframe FROM fz WHERE {_intent()} <> 'unnecessary'
UNION ALL SELECT query_id, id, round(score, 6), true FROM fv WHERE {_intent()} <> 'unnecessary' AND id % 8 = 3"""
)
def visual_search(spark, sf_dir):
    """Images by two vectors, with a threshold where they only enrich; key frames that have a picture join them."""
    p, least = R.points(spark, sf_dir), F.when(intent() == I.IMPLICIT, 0.3).otherwise(0.0)
    out = None
    for where, keyframe in ((_IMAGE, False), (_VIDEO, True)):
        hits = fuse([route(p, where, 40), route(p, where, 40, asking=R.turned)], 20).filter((F.col("score") >= least) & (intent() != I.NONE))
        hits = (hits.filter("id % 8 = 3") if keyframe else hits).select("query_id", "id", R.r6("score"), F.lit(keyframe).alias("from_keyframe"))
        out = hits if out is None else out.unionByName(hits)
    return out


@query(
    f"""WITH {R._E}, {R._P}, n AS (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY m) AS n FROM p) SELECT kb_id, m::BIGINT AS cluster,
round(v[1], 6) AS first FROM n WHERE n <= 3"""
)
def portraits_of_kb(spark, sf_dir):
    """A knowledge base's portraits, the first few."""
    own = R.portraits(R.points(spark, sf_dir))
    n = F.row_number().over(Window.partitionBy("kb_id").orderBy("cluster"))
    return own.withColumn("n", n).filter("n <= 3").select("kb_id", F.col("cluster").cast("long").alias("cluster"), F.round(F.get("vec", F.lit(0)), 6).alias("first"))


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN '  ' ELSE NULL END AS dense, CASE turn % 4 WHEN 2 THEN ['b',
role] ELSE [] END AS keywords, CASE WHEN conv_id % 2 = 0 THEN role ELSE ' ' END AS original FROM conversations),
c AS (SELECT conv_id, turn, trim(coalesce(nullif(trim(dense), ''), nullif(array_to_string(keywords, ' '), ''), original, '')) AS q FROM t) SELECT
conv_id, turn, md5(q) AS digest FROM c WHERE q <> ''""")
def sparse_query_text(spark, sf_dir):
    """What the sparse route asks with: the dense query, else the keywords, else the question itself; blank asks for nothing."""
    k = F.col("turn") % 4
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(k == 0, F.col("text")).when(k == 1, "  ").alias("dense"),
        F.when(k == 2, F.array(F.lit("b"), F.col("role"))).otherwise(F.array().cast("array<string>")).alias("keywords"),
        F.when(F.col("conv_id") % 2 == 0, F.col("role")).otherwise(" ").alias("original"),
    )
    q = S.sparse_text(F.col("dense"), F.col("keywords"), F.col("original"))
    return c.select("conv_id", "turn", F.md5(q.cast("binary")).alias("digest")).filter(F.col("digest").isNotNull())


_TYPES = ("CASE WHEN route = 'visual' THEN 'image' WHEN route = 'video' THEN 'video' ELSE 'doc' END", {"visual": "image", "video": "video"})
_BY_INTENT = f"""{_BASE}, {R._S}, {R._D}, {_hits('vi', 'id % 2 = 1', 20, qv=_TURNED_Q)}, {_hits('vd', _VIDEO, 20)},
u AS (SELECT query_id, id, rank, 'dense' AS route, 1 AS o FROM dn UNION ALL SELECT query_id, id, rank, 'sparse', 2 FROM sn
UNION ALL SELECT query_id, id, rank, 'visual', 3 FROM vi UNION ALL SELECT query_id, id, rank, 'video', 5 FROM vd),
w AS (SELECT *, {_TYPES[0]} AS content_type, CASE route WHEN 'dense' THEN 1.0 WHEN 'sparse' THEN 0.8
WHEN 'visual' THEN CASE {_intent()} WHEN 'explicit_demand' THEN CASE WHEN {_intent(1)} = 'explicit_demand' THEN 0.9 ELSE 1.2 END WHEN
'implicit_enrichment' THEN 0.9 ELSE 0.0 END
ELSE CASE {_intent(1)} WHEN 'explicit_demand' THEN 1.2 WHEN 'implicit_enrichment' THEN 1.0 ELSE 1.1 END END AS w FROM u),
f AS (SELECT query_id, id, sum(w / (60 + rank)) AS score, CASE WHEN bool_or(content_type = 'video') THEN 'video' ELSE arg_min(content_type, o) END AS
content_type, arg_max(route, o) AS payload_route FROM w GROUP BY query_id, id)"""


def routes_by_intent(spark, sf_dir: str) -> DataFrame:
    """Hits of four routes with what they found: (query_id, id, rank, score, route, content_type)."""
    p = R.points(spark, sf_dir)
    dense, sparse = R.hybrid(spark, sf_dir, p)
    own = {"dense": dense, "sparse": sparse.withColumn("score", F.col("score").cast("double")), "visual": route(p, "id % 2 = 1", 20, asking=R.turned), "video": route(p, _VIDEO, 20)}
    out = None
    for name, hits in own.items():
        rows = hits.select("query_id", "id", "rank", "score", F.lit(name).alias("route"), F.lit(_TYPES[1].get(name, "doc")).alias("content_type"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_BY_INTENT + " SELECT query_id, id, round(score, 8) AS score, content_type, payload_route, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM f) WHERE rank < 50")
def fusion_by_intent(spark, sf_dir):
    """Rank fusion whose weights follow the intents; where routes find the same point, video wins."""
    hits = routes_by_intent(spark, sf_dir)
    weight = I.route_weight(F.col("route"), intent(), F.lit(I.NONE), intent(1), S.ROUTE_WEIGHTS)
    fused = S.weighted_rrf(hits, weight).join(S.settled_types(hits), ["query_id", "id"])
    return fused.select("query_id", "id", F.round("score", 8).alias("score"), "content_type", "payload_route", "rank")


@query(
    _BY_INTENT.replace("query_id, id, rank, '", "query_id, id, rank, score, '") + """, t AS (SELECT query_id, id, o, rank, content_type, round(CASE
route WHEN 'video' THEN score * 2 WHEN 'visual' THEN score + 0.5 ELSE score END, 6) AS total FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY content_type = 'video' DESC, CASE WHEN content_type = 'video' THEN -o ELSE o
END) AS n FROM t)
SELECT query_id, id, content_type, total, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, id) AS place FROM k
WHERE n = 1) WHERE place <= 50"""
)
def coarse_list(spark, sf_dir):
    """Candidates of all routes, each by the total it brings, the sum of its scores or its score; once per id, video first."""
    hits = routes_by_intent(spark, sf_dir)
    total = F.when(F.col("route") == "video", F.col("score") * 2)
    scores = F.when(F.col("route") == "visual", F.create_map(F.lit("a"), F.col("score"), F.lit("b"), F.lit(0.5)))
    own = hits.withColumn("total", F.round(K.total_score(total, scores, F.col("score")), 6))
    return K.coarse(own, F.array_position(F.lit(list(S.ROUTE_WEIGHTS)), F.col("route"))).select("query_id", "id", "content_type", "total", "place")


_SHOWN = """CASE doc_id % 4 WHEN 0 THEN concat('[音频/歌曲] 来源: f', doc_id, chr(10), '转写/歌词: ', t, chr(10), '描述: ', coalesce(source, '')) WHEN 1 THEN concat('[视频] 来源: f', doc_id, chr(10), '描述: ', t)
WHEN 2 THEN concat('[文档片段] 来源: f', doc_id, chr(10), '内容: ', t) ELSE concat('[图片描述] 来源: f', doc_id, chr(10), '描述: ', t) END"""


@query(
    f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, {_SHOWN} AS s FROM d) SELECT doc_id, md5(CASE
WHEN length(s) > 1000 THEN left(s, 997) || '...' ELSE s END) AS digest FROM s"""
)
def rerank_texts(spark, sf_dir):
    """What a candidate of each modality is scored by."""
    kind = F.get(F.array(*[F.lit(x) for x in ("audio", "video", "doc", "image")]), (F.col("doc_id") % 4).cast("int"))
    shown = K.scored_text(kind, F.concat(F.lit("f"), "doc_id"), F.col("text"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(shown.cast("binary")).alias("digest"))


@query(
    """SELECT p_partkey, i::INT AS idx, CASE WHEN p_partkey % 5 = 4 THEN 0.5 ELSE round(p_size / 100.0 + i, 2) END::DOUBLE AS score FROM part,
(SELECT unnest([0, 1]) AS i) WHERE p_partkey % 5 <> 3"""
)
def reranker_answers(spark, sf_dir):
    """Scores from answers as a list, under ``results`` or ``data``, inside prose, or without positions."""
    p = table(spark, sf_dir, "part")
    value = lambda i: F.round(F.col("p_size") / 100.0 + i, 2).cast("double")
    listed = F.to_json(F.array(*[F.struct(F.lit(i).alias("index"), value(i).alias("relevance_score")) for i in (0, 1)]))
    wrap = lambda name: F.concat(F.lit(f'{{"{name}": '), listed, F.lit("}"))
    bare = F.lit('[{"score": 0.5}, {"rank_score": 0.5}]')
    k = F.col("p_partkey") % 5
    answer = F.when(k == 0, listed).when(k == 1, wrap("results")).when(k == 2, F.concat(F.lit("scores: "), wrap("data"), F.lit(" end"))).when(k == 3, "none").otherwise(bare)
    return p.select("p_partkey", F.explode(K.answer_scores(answer)).alias("s")).select("p_partkey", F.col("s.idx").alias("idx"), F.col("s.score").alias("score"))


@query(
    f"""{_BASE}, k AS (SELECT DISTINCT kb_id FROM e),
cs AS (SELECT query_id, CASE WHEN query_id % 400 = 0 THEN 'explicit' WHEN query_id % 400 = 100 THEN 'default_all' WHEN query_id % 400 = 200 THEN
'no_portraits' END AS m FROM q)
SELECT cs.query_id, c.kb_id, c.method, round(c.norm, 6) AS confidence FROM cs JOIN c USING (query_id) WHERE m IS NULL
UNION ALL SELECT query_id, kb_id, m, 1.0 FROM cs, k WHERE m = 'default_all' OR m = 'explicit' AND kb_id IN (1, 4)
UNION ALL SELECT query_id, NULL, m, NULL FROM cs WHERE m = 'no_portraits'"""
)
def routing_methods(spark, sf_dir):
    """Knowledge bases that a scope names, all of them where a query has no vector, none where there is no portrait, else those chosen by portraits."""
    p = R.points(spark, sf_dir)
    kbs = p.select("kb_id").distinct()
    q = R.asked(p).select("query_id")
    k = F.col("query_id") % 400
    named = q.filter(k == 0).select("query_id", F.explode(F.lit([1, 4])).alias("kb_id"))  # the scope that these queries name
    cases = q.withColumn("embedded", k != 100).withColumn("with_portraits", k != 200)
    return K.routed(cases, named, R.decided(p), kbs).select("query_id", "kb_id", "method", F.round("confidence", 6).alias("confidence"))


@query("""WITH s AS (SELECT c_custkey, [' ' || (c_nationkey % 5), 'b' || c_nationkey, '', 'b' || (c_nationkey % 5)] AS given FROM customer), x AS
(SELECT c_custkey, unnest(given) AS g, generate_subscripts(given, 1) AS i FROM s),
r AS (SELECT c_custkey, i, CASE WHEN g IN ('b1', 'b3') THEN substring(g, 2) ELSE trim(g) END AS kb FROM x WHERE g <> ''), f AS (SELECT c_custkey, kb,
min(i) AS i FROM r WHERE kb <> '' GROUP BY ALL)
SELECT c_custkey, string_agg(kb, ',' ORDER BY i) AS kbs FROM f GROUP BY c_custkey""")
def resolved_kbs(spark, sf_dir):
    """Given ids, some of them of buckets, as the ids under which points are stored; each once, in order."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_nationkey")
    given = F.array(F.concat(F.lit(" "), (n % 5).cast("string")), F.concat(F.lit("b"), n.cast("string")), F.lit(""), F.concat(F.lit("b"), (n % 5).cast("string")))
    stored = F.create_map(F.lit("b1"), F.lit("1"), F.lit("b3"), F.lit("3"))
    return c.select("c_custkey", F.array_join(K.canonical_kbs(given, stored), ",").alias("kbs"))
