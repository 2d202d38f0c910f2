"""Queries on prompts and answers: materials, contexts, citations, rows for clients, stages of a query, states that expire.

The references of a context are the first documents of a source; what a document is goes by its number (modulo 4).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import context as X
from lodestar.plans.registry import query, table
from lodestar.streaming import state

_CLEAN = r"""trim(regexp_replace(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s.,;:!?\-()\[\]"''/\\]', ' ', 'g'))"""
_REFS = """r0 AS (SELECT doc_id, source, text, lang, doc_id % 4 AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id % 4, doc_id) AS ref_id
FROM documents),
r AS (SELECT *, ['doc', 'image', 'audio', 'video'][k + 1] AS content_type, ['文档', '图片', '音频', '视频'][k + 1] AS label, 'dir/f' || doc_id AS path FROM r0
WHERE ref_id <= 12)"""
_CUT = "CASE WHEN length({0}) > {1} THEN left({0}, {1}) || '...' ELSE {0} END"
_LONG = "CASE WHEN doc_id % 8 = 7 THEN '未知' ELSE concat(doc_id // 60, '分', doc_id % 60, '秒') END"
_FRAMES = "CASE WHEN doc_id % 8 = 7 THEN '无关键帧信息' ELSE array_to_string(list_transform([0, 1, 2, 3, 4], lambda i: concat('- ', (doc_id + 61 * i) // 60, ':', lpad(((doc_id + 61 * i) % 60)::VARCHAR, 2, '0'), ' - frame ', i)), chr(10)) END"
_MATERIALS = f"""{_REFS}, c AS (SELECT *, {_CLEAN.format('text')} AS t, {_CLEAN.format('lang')} AS l FROM r),
m AS (SELECT *, concat('【材料 ', ref_id, '】 (类型: ', label, ' | 来源: ', path, ')', chr(10), CASE k WHEN 0 THEN concat('内容片段：', chr(10),
{_CUT.format('t', 500)}) WHEN 1 THEN concat('[视觉描述]：', chr(10), {_CUT.format('t', 300)})
WHEN 2 THEN concat('时长：', {_LONG}, chr(10), '转写文本：', chr(10), {_CUT.format('t', 500)}, chr(10), '描述：', l) ELSE concat('时长：', {_LONG}, chr(10), '描述：',
t, chr(10), '关键帧：', chr(10), {_FRAMES}) END) AS material FROM c)"""


def md5(c):
    return F.md5(c.cast("binary"))


def references(spark, sf_dir: str):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang", (F.col("doc_id") % 4).alias("k"))
    few = d.withColumn("ref_id", F.row_number().over(Window.partitionBy("source").orderBy("k", "doc_id"))).filter("ref_id <= 12")
    kind = F.get(F.array(*[F.lit(x) for x in X.LABELS]), F.col("k").cast("int"))
    return few.withColumn("content_type", kind).withColumn("path", F.concat(F.lit("dir/f"), "doc_id"))


def materials(spark, sf_dir: str):
    known = F.col("doc_id") % 8 != 7
    frames = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct((F.col("doc_id") + 61 * i).alias("at"), F.concat(F.lit("frame "), i.cast("string")).alias("text")))
    seconds = F.when(known, F.col("doc_id").cast("double")).otherwise(0.0)
    shown = X.material(F.col("ref_id"), F.col("content_type"), F.col("path"), F.col("text"), F.col("lang"), seconds, F.when(known, frames).otherwise(F.slice(frames, 1, 0)))
    return references(spark, sf_dir).withColumn("material", shown)


@query(f"WITH {_MATERIALS} SELECT source, ref_id, content_type, md5(material) AS digest FROM m WHERE k <> 2 OR doc_id > 0")
def formatted_materials(spark, sf_dir):
    return materials(spark, sf_dir).filter("k <> 2 OR doc_id > 0").select("source", "ref_id", "content_type", md5(F.col("material")).alias("digest"))


@query(
    f"""WITH {_MATERIALS} SELECT source, md5(concat('参考材料列表：', chr(10), chr(10), CASE WHEN bool_or(k > 0) THEN concat('{X.MEDIA_NOTE.strip()}',
chr(10), chr(10)) ELSE '' END,
string_agg(material || chr(10), chr(10) ORDER BY ref_id), chr(10), '用户问题：what of ', source)) AS digest FROM m WHERE k <> 2 OR doc_id > 0 GROUP BY
source"""
)
def context_strings(spark, sf_dir):
    """A query's materials in their order, with the note on media and the question."""
    m = materials(spark, sf_dir).filter("k <> 2 OR doc_id > 0")
    return X.assembled(m, "source", F.concat(F.lit("what of "), "source")).select("source", md5(F.col("context")).alias("digest"))


@query(
    f"""WITH {_MATERIALS}, c0 AS (SELECT source, concat('参考材料列表：', chr(10), chr(10), CASE WHEN bool_or(k > 0) THEN concat('{X.MEDIA_NOTE.strip()}',
chr(10), chr(10)) ELSE '' END, string_agg(material || chr(10), chr(10) ORDER BY ref_id), chr(10), '用户问题：', repeat('word ', CASE WHEN source > 'src5' THEN
4200 ELSE 9 END), source) AS context, count(*) AS refs FROM m GROUP BY source),
a AS (SELECT *, CASE WHEN source LIKE '%1' THEN concat('{X.ATTACHED.strip()}', chr(10), chr(10), 'media of ', source, chr(10), chr(10), context) ELSE context END AS
whole FROM c0), t AS (SELECT *, len(string_split_regex(trim(regexp_replace(whole, '\\s+', ' ', 'g')), ' ')) AS tokens FROM a),
n AS (SELECT source, concat('参考材料列表：', chr(10), chr(10), string_agg(concat('【材料 ', ref_id, '】 (类型: ', CASE k WHEN 0 THEN '文档' ELSE '图片' END, ' | 来源: ', path,
')', chr(10), CASE k WHEN 0 THEN '内容片段：' ELSE '[视觉描述]：' END, chr(10), left(coalesce(text, ''), greatest(100, (4000 // refs))::INT), '...', chr(10)), chr(10) ORDER BY
ref_id)) AS short FROM m JOIN c0 USING (source) GROUP BY source)
SELECT source, tokens::INT AS tokens, md5(CASE WHEN tokens > 4000 THEN short ELSE whole END) AS digest FROM t JOIN n USING (source)"""
)
def shortened_contexts(spark, sf_dir):
    """Contexts with what was uploaded before them; those that are too long are made anew from the beginnings of their references."""
    m = materials(spark, sf_dir)
    question = F.concat(F.repeat(F.lit("word "), F.when(F.col("source") > "src5", 4200).otherwise(9)), "source")
    upload = F.when(F.col("source").endswith("1"), F.concat(F.lit(" media of "), "source"))
    whole = X.assembled(m, "source", question).select("source", X.attached(F.col("context"), upload).alias("context"))
    out = X.shortened(whole, references(spark, sf_dir).withColumn("content", F.col("text")), "source")
    return out.select("source", F.col("tokens").cast("int").alias("tokens"), md5(F.col("context")).alias("digest"))


@query(
    f"""WITH {_REFS}, v AS (SELECT *, max(ref_id) OVER (PARTITION BY source) AS last FROM r), f AS (SELECT source, doc_id, ref_id AS of_video, last, i FROM v,
range(0, 4) x(i) WHERE k = 3 AND i < doc_id % 5 AND i <> 2)
SELECT source, ref_id::INT AS ref_id, content_type, path, NULL::INT AS of_video FROM v UNION ALL SELECT source, (last + row_number() OVER (PARTITION BY source ORDER BY
of_video, i))::INT, 'image', concat('videos/', doc_id, '/keyframes/', i, '.jpg'), of_video::INT FROM f"""
)
def keyframe_references(spark, sf_dir):
    """The references of a context with the frames of its videos as further images; a frame without a picture is none."""
    r = references(spark, sf_dir).withColumn("content", F.col("text"))
    i = F.explode(F.sequence(F.lit(0), F.least(F.lit(3), (F.col("doc_id") % 5 - 1).cast("int"))))
    frames = r.filter("doc_id % 5 > 0").select("source", "ref_id", "doc_id", i.alias("nth"))
    frames = frames.select("source", "ref_id", "nth", F.when(F.col("nth") != 2, F.format_string("videos/%d/keyframes/%d.jpg", "doc_id", "nth")).alias("path"), F.lit("frame").alias("text"))
    out = X.with_keyframes(r.select("source", "ref_id", "content_type", "path", "content"), frames, "source")
    return out.select("source", F.col("ref_id").cast("int").alias("ref_id"), "content_type", "path", F.col("of_video").cast("int").alias("of_video"))


@query("""SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 0 THEN concat('用户问题：', text) ELSE concat('以下是根据检索结果整理的参考材料，以及用户的最新问题。', chr(10), chr(10), '---',
chr(10), 'some ', role, chr(10), '---', chr(10), chr(10), '用户问题：', text) END) AS digest FROM conversations WHERE text IS NOT NULL""")
def user_turns(spark, sf_dir):
    context = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("some "), "role"))
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return c.select("conv_id", "turn", md5(X.asked_with(F.col("text"), context)).alias("digest"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 < 2 AND doc_id % 2 = 0 THEN '缺少标准引用格式' END, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0
THEN '没有找到引用编号' END) AS warnings FROM documents""")
def format_warnings(spark, sf_dir):
    n = F.col("doc_id")
    kind = F.get(F.array(F.lit("doc"), F.lit("image"), F.lit("audio")), (n % 3).cast("int"))
    text = F.concat(F.when(n % 2 == 0, "【材料】 ").otherwise("【材料 12】 "), F.when(n % 5 == 0, "see [3]").otherwise("see [x]"))
    return table(spark, sf_dir, "documents").select("doc_id", X.warnings(text, kind).alias("warnings"))


@query(
    f"""WITH {_REFS} SELECT source, ref_id, md5(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END) AS preview, count(*) OVER
(PARTITION BY source, content_type) AS of_type FROM r WHERE text IS NOT NULL"""
)
def reference_previews(spark, sf_dir):
    kinds = F.count(F.lit(1)).over(Window.partitionBy("source", "content_type"))
    r = references(spark, sf_dir).filter("text IS NOT NULL")
    return r.select("source", "ref_id", md5(X.preview(F.col("text"))).alias("preview"), kinds.alias("of_type"))


_CITED = f"""WITH {_REFS}, n AS (SELECT source, unnest([3, 1, 3, 99, 2, 5, 4]) AS ref_id, unnest([1, 2, 3, 4, 5, 6, 7]) AS o FROM (SELECT DISTINCT
source FROM r)), f AS (SELECT source, ref_id, min(o) AS o FROM n GROUP BY ALL),
j AS (SELECT f.source, f.ref_id, f.o, CASE WHEN r.ref_id <= 3 THEN 'c' || (r.ref_id // 2) ELSE '' END AS chunk_id, CASE WHEN r.ref_id = 5 THEN
'dir/shared' WHEN r.ref_id = 4 THEN 'dir/shared' ELSE r.path END AS path FROM f JOIN r ON r.source = f.source AND r.ref_id = f.ref_id),
d AS (SELECT *, row_number() OVER (PARTITION BY source, coalesce(nullif(chunk_id, ''), path) ORDER BY o) AS n FROM j), v AS (SELECT *, row_number()
OVER (PARTITION BY source ORDER BY o) AS place FROM d WHERE n = 1)"""


def cited(spark, sf_dir: str):
    id_ = F.col("ref_id")
    r = references(spark, sf_dir).withColumn("chunk_id", F.when(id_ <= 3, F.concat(F.lit("c"), F.expr("ref_id div 2"))).otherwise(""))
    r = r.withColumn("path", F.when(id_.isin(4, 5), "dir/shared").otherwise(F.col("path"))).select("source", "ref_id", "chunk_id", "path")
    answers = r.select("source").distinct().withColumn("answer", F.lit("As [3] and [1] say, [3] again, not [99]; [2], [5] and [4]."))
    return X.cited(answers, r, "source"), r


@query(_CITED + " SELECT source, ref_id::VARCHAR AS ref_id, chunk_id, path, place FROM v")
def citation_details(spark, sf_dir):
    """What an answer cites, once per chunk or path, in its order."""
    return cited(spark, sf_dir)[0].select("source", "ref_id", "chunk_id", "path", "place")


@query(_CITED + " SELECT source, ref_id::VARCHAR AS ref_id, CASE WHEN ref_id % 2 = 1 THEN 'known/' || ref_id ELSE path END AS path, chunk_id FROM v")
def completed_citations(spark, sf_dir):
    """Cited references with the fields that were known of them before the answer."""
    found, r = cited(spark, sf_dir)
    base = r.filter("ref_id <> 1 OR source IS NOT NULL").select("source", F.col("ref_id").cast("string").alias("ref_id"), F.when(F.col("ref_id") % 2 == 1, F.concat(F.lit("known/"), "ref_id")).otherwise("").alias("path"), F.lit(None).cast("string").alias("chunk_id"))
    return X.completed(found, base, "source", ["path", "chunk_id"]).select("source", "ref_id", "path", "chunk_id")


@query(f"""WITH {_REFS}, w AS (SELECT doc_id AS chunk_id, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS p, lead(lang) OVER (PARTITION BY
source ORDER BY doc_id) AS n FROM documents)
SELECT source, ref_id, content_type AS type, 'f' || doc_id AS file_name, md5(left(coalesce(text, ''), 500)) AS content, CASE WHEN k = 0 THEN
coalesce(p, '') END AS prev, CASE WHEN k = 0 THEN coalesce(n, '') END AS next FROM r JOIN w ON w.chunk_id = r.doc_id""")
def client_references(spark, sf_dir):
    """References as rows for clients, documents with the text around them."""
    w = Window.partitionBy("source").orderBy("doc_id")
    near = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lag("lang").over(w).alias("prev"), F.lead("lang").over(w).alias("next"))
    r = references(spark, sf_dir).withColumn("content", F.col("text")).withColumn("score", F.lit(0.0)).withColumn("chunk_id", F.col("doc_id"))
    return X.client_rows(r, near, "source").select("source", "ref_id", "type", "file_name", md5(F.col("content")).alias("content"), "prev", "next")


@query("""WITH q AS (SELECT conv_id AS query_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT query_id, p AS place, ['connected', 'intent',
'routing', 'retrieval', 'message', 'citation', 'complete'][p] AS stage FROM q, (SELECT unnest([1, 2, 3, 4, 5, 6, 7])::INT AS p) WHERE p <> 6 OR n > 3""")
def stage_events(spark, sf_dir):
    """What a client is told of a query, in order: stages as they end, messages, citations if there are any."""
    q = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.count(F.lit(1)).alias("n"))
    return state.staged(q, F.col("n") > 3).select("query_id", "place", "stage")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 2 = 0 THEN event_type END AS stage, CASE WHEN event_id % 3 = 0 THEN event_id %
101 END AS progress FROM events),
l AS (SELECT user_id, arg_max(stage, (ts, event_id)) FILTER (stage IS NOT NULL) AS stage, arg_max(progress, (ts, event_id)) FILTER (progress IS NOT
NULL) AS progress FROM e GROUP BY user_id) SELECT user_id, coalesce(stage, 'initializing') AS stage, coalesce(progress, 0)::BIGINT AS progress FROM l""")
def processing_status(spark, sf_dir):
    """The state of each job after its updates, each of which may carry only some fields."""
    e = table(spark, sf_dir, "events").withColumn("stage", F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).withColumn("progress", F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 101))
    return state.latest(e, "user_id", ["ts", "event_id"], {"stage": "initializing", "progress": 0})


@query("SELECT user_id, event_id FROM events WHERE (SELECT max(ts) FROM events) - ts <= INTERVAL 604800 second")
def live_questions(spark, sf_dir):
    """Cached rows that aren't older than a week, seen from the last one."""
    e = table(spark, sf_dir, "events")
    last = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    return state.alive(e.crossJoin(last), "ts", F.col("now"), 7 * 86400).select("user_id", "event_id")


@query("""WITH s AS (SELECT user_id, min(ts) AS begun, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id), t AS (SELECT max(ts) - INTERVAL
40000 second AS now FROM events) SELECT user_id, n, now - begun > INTERVAL 3600 second AS expired FROM s, t WHERE begun <= now""")
def stream_sessions(spark, sf_dir):
    """Streams at a time: how many events they have sent in all, and whether they have outlived an hour."""
    e = table(spark, sf_dir, "events")
    last = F.broadcast(e.agg((F.max("ts") - F.expr("INTERVAL 40000 SECONDS")).alias("now")))  # one row
    s = e.groupBy("user_id").agg(F.min("ts").alias("begun"), F.count(F.lit(1)).alias("n")).crossJoin(last).filter(F.col("begun") <= F.col("now"))
    return s.select("user_id", "n", (~state.within(F.col("begun"), F.col("now"), 3600)).alias("expired"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
event_type = 'purchase' AS taking FROM events),
r AS (SELECT user_id, i, t, taking, CASE WHEN taking THEN []::BIGINT[] ELSE [event_id] END AS held, CASE WHEN taking THEN []::BIGINT[] END AS taken, event_id FROM e WHERE
i = 1 UNION ALL
SELECT e.user_id, e.i, CASE WHEN e.taking OR len(k) < 3 THEN e.t ELSE r.t END, e.taking, CASE WHEN e.taking THEN []::BIGINT[] WHEN len(k) < 3 THEN
list_append(k, e.event_id) ELSE k END, CASE WHEN e.taking THEN k END, e.event_id
FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1, LATERAL (SELECT CASE WHEN r.taking OR e.t - r.t > 120000000 THEN []::BIGINT[] ELSE r.held
END AS k) x) SELECT user_id, event_id AS at, array_to_string(taken, ',') AS items FROM r WHERE taking""")
def pending_attachments(spark, sf_dir):
    """What waits when a message takes all: at most three items, none after a pause of two minutes."""
    e = table(spark, sf_dir, "events").withColumn("taking", F.col("event_type") == "purchase")
    return state.taken(e, "user_id", "event_id", "ts", "taking").select("user_id", "at", "items")
