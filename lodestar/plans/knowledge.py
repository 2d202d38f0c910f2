"""Queries on knowledge bases: what they hold, their portraits, their questions, and changes to them.

A document's knowledge base is its source; its modality goes by its number: 0 a text, 1 an image, 2 a sound, 3 a
video's key frame (modulo 4).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import markup as M
from lodestar.functions import names as N
from lodestar.functions import text as T
from lodestar.operators import portraits as P
from lodestar.operators import search as S
from lodestar.plans import retrieval as R
from lodestar.plans.registry import query, table
from lodestar.session import saved

SAMPLE_TEXTS, SAMPLE_IMAGES, TOPIC_TEXTS, TOPICS, TOPIC_CHARS, TOPIC_WORDS = 100, 50, 10, 5, 50, 3


def n(alias: str):
    return F.count(F.lit(1)).alias(alias)


def modality(c: str):
    return F.get(F.array(*[F.lit(m) for m in P.MODALITIES]), (F.col(c) % 4).cast("int"))


_MODALITY = "['doc', 'image', 'audio', 'video'][{} % 4 + 1]"


@query(
    f"""WITH d AS (SELECT source, doc_id, lang, trim(regexp_replace(left(text, {TOPIC_CHARS}), '^[ \\n\\t]+|[ \\n\\t]+$', '', 'g')) AS s, doc_id % 3 =
0 AS image FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source, image ORDER BY doc_id) AS n FROM d), k AS (SELECT * FROM r WHERE n <= CASE WHEN image THEN
{SAMPLE_IMAGES} ELSE {SAMPLE_TEXTS} END),
t AS (SELECT source, s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM k WHERE NOT image AND n <= {TOPIC_TEXTS} AND s <> ''),
w AS (SELECT source, array_to_string(list_filter(regexp_split_to_array(s, '[ \\n\\t]+'), lambda x: x <> '')[1:{TOPIC_WORDS}], ' ') AS topic, min(i) AS
i FROM t WHERE i <= {TOPICS} GROUP BY ALL),
l AS (SELECT source, string_agg(topic, ' | ' ORDER BY i) AS topics FROM w GROUP BY source),
f AS (SELECT source, string_agg(DISTINCT CASE WHEN image THEN 'png' ELSE lang END, ',' ORDER BY CASE WHEN image THEN 'png' ELSE lang END) AS formats,
count(*) AS sample_count,
CASE WHEN bool_or(NOT image) AND bool_or(image) THEN 'document,image' WHEN bool_or(image) THEN 'image' ELSE 'document' END AS kinds FROM k GROUP BY
source)
SELECT f.source AS kb_id, formats, kinds, sample_count, md5(coalesce(topics, '未分类内容')) AS topics FROM f LEFT JOIN l USING (source)""".replace("\\n", "\n").replace("\\t", "\t")
)
def content_summary(spark, sf_dir):
    """What a knowledge base is about, from its first texts and images (the feature's own bounds): kinds, formats, topics."""
    sample = F.trim(F.regexp_replace(F.left("text", F.lit(TOPIC_CHARS)), r"^[ \n\t]+|[ \n\t]+$", ""))
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", sample.alias("s"), (F.col("doc_id") % 3 == 0).alias("image"))
    place = F.row_number().over(Window.partitionBy("source", "image").orderBy("doc_id"))
    k = d.withColumn("n", place).filter(F.col("n") <= F.when(F.col("image"), SAMPLE_IMAGES).otherwise(SAMPLE_TEXTS))
    held = F.sort_array(F.collect_list(F.when(~F.col("image") & (F.col("n") <= TOPIC_TEXTS) & (F.col("s") != ""), F.struct("doc_id", "s"))))
    words = lambda x: F.array_join(F.slice(F.filter(F.split(x["s"], r"[ \n\t]+"), lambda w: w != ""), 1, TOPIC_WORDS), " ")
    topics = F.array_join(F.array_distinct(F.transform(F.slice(held, 1, TOPICS), words)), " | ")
    formats = F.array_join(F.sort_array(F.collect_set(F.when(F.col("image"), "png").otherwise(F.col("lang")))), ",")
    kinds = F.concat_ws(",", F.when(F.bool_or(~F.col("image")), "document"), F.when(F.bool_or("image"), "image"))
    out = k.groupBy(F.col("source").alias("kb_id")).agg(formats.alias("formats"), kinds.alias("kinds"), n("sample_count"), topics.alias("t"))
    named = F.coalesce(F.nullif("t", F.lit("")), F.lit("未分类内容"))
    return out.select("kb_id", "formats", "kinds", "sample_count", F.md5(named.cast("binary")).alias("topics"))


_ITEMS = f"i AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS kb_id, {_MODALITY.format('l_linenumber')} AS modality FROM lineitem)"
_PLAN = f"""WITH {_ITEMS}, c AS (SELECT kb_id, modality, count(*) AS n FROM i GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY kb_id) AS total
FROM c),
z AS (SELECT *, least(1000, greatest(50, floor(0.2 * total))) AS size FROM t), o AS (SELECT *, floor(size * n / total) AS own FROM z),
q AS (SELECT kb_id, modality, n, CASE WHEN total < 5000 THEN n WHEN modality = 'video' THEN size - sum(CASE WHEN modality <> 'video' THEN own ELSE 0
END) OVER (PARTITION BY kb_id) ELSE own END::BIGINT AS quota FROM o)"""


def items(spark, sf_dir: str):
    i = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("kb_id"), "l_linenumber")
    return i.select("id", "kb_id", modality("l_linenumber").alias("modality"))


@query(_PLAN + " SELECT * FROM q")
def sample_plan(spark, sf_dir):
    return P.quotas(items(spark, sf_dir))


@query(_PLAN + ", r AS (SELECT *, row_number() OVER (PARTITION BY kb_id, modality ORDER BY md5('42:' || id), id) AS place FROM i) SELECT id, kb_id, modality, place FROM r JOIN q USING (kb_id, modality) WHERE place <= quota")
def stratified_sample(spark, sf_dir):
    return P.sample(items(spark, sf_dir)).select("id", "kb_id", "modality", "place")


_KNOWN = """k AS (SELECT source AS kb_id, count(*) AS n, min(doc_id) AS m FROM documents GROUP BY source), p AS (SELECT kb_id, n, CASE WHEN m % 4 <> 0
THEN n + (m % 9 - 4) * 6 END AS last,
CASE WHEN m % 4 <> 0 THEN DATE '2024-01-10' - (m % 10)::INT END AS created FROM k)"""


@query(
    f"""WITH {_KNOWN} SELECT kb_id, n, created IS NULL OR coalesce(last > 0 AND abs(n - last) / greatest(last, 1)::DOUBLE >= 0.2, false) OR
coalesce(DATE '2024-01-10' - created >= 7, false) OR coalesce(n >= 50 AND last < 50, false) AS refresh FROM p"""
)
def portrait_refresh(spark, sf_dir):
    """Which portraits are due on a day: none yet, changed by a fifth, a week old, or across the threshold."""
    k = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("kb_id")).agg(n("n"), F.min("doc_id").alias("m"))
    has, today = F.col("m") % 4 != 0, F.to_date(F.lit("2024-01-10"))
    last, created = F.when(has, F.col("n") + (F.col("m") % 9 - 4) * 6), F.when(has, F.date_sub(today, (F.col("m") % 10).cast("int")))
    return k.select("kb_id", "n", P.needs_refresh(F.col("n"), last, created, today).alias("refresh"))


@query("""WITH e AS (SELECT CASE WHEN vec_id % 101 = 7 THEN 100 + vec_id ELSE label END AS kb_id, count(*) AS n FROM embeddings GROUP BY kb_id)
SELECT kb_id, greatest(2, least(20, floor(sqrt(n / 2.0))))::BIGINT AS clusters, n::BIGINT AS points, true AS sound FROM e WHERE n >= 10""")
def portrait_pipeline(spark, sf_dir):
    """Portraits of all knowledge bases in one job: each has its number of clusters, which share all its points, and central members.
    Some points are a knowledge base of their own, too small for a portrait."""
    small = F.when(F.col("id") % 101 == 7, 100 + F.col("id")).otherwise(F.col("kb_id"))
    p = R.points(spark, sf_dir).withColumn("kb_id", small).withColumn("modality", modality("id"))
    built = saved(P.portraits(p), "portraits")
    sound = F.bool_and((F.col("silhouette").between(-1, 1)) & (F.col("inertia") >= 0) & (F.size("nearest") == F.least("cluster_size", F.lit(15))))
    shared = P.members(p, built).groupBy("kb_id").agg(n("points"))
    return built.groupBy("kb_id").agg(n("clusters"), sound.alias("sound")).join(shared, "kb_id").select("kb_id", "clusters", "points", "sound")


@query()
def portrait_routing(spark, sf_dir):
    """Questions routed by portraits that were built from the points by clustering; tests hold it against the rule worked out by hand."""
    p = R.points(spark, sf_dir)
    built = P.portraits(p.withColumn("modality", modality("id"))).select("kb_id", "cluster", "vec")
    scores = S.route_scores(S.nearest_portraits(R.asked(p), saved(built, "portraits")))
    return S.route_decision(scores, p.select("kb_id").distinct()).select("query_id", "kb_id", R.r6("raw"), R.r6("norm"), "method")


@query(f"""WITH c AS (SELECT label AS kb_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings), m AS (SELECT
kb_id, id, {_MODALITY.format('id')} AS modality FROM c WHERE n <= 10)
SELECT m.kb_id, m.id, md5(CASE modality WHEN 'doc' THEN '[文档片段] ' WHEN 'image' THEN '[图片描述] ' WHEN 'audio' THEN '[音频转写/描述] ' ELSE '[视频关键帧] ' END ||
left(trim(text), 300)) AS piece
FROM m JOIN documents d ON d.doc_id = m.id WHERE trim(text) <> ''""")
def member_texts(spark, sf_dir):
    """The texts of a cluster's members, by their modality."""
    m = R.points(spark, sf_dir).select("kb_id", "id").withColumn("n", F.row_number().over(Window.partitionBy("kb_id").orderBy("id"))).filter("n <= 10")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.left(F.trim("text"), F.lit(300)).alias("text")).filter("text <> ''")
    head = F.get(F.array(*[F.lit(x) for x in ("[文档片段] ", "[图片描述] ", "[音频转写/描述] ", "[视频关键帧] ")]), (F.col("id") % 4).cast("int"))
    return m.join(texts, "id").select("kb_id", "id", F.md5(F.concat(head, "text").cast("binary")).alias("piece"))


@query("""WITH c AS (SELECT 'documents' AS name, count(*) AS points, count(DISTINCT source) AS kbs FROM documents UNION ALL SELECT 'embeddings',
count(*), count(DISTINCT label) FROM embeddings
UNION ALL SELECT 'pages', count(*), count(DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) FROM pages) SELECT * FROM c""")
def collection_statistics(spark, sf_dir):
    out = None
    for name, key in (("documents", F.col("source")), ("embeddings", F.col("label")), ("pages", T.host(F.col("url")))):
        one = table(spark, sf_dir, name).agg(n("points"), F.countDistinct(key).alias("kbs")).select(F.lit(name).alias("name"), "points", "kbs")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH c AS (SELECT source AS kb_id, {_MODALITY.format('doc_id')} AS m, count(*) AS n FROM documents GROUP BY ALL) SELECT kb_id, sum(n) FILTER
(m = 'doc')::BIGINT AS doc, sum(n) FILTER (m = 'image')::BIGINT AS image, sum(n) FILTER (m = 'audio')::BIGINT AS audio, sum(n) FILTER (m =
'video')::BIGINT AS video FROM c GROUP BY kb_id"""
)
def points_by_collection(spark, sf_dir):
    """A knowledge base's points in each of the four collections."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("kb_id"), modality("doc_id").alias("m"))
    return d.groupBy("kb_id").pivot("m", P.MODALITIES).agg(F.count(F.lit(1)))


@query(f"""WITH f AS (SELECT n_nationkey AS path, 's' || n_regionkey AS file FROM nation), d AS (SELECT 's' || (doc_id % 5) AS file, source AS kb_id,
{_MODALITY.format('doc_id // 5')} AS m FROM documents),
g AS (SELECT path, kb_id, count(*) FILTER (m = 'doc') AS a, count(*) FILTER (m = 'image') AS b, count(*) FILTER (m = 'audio') AS c, count(*) FILTER (m
= 'video') AS v FROM f JOIN d USING (file) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY a DESC, b DESC, c DESC, v DESC, kb_id) AS n FROM g) SELECT path, kb_id FROM r WHERE n =
1""")
def kb_of_path(spark, sf_dir):
    """The knowledge base under which an object's file has most points: by texts, then images, sounds and videos."""
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("path"), F.concat(F.lit("s"), "n_regionkey").alias("file"))
    d = table(spark, sf_dir, "documents").withColumn("fifth", F.expr("doc_id div 5"))
    d = d.select(F.concat(F.lit("s"), F.col("doc_id") % 5).alias("file"), F.col("source").alias("kb_id"), modality("fifth").alias("m"))
    counts = d.groupBy("file", "kb_id").agg(*[F.count_if(F.col("m") == m).alias(m) for m in P.MODALITIES])
    best = S.first_per(counts, ("file",), *[F.desc(m) for m in P.MODALITIES], F.col("kb_id"))
    return files.join(best, "file").select("path", "kb_id")


@query("""WITH v AS (SELECT doc_id AS video, 'v' || doc_id AS uuid, source || '.mp4' AS name FROM documents WHERE doc_id % 4 = 3), k AS (SELECT doc_id
AS frame, 'frames/v' || (doc_id - doc_id % 4 + 3 + 8 * (doc_id % 2)) || '/1.jpg' AS path FROM documents WHERE doc_id % 4 < 2)
SELECT frame, coalesce(name, path) AS video FROM k LEFT JOIN v ON uuid = regexp_extract(path, 'frames/([^/]+)/', 1)""")
def keyframe_videos(spark, sf_dir):
    """The name of the video that a key frame is from, by the identifier in its path; the path itself where there is none."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    videos = d.filter("doc_id % 4 = 3").select(F.concat(F.lit("v"), "doc_id").alias("uuid"), F.concat("source", F.lit(".mp4")).alias("name"))
    owner = F.col("doc_id") - F.col("doc_id") % 4 + 3 + 8 * (F.col("doc_id") % 2)
    frames = d.filter("doc_id % 4 < 2").select(F.col("doc_id").alias("frame"), F.format_string("frames/v%d/1.jpg", owner).alias("path"))
    return N.with_video(frames, videos).select("frame", F.coalesce("name", "path").alias("video"))


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' AFRICA ' WHEN 1 THEN 'am' WHEN 2 THEN 'a' WHEN 3 THEN 'xyz' WHEN 4 THEN ''
ELSE '2' END AS token FROM customer),
r AS (SELECT r_regionkey::VARCHAR AS id, lower(r_name) AS name FROM region UNION ALL SELECT '9', 'europe'),
c AS (SELECT c_custkey, count(*) FILTER (id = trim(token)) AS ids, count(*) FILTER (name = lower(trim(token))) AS exact, count(*) FILTER
(starts_with(name, lower(trim(token))) AND trim(token) <> '') AS begun,
min(id) FILTER (name = lower(trim(token))) AS e, min(id) FILTER (starts_with(name, lower(trim(token)))) AS b FROM t, r GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN ids = 1 THEN trim(token) WHEN exact = 1 THEN e WHEN exact = 0 AND begun = 1 THEN b END AS kb_id, CASE WHEN trim(token) =
'' THEN 'empty' WHEN ids = 1 OR exact = 1 OR exact = 0 AND begun = 1 THEN 'found' WHEN exact > 1 OR begun > 1 THEN 'ambiguous' ELSE 'unknown' END AS
outcome FROM c JOIN t USING (c_custkey)""")
def kb_names_resolved(spark, sf_dir):
    """What a user typed as a knowledge base: its id, its name, or the beginning of one name only."""
    tokens = F.array(*[F.lit(x) for x in (" AFRICA ", "am", "a", "xyz", "", "2")])
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.get(tokens, (F.col("c_custkey") % 6).cast("int")).alias("token"))
    kbs = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.lower("r_name").alias("name"))
    kbs = kbs.unionByName(spark.createDataFrame([("9", "europe")], "id string, name string"))
    return N.resolved(asked, kbs).select("c_custkey", "kb_id", "outcome")


@query("""WITH a AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}|[一-龥]')) AS w, string_split(lower(coalesce(lang,
'')) || ',zz,' || lower(source), ',') AS m FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(w, []), list_filter(m, lambda x: x <> ''))))[1:10], ',') AS keywords FROM
a""")
def keyword_union(spark, sf_dir):
    """Keywords of a text and of a model's answer as one set, ten of them."""
    given = F.filter(F.split(F.concat(F.lower(F.coalesce("lang", F.lit(""))), F.lit(",zz,"), F.lower("source")), ","), lambda x: x != "")
    words = F.coalesce(T.words(F.col("text")), F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.array_sort(F.array_union(words, given)), 1, 10), ",").alias("keywords"))


@query("SELECT item_id, row_number() OVER (ORDER BY md5('9:' || item_id), item_id) AS place FROM benchmark QUALIFY place <= 12")
def shuffled_questions(spark, sf_dir):
    """A dozen questions in an order that a seed gives."""
    draw = F.md5(F.concat(F.lit("9:"), F.col("item_id").cast("string")).cast("binary"))
    first = table(spark, sf_dir, "benchmark").select("item_id", draw.alias("draw")).orderBy("draw", "item_id").limit(12)
    return first.select("item_id", F.row_number().over(Window.orderBy("draw", "item_id")).alias("place"))


@query(f"""WITH d AS (SELECT source AS kb_id, doc_id, {_MODALITY.format('doc_id')} AS kind, left(text, 120) AS head FROM documents WHERE trim(text) <>
''), u AS (SELECT kb_id, kind, head, min(doc_id) AS doc_id FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY kb_id, kind ORDER BY md5('5:' || doc_id), doc_id) AS n FROM u), k AS (SELECT * FROM r WHERE n <= CASE
WHEN kind = 'doc' THEN 15 ELSE 6 END),
o AS (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY md5('6:' || doc_id), doc_id) AS place FROM k) SELECT kb_id, kind, doc_id, place, (place
- 1) // 8 AS batch FROM o WHERE place <= 30""")
def question_backfill(spark, sf_dir):
    """Material for a knowledge base's questions: half texts, a fifth of each other kind, distinct by their beginnings, shuffled, in batches."""
    d = table(spark, sf_dir, "documents").filter("trim(text) <> ''").select(F.col("source").alias("kb_id"), "doc_id", modality("doc_id").alias("kind"), F.left("text", F.lit(120)).alias("head"))
    drawn = lambda seed: F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"))
    u = d.groupBy("kb_id", "kind", "head").agg(F.min("doc_id").alias("doc_id"))
    k = u.withColumn("n", F.row_number().over(Window.partitionBy("kb_id", "kind").orderBy(drawn(5), "doc_id"))).filter(F.col("n") <= F.when(F.col("kind") == "doc", 15).otherwise(6))
    o = k.withColumn("place", F.row_number().over(Window.partitionBy("kb_id").orderBy(drawn(6), "doc_id"))).filter("place <= 30")
    return o.select("kb_id", "kind", "doc_id", "place", F.expr("(place - 1) div 8").alias("batch"))


@query("""WITH k AS (SELECT r_regionkey AS id, r_name AS name, 'old' AS note FROM region), c AS (SELECT 1 AS id, 'renamed' AS name, NULL AS note UNION
ALL SELECT 7, 'new', 'fresh'), g AS (SELECT 3 AS id),
u AS (SELECT coalesce(k.id, c.id) AS id, coalesce(c.name, k.name) AS name, coalesce(c.note, k.note) AS note FROM k FULL JOIN c ON k.id = c.id) SELECT
* FROM u WHERE id NOT IN (SELECT id FROM g)""")
def kb_changes(spark, sf_dir):
    """Knowledge bases after creations, updates of the fields that are given, and deletions."""
    kbs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("old").alias("note"))
    given = spark.createDataFrame([(1, "renamed", None), (7, "new", "fresh")], "id int, name string, note string")
    return N.changed(kbs, given, spark.createDataFrame([(3,)], "id int"), "id")


@query("""WITH c AS (SELECT n_nationkey AS asked, unnest(['x' || n_nationkey, 'src' || n_nationkey, 'src1']) AS kb, unnest([1, 2, 3]) AS place FROM
nation), d AS (SELECT 'src' || (doc_id % 11) AS kb, count(*) AS n FROM documents GROUP BY ALL),
r AS (SELECT asked, kb, n, row_number() OVER (PARTITION BY asked ORDER BY place) AS k FROM c JOIN d USING (kb)) SELECT asked, kb, n FROM r WHERE k = 1""")
def first_kb_with_points(spark, sf_dir):
    """Of the ids that a knowledge base may be stored under, the first that has points."""
    k = F.col("n_nationkey").cast("string")
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("asked"), F.posexplode(F.array(F.concat(F.lit("x"), k), F.concat(F.lit("src"), k), F.lit("src1"))).alias("place", "kb"))
    d = table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("src"), F.col("doc_id") % 11).alias("kb")).agg(n("n"))
    return S.first_per(c.join(d, "kb"), ("asked",), F.col("place")).select("asked", "kb", "n")


@query("""WITH p AS (SELECT doc_id // 4 AS file, source AS kb_id, doc_id, text FROM documents WHERE trim(text) <> ''), g AS (SELECT file, count(*) AS
chunks, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS joined FROM p GROUP BY file) SELECT * FROM g""")
def file_previews(spark, sf_dir):
    """A file's chunks in their order as one text."""
    p = table(spark, sf_dir, "documents").filter("trim(text) <> ''").select(F.expr("doc_id div 4").alias("file"), "doc_id", F.col("text").alias("t"))
    held = F.sort_array(F.collect_list(F.struct("doc_id", "t")))
    joined = F.array_join(F.transform(held, lambda x: x["t"]), "\n\n")
    return p.groupBy("file").agg(n("chunks"), F.md5(joined.cast("binary")).alias("joined"))


@query(f"""WITH m AS (SELECT source AS kb_id, doc_id, CASE WHEN doc_id % 4 = 1 THEN 0 ELSE 1 END AS k FROM documents WHERE doc_id % 4 IN (1, 3) AND
source <> (SELECT min(source) FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY k, md5('3:' || doc_id), doc_id) AS n FROM m) SELECT kb_id, doc_id AS cover FROM r WHERE
n = 1""")
def kb_covers(spark, sf_dir):
    """A picture for each knowledge base, drawn by a seed: one of its images, else a key frame."""
    d = table(spark, sf_dir, "documents")
    m = d.filter("doc_id % 4 IN (1, 3)").join(d.agg(F.min("source").alias("source")), "source", "left_anti")
    draw = F.md5(F.concat(F.lit("3:"), F.col("doc_id").cast("string")).cast("binary"))
    return S.first_per(m, ("source",), F.col("doc_id") % 4 == 3, draw, F.col("doc_id")).select(F.col("source").alias("kb_id"), F.col("doc_id").alias("cover"))


@query(
    """SELECT doc_id, source || '/new' AS kb_id FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 10
<> 0"""
)
def replaced_documents(spark, sf_dir):
    """Points after documents were written anew: theirs replace the old ones, others stay."""
    old = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kb_id"))
    new = old.filter("doc_id % 10 = 0").withColumn("kb_id", F.concat("kb_id", F.lit("/new")))
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


@query(
    """SELECT page_id, array_to_string(list_filter([CASE WHEN t <> '' THEN 'title' END, CASE WHEN page_id % 3 = 0 THEN 'author' END, 'url'], lambda
x: x IS NOT NULL), ',') AS fields FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)"""
)
def page_fields(spark, sf_dir):
    """The fields of a fetched page that aren't empty."""
    author = F.when(F.col("page_id") % 3 == 0, "someone").otherwise("  ")
    fields = F.create_map(F.lit("title"), T.page_title(F.col("html")), F.lit("author"), author, F.lit("site"), F.lit(None).cast("string"), F.lit("url"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.map_keys(N.without_empty(fields)), ",").alias("fields"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'html' ELSE '' END AS ext, page_id % 3 = 0 AS is_binary,
least(length(html), 2000000)::INT AS kept FROM pages""")
def fetched_contents(spark, sf_dir):
    """What a fetched address is by its path, whether it is binary, and how much of a text is kept."""
    k = F.col("page_id") % 3
    url = F.when(k == 0, "http://h.x/a/b.PDF?q=1.txt").when(k == 1, "http://h.x/a.b/c.html#x.png").otherwise("http://h.x/a.b/c")
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", N.url_extension(url).alias("ext"), N.is_binary(url).alias("is_binary"), F.length(F.left("html", F.lit(2_000_000))).alias("kept"))


@query("SELECT page_id, page_id % 2 = 0 AS article FROM pages WHERE page_id % 5 <> 4")
def article_types(spark, sf_dir):
    """Whether a page's declared types, one or many, hold one of an article."""
    types = F.when(F.col("page_id") % 2 == 0, '["WebPage", "NewsArticle"]').otherwise('"WebPage"')
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 != 4, types).alias("t")).filter("t IS NOT NULL")
    return p.select("page_id", M.is_article(F.col("t")).alias("article"))


@query("""WITH t AS (SELECT label AS kb_id, vec_id % 3 AS cluster, count(*) AS size FROM embeddings GROUP BY ALL) SELECT kb_id, cluster, size, CASE WHEN
cluster = 0 THEN 'one,,two,three;two' WHEN cluster = 1 THEN '' ELSE 'alpha,beta,x' END AS keywords FROM t""")
def portrait_rows(spark, sf_dir):
    """Portraits as shown to clients, with the words of their topics."""
    t = R.points(spark, sf_dir).groupBy("kb_id", (F.col("id") % 3).alias("cluster")).agg(n("size"))
    topic = F.get(F.array(F.lit("one, two。three;two"), F.lit(" "), F.lit("alpha、beta；x")), F.col("cluster").cast("int"))
    return t.select("kb_id", "cluster", "size", F.array_join(T.phrase_keywords(topic), ",").alias("keywords"))
