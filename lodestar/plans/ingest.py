"""Queries around uploads, links and images, prompts, model answers, messages and question banks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import markup as M
from lodestar.functions import text as T
from lodestar.operators import search as S
from lodestar.plans.content import key_sql, question_sql
from lodestar.plans.registry import query, table
from lodestar.streaming import state

_PARTS = "list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x))"
_WITH_IMAGES = """concat(text, ' ![one](img/', doc_id, '.png) and <img src="pic/', doc_id, '.jpg"> end')"""


def illustrated(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.format_string(' ![one](img/%d.png) and <img src="pic/%d.jpg"> end', "doc_id", "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query("SELECT doc_id, unnest([0, 1])::INT AS place, unnest(['img/' || doc_id || '.png', 'pic/' || doc_id || '.jpg']) AS path FROM documents")
def image_references(spark, sf_dir):
    found = illustrated(spark, sf_dir).select("doc_id", F.posexplode(M.image_refs(F.col("text"))).alias("place", "image"))
    return found.select("doc_id", "place", "image.path")


@query(
    f"""WITH l AS (SELECT DISTINCT doc_id FROM labels), c AS (SELECT doc_id, {_WITH_IMAGES} AS c, doc_id IN (SELECT doc_id FROM l) AS known FROM
documents) SELECT doc_id, md5(CASE WHEN known THEN replace(c, '![one](img/' || doc_id || '.png)', 'caption ' || doc_id) ELSE c END) AS digest FROM c"""
)
def captioned_text(spark, sf_dir):
    """Images with a known caption become that caption."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct()
    known = known.withColumn("captions", F.create_map(F.format_string("img/%d.png", "doc_id"), F.format_string("caption %d", "doc_id")))
    c = illustrated(spark, sf_dir).join(known, "doc_id", "left")
    return c.select("doc_id", F.md5(M.with_captions(F.col("text"), F.col("captions")).cast("binary")).alias("digest"))


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)
SELECT page_id, CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN h LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || h
WHEN h LIKE '#%' THEN regexp_extract(url, '^[^#]*') || h ELSE regexp_extract(url, '^[a-z]+://[^?#]*/') || h END AS link, count(*) AS n FROM l GROUP BY
ALL""")
def absolute_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"))
    return links.groupBy("page_id", M.absolute("url", "h").alias("link")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, md5(concat('Role: ', role, chr(10), 'Question {', turn, '}: ', text)) AS digest FROM conversations")
def filled_prompts(spark, sf_dir):
    prompt = M.filled("Role: {role}\nQuestion {{{turn}}}: {text}", role=F.col("role"), turn=F.col("turn"), text=F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(prompt.cast("binary")).alias("digest"))


QUESTIONS = ("1. What is known about {topic}?", "- {topic} 是如何工作的。", "Which files cover {topic}?")


@query(f"""WITH p AS (SELECT DISTINCT source AS kb_id, lang FROM documents WHERE lang IS NOT NULL), i AS (SELECT *, row_number() OVER (PARTITION BY
kb_id ORDER BY lang) % 3 AS i FROM p),
q AS (SELECT kb_id, lang, CASE i WHEN 0 THEN '1. What is known about ' || lang || '?' WHEN 1 THEN '- ' || lang || ' 是如何工作的。' ELSE 'Which files cover ' || lang ||
'?' END AS asked FROM i), n AS (SELECT kb_id, lang, {question_sql('asked')} AS question, {key_sql('asked')} AS key FROM q)
SELECT kb_id, question, left(sha256(kb_id || '|' || lang || '|' || question), 16) AS id FROM n WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.kb_id = n.kb_id
AND b.key = n.key AND b.lang = 'en')""")
def question_bank(spark, sf_dir):
    """Template questions of each topic that the bank, which holds those on one language, lacks; an id's digest is of bank, file and question."""
    topics = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.col("source").alias("kb_id"), "lang").distinct()
    i = F.row_number().over(Window.partitionBy("kb_id").orderBy("lang")) % 3
    asked = F.element_at(F.array(*[M.filled(q, topic=F.col("lang")) for q in QUESTIONS]), i + 1)
    new = topics.withColumn("question", T.question(asked)).withColumn("key", T.canonical_key(asked)).filter("key <> ''")
    bank = new.filter("lang = 'en'").select("kb_id", "key")
    id_ = F.left(F.sha2(F.concat_ws("|", "kb_id", "lang", "question"), 256), F.lit(16))
    return S.first_per(new.join(bank, ["kb_id", "key"], "left_anti"), ("kb_id", "key"), F.col("question")).select("kb_id", "question", id_.alias("id"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN trim(text) ELSE 'find ' || role || ' ' || turn END AS query, CASE WHEN turn % 5 = 4 THEN ''
ELSE array_to_string(list_sort(['a', 'b', role]), ',') END AS keywords, CASE WHEN turn % 5 = 4 THEN 0 ELSE 2 END AS n_views FROM conversations"""
)
def rewritten_queries(spark, sf_dir):
    """Model answers as JSON, as lines or without any use; then the query itself."""
    c = table(spark, sf_dir, "conversations")
    q, k, v = F.format_string("find %s %d", "role", "turn"), F.concat(F.lit("b, a, "), "role", F.lit(", a")), F.lit("one view； another；")
    as_json = F.concat(F.lit("Sure: "), F.to_json(F.struct(q.alias("query"), k.alias("keywords"), v.alias("views"))), F.lit(" done"))
    as_lines = F.concat(F.lit("query: "), q, F.lit("\nkeywords: "), k, F.lit("\nviews: "), v)
    answer = F.when(F.col("turn") % 5 == 4, "nothing to say").when(F.col("turn") % 2 == 0, as_json).otherwise(as_lines)
    a = c.select("conv_id", "turn", "text", answer.alias("a"))
    keywords = F.array_join(F.array_sort(M.listed(M.answer_field(F.col("a"), "keywords"), "[,，、]", 10)), ",")
    views = F.size(F.coalesce(M.listed(M.answer_field(F.col("a"), "views"), "；", 3), F.array()))
    return a.select("conv_id", "turn", F.coalesce(M.answer_field(F.col("a"), "query"), F.trim("text")).alias("query"), F.coalesce(keywords, F.lit("")).alias("keywords"), views.alias("n_views"))


@query("""WITH l AS (SELECT user_id, event_type, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value, row_number() OVER (PARTITION BY user_id,
event_type ORDER BY ts DESC, event_id DESC) AS n, max(ts) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, event_type, value FROM l WHERE n = 1 AND value IS NOT NULL AND last - ts <= INTERVAL 86400 second""")
def session_preferences(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return state.preferences(e, "user_id", "event_type", "value", "ts", "event_id", 86400)


@query("SELECT item_id, md5(concat('## Item ', item_id, chr(10), chr(10), '**', text, '**, end')) AS digest FROM benchmark")
def rich_text_markdown(spark, sf_dir):
    span = lambda text, *marks: F.struct(F.lit("text").alias("type"), text.alias("text"), F.array(*[F.struct(F.lit(m).alias("type")) for m in marks]).cast("array<struct<type string>>").alias("marks"))
    block = lambda kind, level, *spans: F.struct(F.lit(kind).alias("type"), F.struct(F.lit(level).cast("int").alias("level")).alias("attrs"), F.array(*spans).alias("content"))
    head = block("heading", 2, span(F.format_string("Item %d", "item_id")))
    body = block("paragraph", None, span(F.coalesce("text", F.lit("")), "bold"), span(F.lit(", end")))
    doc = F.to_json(F.struct(F.lit("doc").alias("type"), F.array(head, body).alias("content")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(M.rich_text(doc).cast("binary")).alias("digest"))


@query(
    """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[ ' || chr(9) || chr(10) || chr(13) || ']+', ' ', 'g')) AS c,
trim(coalesce(text, '')) AS raw FROM conversations) SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN md5(c) WHEN 1 THEN md5(trim(c || ' @_all_2 end')) WHEN 2
THEN md5(left('plain ' || raw, 20000)) END AS digest FROM c"""
)
def message_texts(spark, sf_dir):
    """Texts and nested posts without mentions of users, messages that aren't JSON, and kinds that have no text."""
    text = F.concat(F.lit("@_user_1 "), F.coalesce("text", F.lit("")))
    plain = F.to_json(F.struct(text.alias("text")))
    node = lambda x, tag="text": F.struct(F.lit(tag).alias("tag"), x.alias("text"))
    post = F.to_json(F.struct(F.lit("title").alias("title"), F.array(F.array(node(text), node(F.lit("not this"), "a")), F.array(node(F.lit("@_all_2")), node(F.lit("end")))).alias("content")))
    k = F.col("turn") % 4
    kind = F.when(k == 1, "Post").when(k == 3, "image").otherwise("text")
    said = F.when(k == 0, plain).when(k == 2, F.concat(F.lit("plain "), F.trim(F.coalesce("text", F.lit(""))))).otherwise(post)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), said.alias("c"))
    return c.select("conv_id", "turn", F.md5(M.message_text(F.col("kind"), F.col("c")).cast("binary")).alias("digest"))


@query(f"""WITH f AS (SELECT doc_id, source, {_PARTS} AS p, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS file FROM documents), x AS
(SELECT source, doc_id, file, unnest(generate_series(0, least(2, len(p)) - 1)) AS item FROM f WHERE file < 8)
SELECT source AS kb_id, doc_id, item::INT AS item, greatest(0.82, round(1 - 0.03 * file - 0.01 * item, 4))::DOUBLE AS score FROM x""")
def selected_files(spark, sf_dir):
    """First chunks of the first files that a user selected, with scores by place. Files are ranked before their texts are cut."""
    d = table(spark, sf_dir, "documents")
    first = d.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("file")).filter("file <= 8")
    parts = first.join(d.select("doc_id", "text"), "doc_id").select("source", "doc_id", "file", F.posexplode(F.slice(T.paragraphs(F.col("text"), "\n"), 1, 2)).alias("item", "chunk"))
    score = F.greatest(F.lit(0.82), F.round(1 - 0.03 * (F.col("file") - 1) - 0.01 * F.col("item"), 4))
    return parts.select(F.col("source").alias("kb_id"), "doc_id", "item", score.alias("score"))


@query(
    f"""WITH p AS (SELECT doc_id, {_PARTS} AS p FROM documents WHERE text IS NOT NULL), a AS (SELECT doc_id, p, (doc_id % greatest(1, len(p)))::INT AS i FROM p WHERE len(p) > 0),
b AS (SELECT doc_id, i, list_transform(p, lambda x, k: CASE WHEN k = i + 1 AND doc_id % 4 > 0 THEN x || ' ![one](img/' || doc_id || '.png)' ELSE x END) AS p FROM a),
c AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN '无' WHEN doc_id % 4 = 0 THEN 'page ' || array_to_string(p, chr(10)) ELSE array_to_string(p[greatest(1, i):i + 2],
chr(10) || chr(10)) END AS c FROM b) SELECT doc_id, md5(CASE WHEN length(c) > 1200 THEN left(c, 1197) || '...' ELSE c END) AS digest FROM c"""
)
def image_context(spark, sf_dir):
    """The paragraph that holds an image between its neighbours; the page's text where none does, and a word where there is no page."""
    p = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", T.paragraphs(F.col("text"), "\n").alias("p")).filter("size(p) > 0")
    own, ref = (F.col("doc_id") % F.size("p")).cast("int"), F.concat(F.lit("img/"), "doc_id", F.lit(".png"))
    held = F.transform("p", lambda x, k: F.when((k == own) & (F.col("doc_id") % 4 > 0), F.concat(x, F.lit(" ![one]("), ref, F.lit(")"))).otherwise(x))
    page = F.when(F.col("doc_id") % 8 != 0, F.concat(F.lit(" page "), F.array_join("p", "\n")))
    return p.withColumn("p", held).select("doc_id", F.md5(M.around_image(F.array_join("p", "\n\n"), ref, page).cast("binary")).alias("digest"))


@query(
    """SELECT p_partkey, unnest(CASE WHEN p_size % 3 = 0 THEN [p_size / 2.0] ELSE list_transform(generate_series(0, p_size, 10), lambda x: x::DOUBLE)
END)::DOUBLE AS at FROM part"""
)
def scene_keyframes(spark, sf_dir):
    """A row per keyframe; a scene without any has its middle."""
    frames = F.when(F.col("p_size") % 3 != 0, F.sequence(F.lit(0), F.col("p_size"), F.lit(10)))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode_outer(frames).alias("frame"))
    return p.select("p_partkey", F.coalesce(F.col("frame").cast("double"), F.col("p_size") / 2.0).alias("at"))


@query(
    """SELECT c_nationkey::VARCHAR AS kb_id, (c_custkey % 50)::VARCHAR AS file_id, min(c_custkey) AS first FROM customer WHERE c_custkey % 11 <> 0
GROUP BY ALL"""
)
def scope_normalised(spark, sf_dir):
    """Scopes in either spelling, trimmed, without invalid ones, each once and in order."""
    kb, file = F.format_string(" %d ", "c_nationkey"), (F.col("c_custkey") % 50).cast("string")
    snake, camel = F.to_json(F.struct(kb.alias("kb_id"), file.alias("file_id"))), F.to_json(F.struct(kb.alias("kbId"), file.alias("fileId")))
    raw = F.when(F.col("c_custkey") % 11 == 0, '{"kb_id": " "}').when(F.col("c_custkey") % 2 == 0, snake).otherwise(camel)
    s = table(spark, sf_dir, "customer").select("c_custkey", F.from_json(raw, "kb_id string, kbId string, file_id string, fileId string").alias("s"))
    either = lambda a, b: F.nullif(F.trim(F.coalesce(f"s.{a}", f"s.{b}")), F.lit(""))
    s = s.select(either("kb_id", "kbId").alias("kb_id"), either("file_id", "fileId").alias("file_id"), "c_custkey").filter("kb_id IS NOT NULL AND file_id IS NOT NULL")
    return s.groupBy("kb_id", "file_id").agg(F.min("c_custkey").alias("first"))


@query("""WITH n AS (SELECT n_nationkey, n_name, [n_name, '_' || n_name || '_Bank!', repeat(n_name || '-', 20), '知识库', '__'][n_nationkey % 5 + 1] AS name FROM nation)
SELECT n_nationkey, coalesce(nullif(trim(left(regexp_replace(replace(lower(name), '_', '-'), '[^a-z0-9-]', '', 'g'), 63), '-'), ''), 'kb-default') AS bucket,
CASE WHEN n_nationkey % 5 = 3 THEN '-' ELSE trim(regexp_replace(replace(name, '!', ' '), ' +', ' ', 'g')) END AS tag,
sha256('{"kb":"' || n_name || '","n":' || n_nationkey || '}') AS key FROM n""")
def bucket_names(spark, sf_dir):
    key = F.sha2(F.to_json(F.struct(F.col("n_name").alias("kb"), F.col("n_nationkey").alias("n"))), 256)
    n, name = F.col("n_nationkey"), F.col("n_name")
    names = [name, F.concat(F.lit("_"), name, F.lit("_Bank!")), F.repeat(F.concat(name, F.lit("-")), 20), F.lit("知识库"), F.lit("__")]
    own = F.get(F.array(*names), (n % 5).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", M.bucket(own).alias("bucket"), M.tag_value(own).alias("tag"), key.alias("key"))


@query(
    f"""SELECT doc_id, md5(left(array_to_string(list_transform({_PARTS}[1:3], lambda x: left(x, 450)), chr(10)), 14000)) AS digest FROM documents
WHERE text IS NOT NULL"""
)
def question_material(spark, sf_dir):
    parts = F.transform(F.slice(T.paragraphs(F.col("text"), "\n"), 1, 3), lambda x: F.left(x, F.lit(450)))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(F.left(F.array_join(parts, "\n"), F.lit(14000)).cast("binary")).alias("digest"))


@query(
    """SELECT vec_id, label FROM embeddings WHERE label IN (1, 2) AND CASE WHEN vec_id % 2 = 0 THEN vec_id % 9 IN (3, 4) OR vec_id % 11 IN (3, 4) ELSE vec_id % 9 IN (3, 4) END AND vec_id % 5 <> 0 AND vec_id % 7 <> 0"""
)
def file_scopes(spark, sf_dir):
    """Points of selected files: images and sounds by either file field, videos by their own; without key frames and ignored folders."""
    n = F.col("vec_id")
    folder = F.when(n % 5 == 0, "frames/keyframes/").when(n % 7 == 0, ".tmp/").otherwise("docs/")
    p = table(spark, sf_dir, "embeddings").select("vec_id", "label", (n % 9).alias("file_id"), (n % 11).alias("source_file_id"), F.concat(folder, n.cast("string")).alias("path"))
    p = p.withColumn("kb_id", F.col("label"))
    images = S.scope_filter(p.filter("vec_id % 2 = 0"), [1, 2], [3, 4], ("file_id", "source_file_id"))
    videos = S.scope_filter(p.filter("vec_id % 2 = 1"), [1, 2], [3, 4], ("file_id",))
    return S.listed_files(images.unionByName(videos), "path").select("vec_id", "label")


@query(
    """SELECT c_custkey, sha256(concat('{"files":', CASE WHEN c_custkey % 2 = 0 THEN '["a/1","b/2"]' ELSE '[]' END, ',"kb_ids":["', c_nationkey % 5, '","z"],"kb_mode":"', CASE WHEN c_custkey % 3 = 0 THEN 'auto' ELSE 'manual' END, '","max_q":6}')) AS key FROM customer"""
)
def scope_keys(spark, sf_dir):
    """A cache key of a scope: the digest of its JSON with sorted keys and lists."""
    files = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("b/2"), F.lit("a/1"))).otherwise(F.array().cast("array<string>"))
    kbs = F.array(F.lit("z"), (F.col("c_nationkey") % 5).cast("string"))
    mode = F.when(F.col("c_custkey") % 3 == 0, "auto").otherwise("manual")
    return table(spark, sf_dir, "customer").select("c_custkey", M.scope_key(mode, kbs, files, F.lit(6)).alias("key"))


@query(
    f"""WITH d AS (SELECT source AS kb_id, {key_sql("text")} AS key, doc_id FROM documents), k AS (SELECT kb_id, key, min(doc_id) AS doc_id FROM d WHERE key <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY doc_id) AS n FROM k) SELECT kb_id, doc_id, n FROM r WHERE n <= 6"""
)
def distinct_questions(spark, sf_dir):
    """A knowledge base's questions, each once by what is asked, up to a cap."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("kb_id"), T.canonical_key(F.col("text")).alias("key"), "doc_id").filter("key <> ''")
    first = d.groupBy("kb_id", "key").agg(F.min("doc_id").alias("doc_id"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("kb_id").orderBy("doc_id"))).filter("n <= 6").select("kb_id", "doc_id", "n")
