"""Queries that parse, chunk, normalise and describe texts and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import folds
from lodestar.functions import text as T
from lodestar.operators import chunks as C
from lodestar.plans.registry import query, table


@query(
    """SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_parts, list_filter(string_split(text, chr(10)),
lambda x: trim(x) <> '')[1] AS first FROM documents WHERE text IS NOT NULL"""
)
def text_parser(spark, sf_dir):
    parts = T.paragraphs(F.col("text"), "\n")
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.size(parts).cast("long").alias("n_parts"), F.get(parts, F.lit(0)).alias("first"))


_LINES = """l0 AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS text,
generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 AS i FROM documents), l AS (SELECT doc_id, i, trim(text)
AS text FROM l0)"""


def lines(spark, sf_dir):
    return C.parts(table(spark, sf_dir, "documents"), mark="\n")


@query(
    f"""WITH {_LINES} SELECT doc_id, i::INT AS chunk_index, length(text)::INT AS n, CASE WHEN i > 0 THEN sha256(doc_id || ':' || (i - 1)) END AS
prev_id, CASE WHEN i < max(i) OVER (PARTITION BY doc_id) THEN sha256(doc_id || ':' || (i + 1)) END AS next_id FROM l"""
)
def chunk_records(spark, sf_dir):
    return C.records(lines(spark, sf_dir)).select("doc_id", "chunk_index", F.length("text").alias("n"), "prev_id", "next_id")


@query(f"""WITH {_LINES}, w AS (SELECT doc_id, i, text, lag(text) OVER k AS a, lead(text) OVER k AS b FROM l WINDOW k AS (PARTITION BY doc_id ORDER BY
i))
SELECT doc_id, i::INT AS chunk_index, md5(concat(CASE WHEN length(a) > 150 THEN right(a, 150) || chr(10) || chr(10) ELSE '' END, text, CASE WHEN length(b) > 150
THEN chr(10) || chr(10) || left(b, 150) ELSE '' END)) AS digest FROM w""")
def chunk_overlap(spark, sf_dir):
    return C.overlapped(lines(spark, sf_dir)).select("doc_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def recursive_chunks(spark, sf_dir):
    """Chunks of at most 900 characters with their neighbours' ids; tests hold that no text is lost."""
    return C.records(C.split(table(spark, sf_dir, "documents"))).select("doc_id", "chunk_index", F.length("text").alias("n"), "prev_id", "next_id")


_META = """m AS (SELECT page_id, url, page_id % 4 AS k, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages)"""


@query(
    f"""WITH {_META} SELECT page_id, CASE k WHEN 0 THEN 'OG ' || page_id WHEN 1 THEN 'Tw' ELSE left(trim(t), 300) END AS title,
CASE WHEN k IN (0, 2) THEN 'The Site' ELSE h END AS site, CASE WHEN k = 0 THEN 'Ann' END AS author, CASE WHEN k = 2 THEN '2024-01-10' END AS published FROM m"""
)
def page_metadata(spark, sf_dir):
    """Title, site, author and date of a page: from its meta elements, else its title and host."""
    k = F.col("page_id") % 4
    og = F.concat(F.lit('<meta property="og:title" content="OG '), "page_id", F.lit('"><meta content="The Site" property="og:site_name"><meta name="author" content=" Ann ">'))
    tags = F.when(k == 0, og).when(k == 1, "<meta name='twitter:title' content='Tw'><meta property=\"og:title\" content=\" \">")
    tags = tags.when(k == 2, '<meta property="og:site_name" content="The Site"><meta property="article:published_time" content="2024-01-10">').otherwise("")
    html, url = F.concat(tags, F.coalesce("html", F.lit(""))), F.col("url")
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.page_title(html).alias("title"), T.page_site(html, url).alias("site"), T.meta(html, "author").alias("author"), T.meta(html, "article:published_time").alias("published"))


_PART = """left(regexp_replace(regexp_replace(regexp_replace(trim({}), '[\\\\/:*?"<>|' || chr(10) || chr(13) || chr(9) || ']+', '_', 'g'), '_+', '_', 'g'), '^[_. ]+|[_. ]+$', '', 'g'), 60)"""


@query(f"""WITH t AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '.. ' WHEN page_id % 3 = 1 THEN ' A/B: 50% & more? ' || page_id || '.' ELSE
regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.', '_') AS host,
replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#;]*)', 1), '/', '_') AS path FROM pages), n AS (SELECT page_id, {_PART.format('title')} AS name, host,
{_PART.format('path')} AS path FROM t)
SELECT page_id, CASE WHEN name <> '' THEN name ELSE host || CASE WHEN path <> '' THEN '_' || path ELSE '' END || '-20240110' END || '.md' AS name FROM n""")
def page_file_name(spark, sf_dir):
    """A page's title as a file's name; where nothing of it is left, host, path and day."""
    n = F.col("page_id")
    title = F.when(n % 3 == 0, ".. ").when(n % 3 == 1, F.concat(F.lit(" A/B: 50% & more? "), n, F.lit("."))).otherwise(T.page_title(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", T.file_name(title, F.col("url"), F.lit("20240110")).alias("name"))


_TEXT = r"regexp_replace(html || '<p>a&eacute;&#x42;&amp;lt;</p>', '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
_TEXT = rf"regexp_replace(regexp_replace({_TEXT}, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|section|article|li|tr|table|h[1-6]|blockquote)>', chr(10) || chr(10), 'g')"
_TEXT = f"regexp_replace({_TEXT}, '<[^>]+>', '', 'g')"
for _a, _b in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&eacute;", "'é'"), ("&#x42;", "'B'"), ("&copy;", "'©'"), ("&middot;", "'·'")):
    _TEXT = f"replace({_TEXT}, '{_a}', {_b})"
_TEXT = f"regexp_replace({_TEXT}, '&amp;?', '&', 'g')"
_TEXT = rf"list_transform(string_split(regexp_replace({_TEXT}, '[ \t\f\v]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(160)))"
_TEXT = rf"trim(regexp_replace(array_to_string({_TEXT}, chr(10)), chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), chr(10))"


@query(f"SELECT page_id, md5({_TEXT}) AS digest, length({_TEXT})::INT AS n FROM pages")
def page_text(spark, sf_dir):
    """A page's text: blocks as paragraphs, character references decoded once."""
    c = table(spark, sf_dir, "pages").select("page_id", T.html_text(F.concat("html", F.lit("<p>a&eacute;&#x42;&amp;lt;</p>"))).alias("c"))
    return c.select("page_id", F.md5(F.col("c").cast("binary")).alias("digest"), F.length("c").alias("n"))


@query(
    """WITH c AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN repeat('s', 250) WHEN page_id % 5 = 1 THEN 'short' END AS a, length(regexp_extract(html, '(?s)<article>(.*)</article>', 1)) AS b,
length(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS c, length(html) AS d FROM pages)
SELECT page_id, CASE WHEN length(a) >= 200 THEN 'structured' WHEN page_id % 3 <> 0 AND b >= 200 THEN 'article' WHEN c >= 200 THEN 'heading' WHEN page_id % 7 <> 0 AND d >= 200 THEN 'raw'
WHEN a IS NOT NULL THEN 'structured' WHEN page_id % 3 <> 0 THEN 'article' ELSE 'heading' END AS source FROM c""".replace("\\n", "\n")
)
def extraction_cascade(spark, sf_dir):
    """Of the texts that several extractors give, the first that is long enough, else the first there is."""
    k = F.col("page_id")
    structured = F.when(k % 5 == 0, F.repeat(F.lit("s"), 250)).when(k % 5 == 1, "short")
    article = F.when(k % 3 != 0, F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1))
    found = {"structured": structured, "article": article, "heading": F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), "raw": F.when(k % 7 != 0, F.col("html"))}
    return table(spark, sf_dir, "pages").select("page_id", T.first_long_enough(found, 200)["name"].alias("source"))


@query(
    """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \n\t]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_transform(regexp_extract_all(t, '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$'), lambda x: trim(x)) AS s FROM t)
SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s""".replace("\\n", "\n").replace("\\t", "\t")
)
def sentences(spark, sf_dir):
    """Each up to its terminator; what follows the last one is kept."""
    t = F.trim(F.regexp_replace("text", r"[ \n\t]+", " "))
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", T.sentences(t).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


#: SQL of the rule for questions and for the keys by which they are compared.
def question_sql(text: str) -> str:
    q = f"regexp_replace(regexp_replace(trim({text}, ' ' || chr(10) || chr(9)), '^[-*0-9.)\\s]+', ''), '\\s+', ' ', 'g')"
    q = f"trim(trim({q}), '，,。;；:：')"
    q = f"CASE WHEN length({q}) > 96 THEN trim(left({q}, 95)) || '…' ELSE {q} END"
    return f"CASE WHEN ({q}) = '' OR right({q}, 1) IN ('?', '？') THEN {q} ELSE ({q}) || '？' END"


def key_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({question_sql(text)}), '[?？!！。,.，;；:：]+$', ''))"


_ASKED = """CASE item_id % 6 WHEN 0 THEN text WHEN 1 THEN '1. ' || text WHEN 2 THEN '- 第' || item_id || '个问题：如何检索' || left(text, 9) || '？' WHEN 3 THEN
'，2) 什么是' || item_id || '，。' WHEN 4 THEN ' 12.) ' ELSE left(text, 20) || ' ?' END"""


@query(
    f"""WITH b AS (SELECT item_id, text, {_ASKED} AS asked FROM benchmark) SELECT item_id, {question_sql('asked')} AS question, {key_sql('asked')} AS key,
CASE WHEN length(text) <= 40 THEN text ELSE substring(text, 1, 39) || '…' END AS short FROM b"""
)
def questions(spark, sf_dir):
    """Questions in Latin and Chinese as they are asked, and the keys by which they are compared."""
    n, text = F.col("item_id"), F.col("text")
    asked = F.when(n % 6 == 0, text).when(n % 6 == 1, F.concat(F.lit("1. "), text)).when(n % 6 == 2, F.concat(F.lit("- 第"), n, F.lit("个问题：如何检索"), F.left(text, F.lit(9)), F.lit("？")))
    asked = asked.when(n % 6 == 3, F.concat(F.lit("，2) 什么是"), n, F.lit("，。"))).when(n % 6 == 4, " 12.) ").otherwise(F.concat(F.left(text, F.lit(20)), F.lit(" ?")))
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", T.question(asked).alias("question"), T.canonical_key(asked).alias("key"), T.trimmed(text, 40).alias("short"))


_EXTENSIONS = [
    *[(e, "image") for e in ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg", "tiff", "tif", "ico", "heic", "heif")],
    *[(e, "audio") for e in ("mp3", "wav", "m4a", "aac", "flac", "ogg", "opus", "wma")],
    *[(e, "video") for e in ("mp4", "mov", "avi", "mkv", "webm", "flv", "wmv", "m4v", "mpeg", "mpg")],
    *[(e, "doc") for e in ("pdf", "docx", "txt", "md", "csv")],
]


@query(f"SELECT p_partkey, {[kind for _, kind in _EXTENSIONS]}[p_partkey % {len(_EXTENSIONS)} + 1] AS modality FROM part")
def file_modality(spark, sf_dir):
    names = F.array(*[F.lit(e if i % 2 else e.upper()) for i, (e, _) in enumerate(_EXTENSIONS)])
    ext = F.get(names, (F.col("p_partkey") % len(_EXTENSIONS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.modality(F.concat(F.lit("dir.x/"), F.col("p_name"), F.lit("."), ext)).alias("modality"))


@query("WITH c AS (SELECT conv_id, turn, text || ' [' || turn || '] [' || (turn % 3) || '] [' || turn || '][99]' AS answer FROM conversations), r AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1)))::INT AS ref FROM c) SELECT r.conv_id, r.turn, r.ref FROM r JOIN conversations k ON k.conv_id = r.conv_id AND k.turn = r.ref".replace("\\\\", "\\"))
def validated_citations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answer = F.concat(F.coalesce("text", F.lit("")), F.format_string(" [%d] [%d] [%d][99]", F.col("turn"), F.col("turn") % 3, F.col("turn")))
    found = F.transform(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), 1)), lambda x: x.cast("int"))
    refs = c.select("conv_id", "turn", F.explode(found).alias("ref"))
    known = c.select("conv_id", F.col("turn").cast("int").alias("ref"))
    return refs.join(known, ["conv_id", "ref"]).select("conv_id", "turn", "ref")


@query(
    """WITH k AS (SELECT doc_id, source, text, len(list_filter(regexp_split_to_array(text, '[ ' || chr(10) || chr(9) || chr(13) || ']+'), lambda x: x
<> '')) AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT source, sum(n) AS total, count(*) AS refs FROM k GROUP BY source) SELECT doc_id, n,
length(CASE WHEN total > 4000 THEN left(text, greatest(100, (4000 // refs)::BIGINT)::BIGINT) ELSE text END)::INT AS kept FROM k JOIN s USING (source)"""
)
def token_budget(spark, sf_dir):
    k = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "source", "text", T.white_tokens(F.col("text")).cast("long").alias("n"))
    s = k.groupBy("source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("refs"))
    kept = F.when(F.col("total") > 4000, F.left("text", F.greatest(F.lit(100), F.floor(4000 / F.col("refs"))).cast("int"))).otherwise(F.col("text"))
    return k.join(s, "source").select("doc_id", "n", F.length(kept).alias("kept"))


@query(
    """SELECT p_partkey, (p_size * 61) // 60 || ':' || lpad(((p_size * 61) % 60)::VARCHAR, 2, '0') AS at, (p_size * 61) // 60 || '分' || (p_size * 61)
% 60 || '秒' AS spoken FROM part"""
)
def durations(spark, sf_dir):
    s = F.col("p_size") * 61
    return table(spark, sf_dir, "part").select("p_partkey", T.minutes(s).alias("at"), F.concat(F.floor(s / 60).cast("string"), F.lit("分"), (s % 60).cast("string"), F.lit("秒")).alias("spoken"))


@query(
    """SELECT p_partkey, w::INT AS start, least(w + 480, p_size * 100)::INT AS stop FROM part, LATERAL (SELECT unnest(generate_series(0, greatest(0,
p_size * 100 - 11), 470)) AS w)"""
)
def video_windows(spark, sf_dir):
    """Windows of 480 seconds that overlap by 10."""
    p = table(spark, sf_dir, "part").withColumn("length", F.col("p_size") * 100)
    w = p.select("p_partkey", "length", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("length") - 11), F.lit(470))).alias("start"))
    return w.select("p_partkey", "start", F.least(F.col("start") + 480, F.col("length")).alias("stop"))


@query("SELECT event_id, strftime(to_timestamp(floor(epoch(ts)))  AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at FROM events")
def event_times(spark, sf_dir):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", T.timestamp_text(F.when(F.col("event_id") % 2 == 0, seconds * 1000).otherwise(seconds)).alias("at"))


@query(
    """WITH r AS (SELECT 'customer' AS sheet, c_custkey AS i, concat('| ', c_custkey, ' | ', replace(replace(c_name || CASE WHEN c_custkey % 9 = 0 THEN '|' || chr(10) ELSE '' END, '|', chr(92) || '|'), chr(10), ' '), ' |') AS line FROM customer
UNION ALL SELECT 'region', r_regionkey, concat('| ', r_regionkey, ' | ', r_name, ' |') FROM region), n AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY i) AS k, count(*) OVER (PARTITION BY sheet) AS n FROM r)
SELECT sheet, md5(concat('| key | name |', chr(10), '|---|---|', chr(10), string_agg(line, chr(10) ORDER BY i), CASE WHEN max(n) > 200 THEN concat(chr(10), chr(10), '_（仅展示前 200 行，原始共 ', max(n), ' 行）_') ELSE '' END)) AS preview
FROM n WHERE k <= 200 GROUP BY sheet"""
)
def sheet_preview(spark, sf_dir):
    """A sheet's first rows as a Markdown table, with a note if there are more."""
    odd = F.when(F.col("c_custkey") % 9 == 0, "|\n").otherwise("")
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("sheet"), F.col("c_custkey").alias("i"), F.array(F.col("c_custkey").cast("string"), F.concat("c_name", odd)).alias("cells"))
    r = table(spark, sf_dir, "region").select(F.lit("region").alias("sheet"), F.col("r_regionkey").cast("long").alias("i"), F.array(F.col("r_regionkey").cast("string"), "r_name").alias("cells"))
    return C.sheet_preview(c.unionByName(r), "sheet", "i", "cells", ["key", "name"]).select("sheet", F.md5(F.col("preview").cast("binary")).alias("preview"))


_SCORE = """CASE WHEN name = q THEN 100.0 WHEN contains(name, q) THEN 50 + length(q) * 30.0 / length(name) ELSE 0 END + CASE WHEN contains(d, q) THEN 20 + length(q) * 10.0 / greatest(length(d), 1) ELSE 0 END
+ 10 * len(list_filter(string_split(q, ' '), lambda w: list_contains(string_split(name, ' '), w))) + 5 * len(list_filter(string_split(q, ' '), lambda w: list_contains(string_split(d, ' '), w)))"""


@query(
    f"""WITH p AS (SELECT p_partkey, lower(p_name) AS name, lower(p_type) AS d, lower(trim(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN left(p_name, 4) WHEN 2 THEN p_type ELSE p_brand || ' ' || p_name END)) AS q FROM part)
SELECT p_partkey, round({_SCORE}, 6)::DOUBLE AS score FROM p WHERE {_SCORE} > 0"""
)
def kb_text_score(spark, sf_dir):
    """How well a knowledge base's name and description fit what is typed."""
    k = F.col("p_partkey") % 4
    q = F.when(k == 0, F.col("p_name")).when(k == 1, F.left("p_name", F.lit(4))).when(k == 2, F.col("p_type")).otherwise(F.concat("p_brand", F.lit(" "), "p_name"))
    score = F.round(T.fit(q, F.col("p_name"), F.col("p_type")), 6)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).filter("score > 0")


@query("""WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 1 THEN round(c_acctbal, 0) WHEN 2 THEN c_acctbal / 1e7 ELSE
c_acctbal * 1000 + 0.5 END AS v FROM customer)
SELECT c_custkey, CASE WHEN abs(v - trunc(v)) < 1e-9 THEN trunc(v)::BIGINT::VARCHAR ELSE format('{:.4g}', v) END AS shown FROM v""")
def shown_numbers(spark, sf_dir):
    k, b = F.col("c_custkey") % 4, F.col("c_acctbal")
    v = F.when(k == 0, b).when(k == 1, F.round(b, 0)).when(k == 2, b / 1e7).otherwise(b * 1000 + 0.5)
    return table(spark, sf_dir, "customer").select("c_custkey", T.number_text(v).alias("shown"))
