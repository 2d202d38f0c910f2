"""Aggregates, joins, windows, sampling and set operations over a corpus and its knowledge bases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import search as S
from lodestar.operators import segment as G
from lodestar.plans.content import key_sql
from lodestar.plans.registry import query, table
from lodestar.streaming import state


def n(alias: str):
    return F.count(F.lit(1)).alias(alias)


@query(
    """SELECT source AS kb_id, count(DISTINCT doc_id) AS files, count(*) AS chunks, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS english,
round(sum(n_chars) / 1048576.0, 2) AS size_mb FROM documents GROUP BY source"""
)
def kb_statistics(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("kb_id")).agg(F.countDistinct("doc_id").alias("files"), n("chunks"), F.sum((F.col("lang") == "en").cast("long")).alias("english"), F.round(F.sum("n_chars") / 1048576.0, 2).alias("size_mb"))


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM events
GROUP BY event_type"""
)
def retrieval_counters(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(n("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


@query(
    """WITH t AS (SELECT doc_id, source, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}|[一-龥]'))) AS nnz FROM documents) SELECT source AS
kb_id, count(*) FILTER (nnz > 0) AS ok, count(*) FILTER (nnz = 0 OR nnz IS NULL) AS failed, sum(nnz)::BIGINT AS total, round(avg(nnz), 6) AS mean FROM
t GROUP BY source"""
)
def sparse_statistics(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("source", F.size(F.array_distinct(T.words(F.col("text")))).alias("nnz"))
    t = t.withColumn("nnz", F.when(F.col("nnz") >= 0, F.col("nnz")))
    return t.groupBy(F.col("source").alias("kb_id")).agg(F.count_if(F.col("nnz") > 0).alias("ok"), F.count_if((F.col("nnz") == 0) | F.col("nnz").isNull()).alias("failed"), F.sum("nnz").cast("long").alias("total"), F.round(F.avg("nnz"), 6).alias("mean"))


COLUMNS = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]}


@query(
    "WITH u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::VARCHAR AS v FROM customer" for c in COLUMNS["customer"]) + """), p AS (SELECT
name, count(*) AS n_rows, count(*) FILTER (v IS NULL OR v = '') AS nulls, count(DISTINCT v) AS n_distinct, count(try_cast(v AS DOUBLE)) AS numbers,
    min(try_cast(v AS DOUBLE)) AS low, max(try_cast(v AS DOUBLE)) AS high, avg(try_cast(v AS DOUBLE)) AS mean FROM u GROUP BY name)
    SELECT name, n_rows, nulls, n_distinct, CASE WHEN numbers >= 0.8 * n_rows THEN 'numeric' WHEN n_distinct <= greatest(20, floor(0.1 * n_rows)) THEN
'categorical' ELSE 'text' END AS kind, round(low, 4) AS low, round(high, 4) AS high, round(mean, 4) AS mean FROM p"""
)
def column_profile(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in COLUMNS["customer"]])).alias("p")
    v = F.expr("try_cast(v AS double)")
    p = t.select(pairs).select("p.*").groupBy("name").agg(n("n_rows"), F.count_if(F.col("v").isNull() | (F.col("v") == "")).alias("nulls"), F.countDistinct("v").alias("n_distinct"), F.count(v).alias("numbers"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"))
    kind = F.when(F.col("numbers") >= 0.8 * F.col("n_rows"), "numeric").when(F.col("n_distinct") <= F.greatest(F.lit(20), F.floor(0.1 * F.col("n_rows"))), "categorical").otherwise("text")
    return p.select("name", "n_rows", "nulls", "n_distinct", kind.alias("kind"), *[F.round(c, 4).alias(c) for c in ("low", "high", "mean")])


@query(
    f"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fa5}}a-zA-Z0-9]+')) AS token, generate_subscripts(
regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fa5}}a-zA-Z0-9]+'), 1) AS pos FROM documents), t AS (SELECT doc_id, token, count(*) AS n, min(pos) AS pos FROM d WHERE
length(token) >= 2 AND token NOT IN {tuple(G.STOP_WORDS)} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos)
AS place FROM t) SELECT doc_id, token, n, place FROM r WHERE place <= 5"""
)
def top_keywords(spark, sf_dir):
    """Runs of two characters or more, in their case, that aren't stop words: the five most frequent, earlier ones on ties."""
    return G.first_words(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH d AS (SELECT source, doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9]+')) AS token FROM documents), tf AS (SELECT source,
token, count(*) AS tf FROM d WHERE length(token) >= 2 GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL), t AS (SELECT
count(DISTINCT source) AS total FROM documents),
s AS (SELECT source AS kb_id, token, tf * ln(total / df::DOUBLE) AS score FROM tf JOIN df USING (token), t), r AS (SELECT *, row_number() OVER
(PARTITION BY kb_id ORDER BY round(score, 6) DESC, token) AS place FROM s) SELECT kb_id, token, round(score, 6) AS score, place FROM r WHERE place <=
10""")
def topic_keywords(spark, sf_dir):
    """The words that tell a knowledge base from the others: those of its texts in Latin letters and, were there any, of its Chinese runs."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("kb_id"), "text")
    words = G.segmented(docs, ["kb_id"], "text", G.dictionary(docs, "text"))
    return G.tfidf(words, "kb_id").withColumnRenamed("word", "token")


#: Letters become characters and spaces go: texts that must be cut into words, made from those of the tables.
_LETTERS, _CHARS = "abcdefghijklmnopqrstuvwxyz ", "一个可以什么数据检索问题知识文档图像模型学习系统分析"


@query(
    f"""WITH RECURSIVE r AS (SELECT conv_id, translate(lower(text), '{_LETTERS}', '{_CHARS}') AS t FROM conversations), u AS (SELECT conv_id,
unnest(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fa5}}]+')) AS s FROM r), p AS (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM u),
g AS (SELECT substr(s, i, l) AS w, CASE WHEN i > 1 THEN substr(s, i - 1, 1) ELSE '' END AS a, CASE WHEN i + l <= length(s) THEN substr(s, i + l, 1)
ELSE '' END AS b FROM p, range(1, 5) x(l) WHERE i + l - 1 <= length(s)),
n AS (SELECT w, count(*) AS n, min(a) <> max(a) AND min(b) <> max(b) AS free FROM g GROUP BY w),
total AS (SELECT sum(n)::DOUBLE AS total FROM n WHERE length(w) = 1),
c AS (SELECT n.w, n.n, min(n.n * total / a.n / b.n) AS bound FROM n JOIN range(1, 4) k(k) ON k < length(n.w) JOIN n a ON a.w = left(n.w, k) JOIN n b
ON b.w = substr(n.w, k + 1), total WHERE n.n >= 5 AND n.free GROUP BY ALL),
d AS (SELECT w, round(1000 * ln(total / n))::BIGINT AS cost FROM (SELECT w, n FROM n WHERE length(w) = 1 UNION ALL SELECT w, n FROM c WHERE bound >=
3), total),
z AS (SELECT s, 0::BIGINT AS i, 0::BIGINT AS c0, NULL::BIGINT AS c1, NULL::BIGINT AS c2, NULL::BIGINT AS c3, '' AS p0, '' AS p1, '' AS p2, '' AS p3
FROM (SELECT DISTINCT s FROM u)
UNION ALL SELECT s, i + 1, m, c0, c1, c2, CASE m WHEN e4 THEN p3 || '|' || w4 WHEN e3 THEN p2 || '|' || w3 WHEN e2 THEN p1 || '|' || w2 ELSE p0 || '|'
|| w1 END, p0, p1, p2 FROM (SELECT z.*, d1.w AS w1, d2.w AS w2, d3.w AS w3, d4.w AS w4, c0 + d1.cost AS e1, c1 + d2.cost AS e2, c2 + d3.cost AS e3, c3 +
d4.cost AS e4, least(e1, e2, e3, e4) AS m FROM z JOIN d d1 ON d1.w = substr(s, i + 1, 1) LEFT JOIN d d2 ON i >= 1 AND d2.w = substr(s, i, 2) LEFT JOIN d
d3 ON i >= 2 AND d3.w = substr(s, i - 1, 3) LEFT JOIN d d4 ON i >= 3 AND d4.w = substr(s, i - 2, 4) WHERE i < length(s)) q),
w AS (SELECT conv_id, unnest(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fa5}}]+|[a-zA-Z0-9]+')) AS s FROM r),
o AS (SELECT conv_id, unnest(string_split(words, '|')) AS word FROM (SELECT conv_id, string_agg(coalesce(p0[2:], w.s), '|') AS words FROM w LEFT JOIN z
ON z.s = w.s AND i = length(w.s) GROUP BY conv_id) v),
tf AS (SELECT conv_id, word, count(*) AS tf FROM o WHERE length(word) >= 2 AND word NOT IN {tuple(G.STOP_WORDS)} GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY ALL), f AS (SELECT conv_id, word, round(tf * ln((SELECT count(DISTINCT conv_id) FROM conversations) /
df::DOUBLE), 6) AS score FROM tf JOIN df USING (word))
SELECT conv_id, word, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, word) AS place FROM f QUALIFY place <= 10"""
)
def segmented_keywords(spark, sf_dir):
    """Keywords of texts without spaces: a dictionary learnt from them, the most probable words, the first ten by TF-IDF."""
    texts = table(spark, sf_dir, "conversations").select("conv_id", F.translate(F.lower("text"), _LETTERS, _CHARS).alias("text"))
    return G.tfidf(G.segmented(texts, ["conv_id"], "text", G.dictionary(texts, "text")), "conv_id")


@query(
    """WITH g AS (SELECT lang, source, count(*) AS texts, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL), r AS (SELECT *, row_number()
OVER (PARTITION BY lang ORDER BY texts DESC, chars DESC, source DESC) AS n FROM g) SELECT lang, source AS best, texts, chars FROM r WHERE n = 1"""
)
def best_kb(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(n("texts"), F.sum("n_chars").alias("chars"))
    return g.groupBy("lang").agg(F.max(F.struct("texts", "chars", "source")).alias("m")).select("lang", F.col("m.source").alias("best"), "m.texts", "m.chars")


@query("SELECT doc_id, md5('42:' || doc_id) AS draw FROM documents ORDER BY draw, doc_id LIMIT 50")
def reservoir_sample(spark, sf_dir):
    draw = F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")).cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", draw.alias("draw")).orderBy("draw", "doc_id").limit(50)


@query(
    """SELECT n_name AS kb, coalesce(r_name, n_nationkey::VARCHAR) AS name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey
<> 2"""
)
def kb_names(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").filter("r_regionkey <> 2")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(F.col("n_name").alias("kb"), F.coalesce("r_name", F.col("n_nationkey").cast("string")).alias("name"))


@query(
    """SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (l.toxic = 1 OR l.quality =
0))"""
)
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").filter("toxic = 1 OR quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(gone, "doc_id", "left_anti")


@query(
    """SELECT l.doc_id, coalesce(nullif(trim(d.lang), ''), 'none') AS lang, concat_ws('；', d.lang, d.source) AS label FROM labels l JOIN documents d
USING (doc_id)"""
)
def point_get(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return table(spark, sf_dir, "labels").select("doc_id").join(d, "doc_id").select("doc_id", F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("none")).alias("lang"), F.concat_ws("；", "lang", "source").alias("label"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, turn, role, CASE
WHEN length(text) <= 100 THEN text ELSE substring(text, 1, 99) || '…' END AS text FROM r WHERE back <= 10"""
)
def last_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("back <= 10")
    return c.select("conv_id", "turn", "role", T.trimmed(F.col("text"), 100).alias("text"))


@query(
    """SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn, lag(length(text)) OVER w AS prev_chars,
lead(length(text)) OVER w AS next_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def neighbours(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"), F.lag(F.length("text")).over(w).alias("prev_chars"), F.lead(F.length("text")).over(w).alias("next_chars"))


@query(
    """WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) SELECT conv_id,
role, substring(text, 1, 80) AS summary FROM r WHERE n = 1"""
)
def first_summaries(spark, sf_dir):
    return S.first_per(table(spark, sf_dir, "conversations"), ("conv_id", "role"), F.col("turn")).select("conv_id", "role", F.substring("text", 1, 80).alias("summary"))


@query(
    """WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS
(PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c) SELECT conv_id,
island::BIGINT AS island, min(turn) AS first_turn, count(*) AS messages, sum(length(text))::BIGINT AS chars FROM i GROUP BY conv_id, island"""
)
def merged_messages(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.coalesce((F.col("role") != F.lag("role").over(w)).cast("long"), F.lit(1))
    i = table(spark, sf_dir, "conversations").withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return i.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), n("messages"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(
    f"""WITH k AS (SELECT item_id, {key_sql('text')} AS key FROM benchmark), r AS (SELECT *, row_number() OVER
(PARTITION BY key ORDER BY item_id) AS n FROM k) SELECT item_id, md5(key) AS key FROM r WHERE n = 1"""
)
def ordered_distinct(spark, sf_dir):
    k = table(spark, sf_dir, "benchmark").select("item_id", T.canonical_key(F.col("text")).alias("key"))
    return S.first_per(k, ("key",), F.col("item_id")).select("item_id", F.md5(F.col("key").cast("binary")).alias("key"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20 OFFSET 10")
def paging(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").orderBy("c_custkey").offset(10).limit(20).select("c_custkey", "c_name")


@query(
    """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) SELECT event_id,
user_id FROM r WHERE back <= 8"""
)
def tail_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id").withColumn("back", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))))
    return e.filter("back <= 8").select("event_id", "user_id")


@query("SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(n("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 120 second THEN 1 ELSE 0 END AS new FROM
events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) SELECT
user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s"""
)
def pending_sessions(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "120 seconds").alias("w")).agg(n("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, 1 + event_id % 7 AS delta, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM
events), r AS (SELECT user_id, i, event_id, delta AS total FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN r.total >= 50 THEN
0 ELSE r.total END + e.delta FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, event_id, total FROM r WHERE total >= 50""")
def counter_triggers(spark, sf_dir):
    """The events at which a key's summed deltas reach the threshold of 50; the counter is deleted then."""
    e = table(spark, sf_dir, "events").withColumn("delta", 1 + F.col("event_id") % 7)
    return state.counter_triggers(e, "user_id", "delta", ["ts", "event_id"]).select("user_id", "event_id", "total")
