"""Queries on what users ask for: keywords, model answers, selected files, group messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import intent as I
from lodestar.functions import text as T
from lodestar.plans.registry import query, table

#: Phrases that are put behind the made-up messages, so that each rule meets cases.
ENDINGS = ["", "看一下图片", "有架构图吗", "播放音乐", "歌词", "教程", "Show me the VIDEO", "UI 布局", "这是啥", "landscape photo", "meeting demo", "它 是谁", "What Is This"]


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"


def _any(text: str, words: list[str]) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({text}, w))) > 0"


_ASKED = f"""a AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN e ELSE coalesce(text, '') || ' ' || e END AS q FROM
(SELECT *, ({_list(ENDINGS)})[(conv_id * 7 + turn) % {len(ENDINGS)} + 1] AS e FROM conversations))"""
_BARE = "regexp_replace(lower(trim(q)), '[ ' || chr(9) || chr(10) || chr(13) || ']+', '', 'g')"
_DEICTIC = f"({_any('b', I.POINTING)} OR length(b) <= 6 AND {_any('b', I.POINTERS)} AND {_any('b', I.ASKED)})"


def asked(spark, sf_dir: str):
    c = table(spark, sf_dir, "conversations")
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), ((F.col("conv_id") * 7 + F.col("turn")) % len(ENDINGS)).cast("int"))
    q = F.when(F.col("turn") % 3 == 0, ending).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), ending))
    return c.select("conv_id", "turn", "role", q.alias("q"))


@query(
    f"WITH {_ASKED}, s AS (SELECT *, lower(q) AS l, {_BARE} AS b FROM a) SELECT conv_id, turn, {_DEICTIC} AS deictic, "
    + ", ".join(f"{_any('l', words[m])} AS {m}_{name}" for name, words in (("asked", I.ASKS), ("suggested", I.SUGGESTS)) for m in I.MODALITIES)
    + " FROM s"
)
def intent_keywords(spark, sf_dir):
    q = F.col("q")
    tests = [f(q, m).alias(f"{m}_{name}") for name, f in (("asked", I.asks), ("suggested", I.suggests)) for m in I.MODALITIES]
    return asked(spark, sf_dir).select("conv_id", "turn", I.deictic(q).alias("deictic"), *tests)


_GIVEN = "CASE (turn + conv_id) % 4 WHEN 0 THEN 'unnecessary' WHEN 1 THEN 'implicit_enrichment' WHEN 2 THEN 'explicit_demand' ELSE 'maybe' END"


def given():
    kinds = F.array(*[F.lit(x) for x in (I.NONE, I.IMPLICIT, I.EXPLICIT, "maybe")])
    return F.get(kinds, ((F.col("turn") + F.col("conv_id")) % 4).cast("int"))


def _validated_sql(m: str) -> str:
    lifted = "g NOT IN ('unnecessary', 'implicit_enrichment', 'explicit_demand')" + ("" if m == "audio" else " OR g = 'unnecessary'")
    known = "g IN ('unnecessary', 'implicit_enrichment', 'explicit_demand')"
    return f"CASE WHEN {_any('l', I.ASKS[m])} THEN 'explicit_demand' WHEN {_any('l', I.SUGGESTS[m])} AND ({lifted}) THEN 'implicit_enrichment' WHEN {known} THEN g ELSE 'unnecessary' END"


@query(f"WITH {_ASKED}, s AS (SELECT *, lower(q) AS l, {_GIVEN} AS g FROM a) SELECT conv_id, turn, " + ", ".join(f"{_validated_sql(m)} AS {m}" for m in I.MODALITIES) + " FROM s")
def intent_validation(spark, sf_dir):
    """A model's verdicts, some of them no verdicts, held against the query."""
    return asked(spark, sf_dir).select("conv_id", "turn", *[I.validated(given(), F.col("q"), m).alias(m) for m in I.MODALITIES])


_TYPES = "CASE " + " ".join(f"WHEN {_any('l', words)} THEN '{kind}'" for kind, words in I.ANSWER_TYPES.items()) + " ELSE 'factual' END"
_BY_WORDS = {
    m: f"CASE WHEN {_any('l', I.ANSWER_ASKS[m])} THEN 'explicit_demand' WHEN {_any('l', I.ANSWER_SUGGESTS[m])} THEN 'implicit_enrichment' ELSE 'unnecessary' END" for m in I.MODALITIES
}


@query(
    f"WITH {_ASKED}, s AS (SELECT *, lower(q) || CASE WHEN turn % 4 = 1 THEN ' comparison 复杂' WHEN turn % 4 = 2 THEN ' 代码' ELSE '' END AS l FROM a) "
    f"SELECT conv_id, turn, {_TYPES} AS intent_type, contains(l, 'complex') OR contains(l, '复杂') AS is_complex, " + ", ".join(f"{sql} AS {m}" for m, sql in _BY_WORDS.items()) + " FROM s"
)
def intent_by_keywords(spark, sf_dir):
    """The classifier that reads an answer which isn't JSON."""
    ending = F.when(F.col("turn") % 4 == 1, " comparison 复杂").when(F.col("turn") % 4 == 2, " 代码").otherwise("")
    a = asked(spark, sf_dir).withColumn("q", F.concat("q", ending))
    is_complex = I.any_of(F.lower("q"), ["complex", "复杂"]).alias("is_complex")
    return a.select("conv_id", "turn", I.intent_type(F.col("q")).alias("intent_type"), is_complex, *[I.by_keywords(F.col("q"), m).alias(m) for m in I.MODALITIES])


@query(
    f"WITH {_ASKED}, s AS (SELECT *, lower(q) AS l FROM a) SELECT conv_id, turn, "
    "CASE turn % 3 WHEN 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'analysis' ELSE 'factual' END WHEN 1 THEN " + _TYPES + " ELSE 'factual' END AS intent_type, "
    f"CASE turn % 3 WHEN 0 THEN 'implicit_enrichment' WHEN 1 THEN {_BY_WORDS['video']} ELSE 'unnecessary' END AS video FROM s"
)
def intent_answers(spark, sf_dir):
    """Answers as JSON inside prose, as prose, or missing: read as JSON, then by keywords, then by default."""
    kind = F.when(F.col("conv_id") % 2 == 0, "analysis").otherwise("wrong kind")
    as_json = F.concat(F.lit("Here: "), F.to_json(F.struct(kind.alias("intent_type"), F.lit(I.IMPLICIT).alias("video_intent"))), F.lit(" so."))
    answer = F.when(F.col("turn") % 3 == 0, as_json).when(F.col("turn") % 3 == 1, F.col("q"))
    a = asked(spark, sf_dir).select("conv_id", "turn", answer.alias("a"))
    found = F.from_json(F.nullif(F.regexp_extract("a", r"(?s)\{.*\}", 0), F.lit("")), "intent_type string, video_intent string")
    a = a.withColumn("j", found)
    kind = F.when(F.col("j.intent_type").isin(I.INTENT_TYPES), F.col("j.intent_type")).when(F.col("j").isNotNull(), "factual")
    kind = kind.when(F.col("a").isNotNull(), I.intent_type(F.col("a"))).otherwise("factual")
    video = F.when(F.col("j").isNotNull(), F.coalesce("j.video_intent", F.lit(I.NONE))).when(F.col("a").isNotNull(), I.by_keywords(F.col("a"), "video")).otherwise(I.NONE)
    return a.select("conv_id", "turn", kind.alias("intent_type"), video.alias("video"))


_FILES = [["a.PNG"], [], ["b.mp3", "c.mkv", "d.mp3"], ["e.pdf", "f"], ["g.heic", "h.opus"], ["i.mpeg"]]
_FILES_SQL = "[" + ", ".join(_list(f) for f in _FILES) + "]"


@query(
    f"""WITH {_ASKED}, s AS (SELECT *, {_GIVEN} AS g, {_BARE} AS b, (conv_id + 2 * turn) % {len(_FILES)} AS f FROM a WHERE (turn + conv_id) % 4 <> 3)
SELECT conv_id, turn, ['image', '', 'audio,video', 'doc', 'image,audio', 'video'][f + 1] AS modalities, """
    + ", ".join(
        f"CASE WHEN f IN {places} AND (g = 'unnecessary' OR {_DEICTIC} AND g <> 'explicit_demand') THEN CASE WHEN {_DEICTIC} THEN 'explicit_demand' ELSE 'implicit_enrichment' END ELSE g END AS {m}"
        for m, places in (("visual", "(0, 4)"), ("audio", "(2, 4)"), ("video", "(2, 5)"))
    )
    + " FROM s"
)
def selected_file_intents(spark, sf_dir):
    """Intents where files are selected, and those files' modalities, each once and in order."""
    files = F.array(*[F.array(*[F.lit(x) for x in f]).cast("array<string>") for f in _FILES])
    a = asked(spark, sf_dir).filter((F.col("turn") + F.col("conv_id")) % 4 != 3)
    a = a.withColumn("files", F.get(files, ((F.col("conv_id") + 2 * F.col("turn")) % len(_FILES)).cast("int")))
    a = a.withColumn("kinds", F.array_distinct(F.transform("files", T.modality)))
    own = [I.for_selected(given(), F.col("q"), F.array_contains("kinds", kind)).alias(m) for kind, m in I.FILE_MODALITY.items()]
    return a.select("conv_id", "turn", F.array_join("kinds", ",").alias("modalities"), *own)


@query("""SELECT conv_id, turn, NOT role = 'user' OR turn % 5 = 0 OR conv_id % 3 = 1 AS by_name, NOT role = 'user' OR conv_id % 3 <> 0 AS by_any FROM
conversations""")
def group_triggers(spark, sf_dir):
    """Which messages the bot answers: users speak in groups, some with its prefix, some mention it or someone else."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "Group").otherwise("p2p")
    text = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("  /ask "), F.coalesce("text", F.lit("")))).otherwise(F.lit("hello /ask"))
    mentions = F.when(F.col("conv_id") % 3 == 1, F.array(F.lit("x"), F.lit("bot"))).when(F.col("conv_id") % 3 == 2, F.array(F.lit("x"), F.lit("")))
    by_name, by_any = I.triggered(kind, text, mentions, "/ask", "bot"), I.triggered(kind, text, mentions)
    return c.select("conv_id", "turn", by_name.alias("by_name"), by_any.alias("by_any"))
