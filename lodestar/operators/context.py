"""Retrieved rows as numbered materials of a prompt, as references of an answer, and as rows for clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T

#: Names of modalities in materials, most characters of each part, and what stands where there is nothing.
LABELS = {"doc": "文档", "image": "图片", "audio": "音频", "video": "视频"}
DOC_CHARS, IMAGE_CHARS, AUDIO_CHARS, FRAMES, PREVIEW_CHARS, CLIENT_CHARS = 500, 300, 500, 5, 200, 500
NO_FRAMES, UNKNOWN = "无关键帧信息", "未知"
HEAD, MEDIA_NOTE = "参考材料列表：\n", "**注意**：以下材料包含多媒体内容（图片/音频/视频），请仔细阅读相关描述和转写文本，判断其是否与用户查询相关。\n"


def cleaned(c: Column) -> Column:
    """Spaces collapsed; what is neither letter, number nor plain punctuation becomes a space."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    return F.trim(F.regexp_replace(c, r"""[^\p{L}\p{N}_\s.,;:!?\-()\[\]"'/\\]""", " "))


def cut(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def spoken(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.when(seconds > 0, F.concat(F.floor(whole / 60).cast("string"), F.lit("分"), (whole % 60).cast("string"), F.lit("秒"))).otherwise(UNKNOWN)


def frame_lines(frames: Column) -> Column:
    """frames: array of (at, text) -> the first few as lines."""
    line = lambda f: F.concat(F.lit("- "), F.floor(f["at"] / 60).cast("string"), F.lit(":"), F.lpad((F.floor(f["at"]) % 60).cast("string"), 2, "0"), F.lit(" - "), F.coalesce(f["text"], F.lit("")))
    return F.when(F.size(frames) > 0, F.array_join(F.transform(F.slice(frames, 1, FRAMES), line), "\n")).otherwise(NO_FRAMES)


def material(index: Column, kind: Column, path: Column, content: Column, description: Column, seconds: Column, frames: Column) -> Column:
    """One numbered material, by its modality."""
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[kind]
    head = F.concat(F.lit("【材料 "), index.cast("string"), F.lit("】 (类型: "), label, F.lit(" | 来源: "), path, F.lit(")\n"))
    text = cleaned(content)
    doc, image = F.concat(F.lit("内容片段：\n"), cut(text, DOC_CHARS)), F.concat(F.lit("[视觉描述]：\n"), cut(text, IMAGE_CHARS))
    length = F.concat(F.lit("时长："), spoken(seconds))
    audio = F.concat(length, F.lit("\n转写文本：\n"), cut(text, AUDIO_CHARS), F.lit("\n描述："), cleaned(description))
    video = F.concat(length, F.lit("\n描述："), text, F.lit("\n关键帧：\n"), frame_lines(frames))
    return F.concat(head, F.when(kind == "doc", doc).when(kind == "image", image).when(kind == "audio", audio).otherwise(video))


def assembled(materials: DataFrame, key: str, question: Column) -> DataFrame:
    """materials (key, ref_id, content_type, material) -> (key, context): head, note on media, materials in order, question.

    A key has at most its quota of references, so a group is small.
    """
    held = materials.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("ref_id", "material"))).alias("m"), F.bool_or(F.col("content_type") != "doc").alias("media"), F.first(question).alias("q"),
    )
    parts = F.flatten(F.transform("m", lambda x: F.array(x["material"], F.lit(""))))
    note = F.when(F.col("media"), F.array(F.lit(MEDIA_NOTE))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(F.array(F.lit(HEAD)), note, parts, F.array(F.concat(F.lit("用户问题："), F.col("q"))))
    return held.select(key, F.array_join(whole, "\n").alias("context"))


ATTACHED = "【本轮用户上传的媒体摘要（非知识库检索结果，请勿使用下方参考材料的编号引用；回答中请用自然语言指代用户上传的图片/音频）】\n"
MOST_TOKENS, LEAST_CHARS, FRAME = 4000, 100, "（视频关键帧）"


def attached(context: Column, attachment: Column) -> Column:
    """The context after what the user uploaded with the question, if there is anything."""
    own = F.nullif(F.trim(attachment), F.lit(""))
    return F.when(own.isNotNull(), F.concat_ws("\n", F.lit(ATTACHED), own, F.lit(""), context)).otherwise(context)


def with_keyframes(references: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """references (key, ref_id, content_type, path, content), frames (key, ref_id, nth, path, text) -> the references, and after the last
    number each video's frames as images, in the order of videos and frames. Frames without a path, and those of others, are left out."""
    videos = references.filter("content_type = 'video'").select(key, "ref_id")
    shown = frames.filter(F.col("path").isNotNull() & (F.col("path") != "")).join(videos, [key, "ref_id"])
    last = references.groupBy(key).agg(F.max("ref_id").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("ref_id", "nth"))
    more = shown.withColumn("_nth", nth).join(last, key).select(
        key, (F.col("_last") + F.col("_nth")).alias("ref_id"), F.lit("image").alias("content_type"), "path",
        F.coalesce(F.nullif("text", F.lit("")), F.lit(FRAME)).alias("content"), F.col("ref_id").alias("of_video"),
    )
    return references.withColumn("of_video", F.lit(None).cast(more.schema["of_video"].dataType)).unionByName(more, allowMissingColumns=True)


def shortened(contexts: DataFrame, references: DataFrame, key: str, most: int = MOST_TOKENS) -> DataFrame:
    """contexts (key, context): one of more than ``most`` white-space tokens is made anew from the beginnings of its references (key,
    ref_id, content_type, path, content), each cut to an even share of ``most`` characters; all but documents are called images."""
    tokens = T.white_tokens(F.col("context"))
    doc = F.col("content_type") == "doc"
    share = F.greatest(F.lit(LEAST_CHARS), F.floor(most / F.count(F.lit(1)).over(Window.partitionBy(key)))).cast("int")
    head = F.concat(F.lit("【材料 "), F.col("ref_id").cast("string"), F.lit("】 (类型: "), F.when(doc, LABELS["doc"]).otherwise(LABELS["image"]), F.lit(" | 来源: "), F.coalesce("path", F.lit("")), F.lit(")"))
    part = F.concat_ws("\n", head, F.when(doc, "内容片段：").otherwise("[视觉描述]："), F.concat(F.left(F.coalesce("content", F.lit("")), share), F.lit("...\n")))
    long = contexts.withColumn("_tokens", tokens)
    anew = references.join(long.filter(F.col("_tokens") > most).select(key), key).withColumn("_part", part)
    anew = anew.groupBy(key).agg(F.concat_ws("\n", F.lit(HEAD), F.transform(F.sort_array(F.collect_list(F.struct("ref_id", "_part"))), lambda x: x["_part"])).alias("_short"))
    return long.join(anew, key, "left").select(key, F.coalesce("_short", "context").alias("context"), F.col("_tokens").alias("tokens"))


def asked_with(question: Column, context: Column) -> Column:
    """The user's turn: the materials between rules, then the question; or the question alone."""
    lead = F.lit("以下是根据检索结果整理的参考材料，以及用户的最新问题。\n\n---\n")
    alone = F.concat(F.lit("用户问题："), question)
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(lead, context, F.lit("\n---\n\n"), alone)).otherwise(alone)


def warnings(text: Column, kind: Column) -> Column:
    """What a formatted material lacks: the numbered head, or any citation."""
    headless = kind.isin("doc", "image") & ~text.rlike(r"【材料 \d+】")
    uncited = (kind == "doc") & ~text.rlike(r"\[\d+\]")
    return F.concat_ws(",", F.when(headless, "缺少标准引用格式"), F.when(uncited, "没有找到引用编号"))


def preview(content: Column) -> Column:
    return cut(content, PREVIEW_CHARS)


def cited(answers: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """answers (key, answer), references (key, ref_id, chunk_id, path, ..) -> the references an answer cites, in its order.

    Unknown numbers are dropped, and of those that stand for the same chunk (or, without a chunk, the same path) the first stays.
    """
    found = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1))
    cites = answers.select(key, F.posexplode(found).alias("place", "ref_id"))
    known = cites.join(references.withColumn("ref_id", F.col("ref_id").cast("string")), [key, "ref_id"])
    same = F.coalesce(F.nullif(F.col("chunk_id").cast("string"), F.lit("")), F.nullif("path", F.lit("")), F.concat(F.lit("#"), "ref_id"))
    first = known.withColumn("_n", F.row_number().over(Window.partitionBy(key, same).orderBy("place"))).filter("_n = 1").drop("_n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("place")))


def completed(validated: DataFrame, base: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Validated references with what is known of them before: a field of ``base`` stands unless it is null or empty."""
    both = validated.alias("v").join(base.select(key, "ref_id", *fields).alias("b"), [key, "ref_id"], "left")
    filled = [F.coalesce(F.nullif(F.col(f"b.{f}"), F.lit("")), F.col(f"v.{f}")).alias(f) for f in fields]
    return both.select(key, "ref_id", *filled)


def client_rows(references: DataFrame, neighbours: DataFrame, key: str) -> DataFrame:
    """references (key, ref_id, content_type, path, content, score, chunk_id), neighbours (chunk_id, prev, next) -> rows for clients:
    the file's name, the beginning of the text, and for documents the text around."""
    name = F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1)
    joined = references.join(neighbours, "chunk_id", "left")
    around = lambda c: F.when(F.col("content_type") == "doc", F.coalesce(c, F.lit("")))
    return joined.select(key, "ref_id", F.col("content_type").alias("type"), name.alias("file_name"), F.left(F.coalesce("content", F.lit("")), F.lit(CLIENT_CHARS)).alias("content"), "score", around("prev").alias("prev"), around("next").alias("next"))
