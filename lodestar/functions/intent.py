"""What a query asks for, by modality: keyword tests, validation of a model's answer, and overrides, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPLICIT, IMPLICIT, NONE = "explicit_demand", "implicit_enrichment", "unnecessary"
INTENT_TYPES = ["factual", "comparison", "analysis", "coding", "creative"]
MODALITIES = ("visual", "audio", "video")

#: What in a query asks for a modality outright, and what only suggests it. ``UI`` is never met, since
#: queries are compared in lower case.
ASKS = {
    "visual": ["看看", "给我看", "看一下", "展示", "显示", "有图吗", "有图片吗", "有图表吗", "有架构图吗", "有示意图吗", "show me", "let me see", "display", "view",
               "图片", "图表", "示意图", "流程图", "设计图", "可视化", "查看图片", "显示图片", "展示图片", "图片中", "图表中", "图中",
               "image", "chart", "diagram", "graph", "figure", "visualization", "架构图", "结构图", "系统图", "网络图", "拓扑图"],
    "audio": ["找音频", "找音乐", "找歌", "有录音吗", "有音乐吗", "播放", "听一下", "听这段", "放一下", "给我听", "有没有音频", "play", "listen to", "find the song",
              "audio", "music", "podcast", "recording", "音频", "音乐", "歌曲", "播客", "录音", "语音", "播放一下"],
    "video": ["视频", "片段", "视频片段", "视频画面", "画面解释", "结合视频", "结合画面", "有视频吗", "找视频", "播放视频", "看一下视频", "看视频", "展示视频",
              "video", "clip", "segment", "show me the video", "play the clip"],
}
SUGGESTS = {
    "visual": ["风光", "景色", "日出", "日落", "建筑", "外观", "造型", "界面", "UI", "布局", "系统架构", "技术架构", "架构设计", "拓扑", "数据对比", "营收对比", "性能对比", "指标对比",
               "产品图", "实物图", "截图", "照片", "实拍", "设计", "可视化展示", "landscape", "architecture", "layout", "design", "screenshot", "photo"],
    "audio": ["歌词", "旋律", "创作背景", "播客", "访谈", "会议纪要", "演讲", "培训录音", "lyrics", "melody", "interview", "meeting"],
    "video": ["教程", "演示", "录屏", "回放", "直播", "纪录片", "演讲视频", "会议录像", "操作演示", "教学视频", "发布会", "录播", "直播回放", "教程视频", "录播课",
              "tutorial", "demo", "recording", "playback", "webinar", "keynote"],
}
#: The words by which an answer that holds no JSON is read, in order.
ANSWER_TYPES = {
    "factual": ["factual", "事实"], "comparison": ["comparison", "比较"], "analysis": ["analysis", "分析"], "coding": ["coding", "编程", "代码"], "creative": ["creative", "创意"],
}
ANSWER_ASKS = {
    "visual": ["visual", "图片", "图表", "架构图", "示意图", "流程图", "设计图", "可视化", "查看图片", "显示图片", "展示图片", "图片中", "图表中", "图中", "看看",
               "image", "chart", "diagram", "graph", "figure", "visualization", "结构图", "系统图", "网络图", "拓扑图"],
    "audio": ASKS["audio"],
    "video": ASKS["video"],
}
ANSWER_SUGGESTS = {"visual": [], "audio": [*SUGGESTS["audio"], "podcast", "recording"], "video": SUGGESTS["video"]}
#: What a query says when it points at something it doesn't name; compared without white space.
POINTING = ["这是", "这是什么", "这是啥", "图里", "图中", "图片里", "这张图", "这个图", "这幅图", "什么意思", "讲了什么", "说了什么", "介绍一下这个", "whatisthis", "whatsthis"]
POINTERS, ASKED = ["这", "它", "此"], ["是", "啥", "谁", "什么"]
#: File types by modality.
FILE_MODALITY = {"image": "visual", "audio": "audio", "video": "video"}


def any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)) if words else F.lit(False)


def asks(query: Column, modality: str) -> Column:
    return any_of(F.lower(query), ASKS[modality])


def suggests(query: Column, modality: str) -> Column:
    return any_of(F.lower(query), SUGGESTS[modality])


def deictic(query: Column) -> Column:
    """Whether a query points at something it doesn't name, by a phrase or by being short."""
    q = F.regexp_replace(F.lower(F.trim(query)), r"\s+", "")
    return any_of(q, POINTING) | ((F.length(q) <= 6) & any_of(q, POINTERS) & any_of(q, ASKED))


def validated(intent: Column, query: Column, modality: str) -> Column:
    """A model's verdict on one modality, held against the query: what the query asks for outright wins, a verdict that isn't
    one is replaced by the keywords', and (not for audio) a mere suggestion lifts ``unnecessary``."""
    known = F.coalesce(intent.isin(EXPLICIT, IMPLICIT, NONE), F.lit(False))
    lifted = ~known if modality == "audio" else ~known | (intent == NONE)
    return F.when(asks(query, modality), EXPLICIT).when(suggests(query, modality) & lifted, IMPLICIT).when(known, intent).otherwise(NONE)


def intent_type(answer: Column) -> Column:
    """The kind of question that an answer without JSON names; factual if none."""
    out = F.when(F.lit(False), "")
    for kind, words in ANSWER_TYPES.items():
        out = out.when(any_of(F.lower(answer), words), kind)
    return out.otherwise("factual")


def by_keywords(answer: Column, modality: str) -> Column:
    text = F.lower(answer)
    return F.when(any_of(text, ANSWER_ASKS[modality]), EXPLICIT).when(any_of(text, ANSWER_SUGGESTS[modality]), IMPLICIT).otherwise(NONE)


def for_selected(intent: Column, query: Column, selected: Column) -> Column:
    """A modality's intent when files of it are selected: at least implicit, explicit if the query points at them."""
    pointing = deictic(query)
    target = F.when(pointing, EXPLICIT).otherwise(IMPLICIT)
    return F.when(selected & ((intent == NONE) | (pointing & (intent != EXPLICIT))), target).otherwise(intent)


def route_weight(route: Column, visual: Column, audio: Column, video: Column, base: dict[str, float]) -> Column:
    """A route's weight in rank fusion, by what the query asks for."""
    by = lambda intent, asked, suggested, none: F.when(intent == EXPLICIT, asked).when(intent == IMPLICIT, suggested).otherwise(none)
    seen = by(visual, F.when(video == EXPLICIT, 0.9).otherwise(1.2), F.lit(0.9), F.lit(0.0))
    heard, shown = by(audio, F.lit(1.2), F.lit(0.9), F.lit(0.0)), by(video, F.lit(1.2), F.lit(1.0), F.lit(base["video"]))
    fixed = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
    return F.when(route == "visual", seen).when(route == "audio", heard).when(route == "video", shown).otherwise(F.coalesce(fixed[route], F.lit(1.0)))


def triggered(chat_type: Column, text: Column, mentions: Column, prefix: str = "", bot: str = "") -> Column:
    """Whether a message is for the bot: outside groups always, in them by prefix or by mention (any, if the bot's id isn't known)."""
    named = F.filter(F.coalesce(mentions, F.array().cast("array<string>")), lambda m: m.isNotNull() & (m != ""))
    called = F.array_contains(named, bot) if bot else F.size(named) > 0
    begun = F.trim(text).startswith(prefix) if prefix else F.lit(False)
    return (F.coalesce(F.lower(chat_type), F.lit("")) != "group") | F.coalesce(begun, F.lit(False)) | called
