"""Words of texts without spaces: a dictionary learnt from the corpus, and the most probable path over a word lattice.

Learning counts the strings of up to MAX_CHARS characters of each run of CJK characters. A string is a word if it is
frequent, holds together (each way to cut it is less likely than chance would have it by COHESION) and stands free
(more than one neighbour on either side). The counts are summed in tasks before they are shuffled, and everything
after them works on distinct strings. The dictionary is bounded, so tasks get it whole. A run is then cut where the
costs ``1000 * ln(total / count)`` of its words sum up to the least, by dynamic programming from left to right.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import saved

MAX_CHARS, LEAST_COUNT, COHESION, MOST_WORDS = 4, 5, 3.0, 200_000
CJK, PLAIN = "[一-龥]+", "[a-zA-Z0-9]+"
MIXED = "[一-龥a-zA-Z0-9]+"
_RUN, _MIXED = re.compile(f"{CJK}|{PLAIN}"), re.compile(MIXED)
#: Characters that are counted or cut at once, and a cost that no path of words reaches.
SOME_CHARS, NEVER = 500_000, 1 << 50

#: Words that are never keywords.
STOP_WORDS = [
    "的", "了", "是", "在", "有", "和", "就", "都", "而", "及", "与", "或", "一个", "一些", "这个", "那个", "什么", "怎么", "如何", "哪里", "谁",
    "可以", "能够", "应该", "需要", "希望", "想要", "打算", "考虑", "吗", "呢", "啊", "呀", "哦", "恩", "嗯",
]


def _codes(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all runs as numbers, and where each run ends among them."""
    return np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).astype(np.uint64), np.cumsum([len(r) for r in runs], dtype=np.int64)


def _strings(codes: np.ndarray, size: int) -> np.ndarray:
    """The string of ``size`` characters that begins at each place as one number; CJK characters take 16 bits each."""
    n = max(0, len(codes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out << np.uint64(16)) | codes[k : k + n]
    return out


def grams(runs: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """For each length: the distinct strings of it, how often they occur, and the least and greatest neighbour on the left
    and on the right (columns, as characters' numbers); the end of a run is 0. Runs are of CJK characters."""
    codes, ends = _codes(runs)
    stop = np.repeat(ends, np.diff(ends, prepend=0))
    begins = np.zeros(len(codes), bool)
    begins[np.r_[0, ends[:-1]][np.diff(ends, prepend=0) > 0]] = True
    before, after = np.r_[np.uint64(0), codes[:-1]], np.r_[codes, np.uint64(0)]
    before = np.where(begins, np.uint64(0), before[: len(codes)])
    for size in range(1, MAX_CHARS + 1):
        at = np.flatnonzero(np.arange(len(codes)) + size <= stop)
        if not len(at):
            return
        keys = _strings(codes, size)[at]
        left, right = before[at], np.where(at + size < stop[at], after[at + size], np.uint64(0))
        order = np.argsort(keys)
        keys, left, right = keys[order], left[order], right[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends_of = [f.reduceat(x, first) for x in (left, right) for f in (np.minimum, np.maximum)]
        bits = keys[first]
        chars = np.stack([(bits >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in reversed(range(size))], axis=1).astype("<u4")
        text = chars.tobytes().decode("utf-32-le")
        yield [text[i : i + size] for i in range(0, len(text), size)], np.diff(np.r_[first, len(keys)]), np.stack(ends_of, axis=1).astype(np.int32)


def some(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in groups of about SOME_CHARS characters, however many rows came at once."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t or "")
        if held >= SOME_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def counted(texts: DataFrame, text: str) -> DataFrame:
    """w, n, free: the strings of all runs, how often they occur and whether they have several neighbours on both sides."""
    names = ["w", "n", "a", "b", "c", "d"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in some(batch.column(0).to_pylist()):
                for strings, numbers, beside in grams([run for t in group if t for run in re.findall(CJK, t)]):
                    yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array(numbers, pa.int64()), *(pa.array(c) for c in beside.T.copy())], names=names)

    rows = texts.select(text).mapInArrow(count, "w string, n long, a int, b int, c int, d int")
    return rows.groupBy("w").agg(F.sum("n").alias("n"), ((F.min("a") != F.max("b")) & (F.min("c") != F.max("d"))).alias("free"))


def dictionary(texts: DataFrame, text: str, least: int = LEAST_COUNT, cohesion: float = COHESION, most: int = MOST_WORDS) -> DataFrame:
    """w, n, total: single characters and the words of several, at most ``most``, the most frequent first.

    Null and empty texts add nothing. Equal counts go by the string. Texts of any length are read whole, and counted once.
    """
    counts = saved(counted(texts, text), "string-counts")  # read four times
    single = counts.filter(F.length("w") == 1)
    total = single.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    cut = F.explode(F.sequence(F.lit(1), F.length("w") - 1))
    cuts = counts.filter((F.length("w") > 1) & (F.col("n") >= least) & F.col("free")).select("w", "n", cut.alias("k"))
    cuts = cuts.select("w", "n", F.left("w", F.col("k")).alias("l"), F.expr("substr(w, k + 1)").alias("r"))
    part = counts.select(F.col("w").alias("l"), F.col("n").alias("nl"))
    cuts = cuts.join(part, "l").join(part.select(F.col("l").alias("r"), F.col("nl").alias("nr")), "r").crossJoin(F.broadcast(total))  # one row
    bound = F.col("n").cast("double") * F.col("total") / F.col("nl") / F.col("nr")
    words = cuts.groupBy("w", "n").agg(F.min(bound).alias("bound")).filter(F.col("bound") >= cohesion).select("w", "n")
    best = single.select("w", "n").unionByName(words).orderBy(F.desc("n"), "w").limit(most)
    return best.crossJoin(F.broadcast(total))


def costs(words: DataFrame) -> tuple[dict[str, int], int]:
    """The cost of each word of a dictionary (it is bounded), and of a character that isn't in it."""
    rows = words.collect()
    total = rows[0]["total"] if rows else 1
    return {r["w"]: round(1000 * math.log(total / r["n"])) for r in rows}, round(1000 * math.log(2 * max(total, 1)))


def cut(run: str, cost: dict[str, int], unknown: int) -> list[str]:
    """The words of the cheapest path; of equally cheap ones the longer last word, from the end on."""
    best, length = [0], [0]
    for i in range(1, len(run) + 1):
        ways = [(best[i - k] + cost.get(run[i - k : i], unknown if k == 1 else math.inf), -k) for k in range(1, min(MAX_CHARS, i) + 1)]
        low, k = min(ways)
        best.append(low)
        length.append(-k)
    out, i = [], len(run)
    while i:
        out.append(run[i - length[i] : i])
        i -= length[i]
    return out[::-1]


class Cutter:
    """``cut`` for many runs at once: what a place costs is looked up for all, and all runs are walked through side by side."""

    def __init__(self, cost: dict[str, int], unknown: int):
        self.unknown, self.known = unknown, []
        for size in range(1, MAX_CHARS + 1):
            words = [w for w in cost if len(w) == size]
            keys = _strings(_codes(words)[0], size)[::size] if words else np.zeros(0, np.uint64)
            order = np.argsort(keys)
            self.known.append((keys[order], np.array([cost[w] for w in words], np.int64)[order]))

    def price(self, codes: np.ndarray, size: int) -> np.ndarray:
        keys, costs = self.known[size - 1]
        out = np.full(len(codes), self.unknown if size == 1 else NEVER, np.int64)
        if len(keys):
            own = _strings(codes, size)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            out[: len(own)] = np.where(keys[at] == own, costs[at], out[: len(own)])
        return out

    def __call__(self, codes: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Where words end. ``codes`` holds runs that end at ``ends``; those that are ``plain`` are words as they are."""
        prices = [self.price(codes, size) for size in range(1, MAX_CHARS + 1)]
        length = np.diff(ends, prepend=0)
        order = np.flatnonzero(~plain & (length > 0))
        order = order[np.argsort(-length[order], kind="stable")]  # the longest first, so that those still walked are the first ones
        start, size = (ends - length)[order], length[order]
        left = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right") if len(size) else []
        last = [np.full(len(order), 0 if k == 1 else NEVER, np.int64) for k in range(1, MAX_CHARS + 1)]  # the least costs up to k characters before
        words = np.zeros(len(codes), np.int64)  # by the place of its last character, the length of the word that ends there
        for i, n in enumerate(left, 1):
            at = start[:n] + i
            low, taken = np.full(n, 2 * NEVER), np.zeros(n, np.int64)
            for k in range(min(MAX_CHARS, i), 0, -1):
                way = last[k - 1][:n] + prices[k - 1][at - k]
                better = way < low  # so of equally cheap ways the longer word stays
                low, taken = np.where(better, way, low), np.where(better, k, taken)
            words[at - 1] = taken
            last = [low, *(x[:n] for x in last[:-1])]
        ended = np.zeros(len(codes) + 1, bool)
        ended[ends[length > 0]] = True
        at = start + size
        while len(at):
            at = at - words[at - 1]
            more = at > start
            at, start = at[more], start[more]
            ended[at] = True
        return np.flatnonzero(ended)


def segmented(texts: DataFrame, keys: list[str], text: str, words: DataFrame) -> DataFrame:
    """A row per text: ``keys`` and ``words``, the words of its CJK runs and its runs of letters and digits, in order."""
    cost, unknown = costs(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(cost, unknown)
        for batch in batches:
            done = 0
            for group in some(batch.column(len(keys)).to_pylist()):
                found = [_RUN.findall(t or "") for t in group]
                runs = [r for own in found for r in own]
                codes, ends = _codes(runs)
                word_ends = cutter(codes, ends, np.array([r.isascii() for r in runs], bool))
                place = np.r_[0, np.cumsum(np.where(codes < 128, 1, 3))]  # in UTF-8
                data = pa.py_buffer("".join(runs).encode())
                flat = pa.StringArray.from_buffers(len(word_ends), pa.py_buffer(np.r_[0, place[word_ends]].astype(np.int32)), data)
                text_ends = np.r_[0, ends][np.cumsum([len(own) for own in found])]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.searchsorted(word_ends, text_ends, side="right")].astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*(c.slice(done, len(group)) for c in batch.columns[: len(keys)]), lists], names=[*keys, "words"])
                done += len(group)

    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, text).mapInArrow(run, f"{kinds}, words array<string>")


def useful(word: Column) -> Column:
    return (F.length(word) >= 2) & ~word.isin(STOP_WORDS)


def tfidf(words: DataFrame, topic: str, most: int = 10) -> DataFrame:
    """topic, word, score, place: the first words of each topic by count times ln(topics / topics that have the word).

    The counts are saved: they give the topics of each word first, and then meet them."""
    tf = words.select(topic, F.explode("words").alias("word")).filter(useful(F.col("word"))).groupBy(topic, "word").agg(F.count(F.lit(1)).alias("tf"))
    tf = saved(tf, "word-counts")
    topics = F.broadcast(words.agg(F.countDistinct(topic).alias("topics")))
    df = saved(tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word-topics")
    scored = tf.join(df, "word").crossJoin(topics).select(topic, "word", F.round(F.col("tf") * F.log(F.col("topics") / F.col("df")), 6).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("score"), "word"))).filter(F.col("place") <= most)


def first_words(texts: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """key, token, n, place: a text's most frequent runs of CJK characters, letters and digits that are useful, earlier ones on
    ties. Texts of the same key count as one; only these are brought together."""
    many = saved(texts.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(F.col(key).alias("_key")), "repeated-keys")
    repeated = F.col(key).eqNullSafe(F.col("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = set(STOP_WORDS)
        for batch in batches:
            best = [Counter(w for w in _MIXED.findall(t or "") if len(w) > 1 and w not in stop).most_common(most) for t in batch.column(1).to_pylist()]
            at = [i for i, own in enumerate(best) for _ in own]
            columns = [pa.array([w for own in best for w, _ in own], pa.string()), pa.array([n for own in best for _, n in own], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns, pa.array([p for own in best for p in range(1, len(own) + 1)], pa.int32())], names=[key, "token", "n", "place"])

    once = texts.select(key, text).join(many, repeated, "left_anti")
    once = once.mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, token string, n long, place int")
    runs = F.regexp_extract_all(text, F.lit(MIXED), F.lit(0))
    rest = texts.join(many, repeated, "left_semi").select(key, F.posexplode(runs).alias("pos", "token")).filter(useful(F.col("token")))
    rest = rest.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "pos"))
    return once.unionByName(rest.withColumn("place", place).filter(F.col("place") <= most).drop("pos"))


def query_keywords(text: Column, most: int = 5) -> Column:
    """The most frequent runs of CJK characters, letters and digits of a query, of two characters or more, in their case;
    those that came first on ties."""
    runs = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[一-龥a-zA-Z0-9]+"), 0), lambda w: useful(w))
    counted_runs = F.transform(F.array_distinct(runs), lambda w, i: F.struct((-F.size(F.filter(runs, lambda x: x == w))).alias("n"), i.alias("at"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(counted_runs), 1, most), lambda x: x["w"])
