import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import segment


def test_cheapest_path_like_all_paths():
    random.seed(1)
    for _ in range(200):
        run = "".join(random.choices("数据检索", k=random.randint(0, 9)))
        cost = {run[i:j]: random.randint(1, 9) for i in range(len(run)) for j in range(i + 1, min(i + 4, len(run)) + 1) if random.random() < 0.6}
        found = segment.cut(run, cost, 50)
        price = lambda words: sum(cost.get(w, 50 if len(w) == 1 else 10**9) for w in words)
        paths = []
        for cuts in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
            words, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    words.append(run[at:i])
                    at = i
            words += [run[at:]] if run else []
            if all(len(w) <= 4 for w in words):
                paths.append(words)
        least = min(map(price, paths), default=0)
        assert "".join(found) == run and price(found) == least
        assert [len(w) for w in found[::-1]] == max([[len(w) for w in p[::-1]] for p in paths if price(p) == least], default=[])


def test_words_are_learnt_and_cut(spark):
    """Words without spaces come back: those that are frequent, hold together and stand free."""
    random.seed(2)
    words = ["数据", "检索", "知识库", "图像", "模型学习", "问"]
    texts = ["".join(random.choices(words, k=12)) + random.choice("，。！ ") + " RAG2 " + "".join(random.choices(words, k=3)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "abc"])], "id long, text string").repartition(5)
    found = segment.dictionary(docs, "text")
    assert {w for w in words if len(w) > 1} <= {r["w"] for r in found.collect()}
    got = segment.segmented(docs, ["id"], "text", found).collect()
    right = [r["words"] for r in got if r["id"] < 400]
    assert sum(w in words or w == "RAG2" for ws in right for w in ws) > 0.97 * sum(map(len, right))
    assert {r["id"]: r["words"] for r in got if r["id"] >= 400} == {400: [], 401: [], 402: ["abc"]}
    assert segment.dictionary(docs.limit(0), "text").count() == 0
    few = segment.dictionary(docs, "text", most=7).collect()
    assert len(few) == 7 and len({r["total"] for r in few}) == 1


def test_topic_words_of_both_scripts(spark):
    rows = [("a", ["数据", "数据", "the", "的", "x"]), ("a", ["检索"]), ("b", ["检索", "model"]), ("c", ["什么"])]
    got = segment.tfidf(spark.createDataFrame(rows, "kb string, words array<string>"), "kb", 2).collect()
    assert sorted((r["kb"], r["place"], r["word"]) for r in got) == [("a", 1, "数据"), ("a", 2, "the"), ("b", 1, "model"), ("b", 2, "检索")]


def test_query_keywords(spark):
    cases = {"什么 是 向量检索？向量检索 a GPU GPU gpu": ["向量检索", "GPU", "gpu"], None: [], "": [], "一个，一些": [], "b2 a1 c3 d4 e5 f6 f6": ["f6", "b2", "a1", "c3", "d4"]}
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    assert {r["q"]: r["k"] for r in df.select("q", segment.query_keywords(F.col("q")).alias("k")).collect()} == cases


def test_many_runs_like_one_by_one():
    """Runs cut side by side are cut as each alone is, and strings counted as numbers are what a plain count gives; plain and empty runs too."""
    random.seed(4)
    runs = ["".join(random.choices("数据检索问", k=random.randint(0, 30))) for _ in range(300)] + ["RAG2", "", "龥" * 5]
    random.shuffle(runs)
    pieces = {r[i:j] for r in runs for i in range(len(r)) for j in range(i + 1, min(i + 4, len(r)) + 1) if random.random() < 0.1 and not r.isascii()}
    cost = {w: random.randint(1, 9) for w in sorted(pieces)}
    codes, ends = segment._codes(runs)
    found = segment.Cutter(cost, 50)(codes, ends, np.array([r.isascii() for r in runs]))
    wanted = [len(w) for r in runs for w in ([r] if r.isascii() else segment.cut(r, cost, 50)) if w]
    assert np.diff(np.r_[0, found]).tolist() == wanted
    counts, cjk = {}, [r for r in runs if not r.isascii()]
    for r in cjk:
        for i, j in ((i, j) for i in range(len(r)) for j in range(i + 1, min(i + 4, len(r)) + 1)):
            counts.setdefault(r[i:j], []).append((ord(r[i - 1]) if i else 0, ord(r[j]) if j < len(r) else 0))
    got = {w: (n, *b) for ws, ns, beside in segment.grams(cjk) for w, n, b in zip(ws, ns.tolist(), beside.tolist(), strict=True)}
    assert got == {w: (len(x), min(a for a, _ in x), max(a for a, _ in x), min(b for _, b in x), max(b for _, b in x)) for w, x in counts.items()}
    assert list(segment.grams([])) == [] and list(segment.some(["ab", None])) == [["ab", None]]


def test_first_words_of_repeated_keys(spark):
    """Texts of one key count as one, null keys too; a key that stands once is counted where it lies, without a shuffle of its words."""
    rows = [(1, "b1 a1 b1 的 c d1 e1 f1 g1"), (2, "x1 y1"), (2, "y1 z1"), (None, "n1"), (None, "n1 m1"), (3, None), (4, "一个 ab")]
    got = segment.first_words(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    found = sorted(((r["k"] or 0), r["place"], r["token"], r["n"]) for r in got.collect())
    assert [x for x in found if x[0] == 1] == [(1, 1, "b1", 2), (1, 2, "a1", 1), (1, 3, "d1", 1), (1, 4, "e1", 1), (1, 5, "f1", 1)]
    assert {x[1:] for x in found if x[0] == 0} == {(1, "n1", 2), (2, "m1", 1)} and [x for x in found if x[0] > 2] == [(4, 1, "ab", 1)]
    assert [x[2:] for x in found if x[0] == 2][0] == ("y1", 2) and {x[2:] for x in found if x[0] == 2} == {("y1", 2), ("x1", 1), ("z1", 1)}
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
