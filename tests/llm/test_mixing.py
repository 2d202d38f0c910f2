import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int, _key int, copies int"


def table(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names clash."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def reshared(sizes, total):
    """The rule as it is told: share by weight, stop at twice the size, share the excess among the others, until none is above."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    out, stopped, left = [Fraction(0)] * len(sizes), set(), Fraction(total)
    while left and len(stopped) < len(sizes):
        rest = sum(w for i, w in enumerate(weights) if i not in stopped)
        out = [x if i in stopped else x + left * weights[i] / rest for i, x in enumerate(out)]
        left = Fraction(0)
        for i, x in enumerate(out):
            if i not in stopped and x >= 2 * sizes[i]:
                left, out[i] = left + x - 2 * sizes[i], Fraction(2 * sizes[i])
                stopped.add(i)
    return out


def test_targets_like_the_rule():
    random.seed(1)
    for _ in range(200):
        sizes = [random.choice([0, 1, random.randint(0, 1000)]) for _ in range(random.randint(1, 9))]
        total = Fraction(3 * sum(sizes), 2)
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        assert mixing.targets(sizes, weights, total, 2) == reshared(sizes, total)


def brute_flow(patterns, quotas, most, steps):
    """(most tokens, least cost of that many) over all whole flows."""
    choices = []
    for members, c in patterns:
        own = [x for x in itertools.product(range(most * c + 1), repeat=len(members)) if sum(x) <= most * c]
        choices.append([dict(zip(members, x, strict=True)) for x in own])
    parts = lambda c: [c * (k % steps + 1) // steps - c * (k % steps) // steps for k in range(most * steps)]

    def cost(c, used):
        total = 0
        for level, n in enumerate(parts(c)):
            total, used = total + level * min(n, used), used - min(n, used)
        return total

    best = (0, 0)
    for pick in itertools.product(*choices):
        spent = Counter()
        for f in pick:
            spent.update(f)
        if all(spent[s] <= q for s, q in enumerate(quotas)):
            best = max(best, (sum(spent.values()), -sum(cost(c, sum(f.values())) for (_, c), f in zip(patterns, pick, strict=True))))
    return best


def test_flow_like_brute_force():
    random.seed(2)
    for _ in range(60):
        n = random.randint(1, 3)
        patterns = [(sorted(random.sample(range(n), random.randint(1, min(2, n)))), random.randint(0, 3)) for _ in range(random.randint(1, 3))]
        quotas = [random.randint(0, 6) for _ in range(n)]
        flow = mixing.route(patterns, quotas, 2, 2)
        spent = Counter()
        cost = 0
        for (members, c), f in zip(patterns, flow, strict=True):
            assert set(f) == set(members) and min(f.values(), default=0) >= 0 and sum(f.values()) <= 2 * c
            spent.update(f)
            used = sum(f.values())
            for level in range(4):
                part = c * (level % 2 + 1) // 2 - c * (level % 2) // 2
                cost, used = cost + level * min(part, used), used - min(part, used)
        assert all(spent[s] <= q for s, q in enumerate(quotas))
        assert (sum(spent.values()), -cost) == brute_flow(patterns, quotas, 2, 2)


def checked(rows, got):
    """The contract: rows, sizes and targets by the rule, whole copies up to two, sums near targets."""
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(names, reshared([sizes[s] for s in names], Fraction(3 * sum(sizes.values()), 2)), strict=True))
    taken, small = Counter(), defaultdict(lambda: 0)
    sources = {i: s for i, _, s in rows}
    for r in got:
        s = sources[r["doc_id"]]
        assert (r["source_size"], r["target"]) == (sizes[s], float(wanted[s]))
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        small[s] = max(small[s], r["size"])
    assert all(abs(taken[s] - wanted[s]) <= small[s] for s in names)
    return {s: abs(taken[s] - wanted[s]) for s in names}


def test_mix_of_sources(spark):
    random.seed(3)
    rows = [(i, " ".join("w" * random.randint(1, 9) for _ in range(int(random.paretovariate(1.2)))), random.choice(["a", "b", "é", "Z", None, *["hot"] * 4])) for i in range(6000)]
    got = mixing.mix_by_source(table(spark, rows)).collect()
    off = checked(rows, got)
    assert max(off.values()) <= 1  # short documents fill what is left
    again = mixing.mix_by_source(table(spark, random.sample(rows, len(rows))).repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_of_odd_rows(spark, monkeypatch):
    """Nulls, empty, very long and repeated texts; a third of all rows is the same row."""
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 64)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\r\n\x0b\x0c", None), (4, "x " * 100_000, "b"), (5, "one two   three", None), (7, "p q", "empty"), (8, None, "zero")]
    rows += [(9, "some same words", "a")] * 1000 + [(100 + i, "t " * (i % 17 + 1), "a") for i in range(1000)]
    got = mixing.mix_by_source(table(spark, rows)).collect()
    checked(rows, got)
    odd = [(None, "w w", "a")] * 5 + [(6, "v", None)]
    assert len(mixing.mix_by_source(table(spark, odd)).collect()) == 6
    assert mixing.mix_by_source(table(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix_by_source(table(spark, rows[:3])).collect()] == [0, 0, 0]


def test_mix_of_overlapping_sources(spark):
    random.seed(4)
    sets = [["a"], ["b"], ["a", "b"], ["b", "c"], ["c"], [], None, [None, "c"], ["a", "a"]]
    rows = [(i, "w " * random.randint(1, 12), random.choice(sets)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got, sources = mixing.mix(docs, F.col("sources"))
    got, sources = got.collect(), {r["source"]: r for r in sources.collect()}
    sizes, taken = Counter(), Counter()
    for i, t, own in rows:
        for s in set(own or []):
            sizes[s] += words(t)
    assert list(sources) == ["a", "b", "c", None] and {s: r["source_size"] for s, r in sources.items()} == sizes
    own = {i: set(s or []) for i, _, s in rows}
    for r in got:
        used = sum(u["copies"] for u in r["uses"])
        assert used == r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] and {u["source"] for u in r["uses"]} <= own[r["doc_id"]]
        for u in r["uses"]:
            taken[u["source"]] += u["copies"] * r["size"]
    total = Fraction(3 * sum(words(t) for _, t, s in rows if s), 2)
    wanted = dict(zip(sources, mixing.targets([sizes[s] for s in sources], [3, 1, 2, 3], total, 2), strict=True))
    assert all(abs(taken[s] - wanted[s]) <= 40 for s in sources)  # a document of up to 12 words at each of a source's places
    alone = [r["copies"] for r in got if own[r["doc_id"]] == {"c"}]
    assert max(alone) - min(alone) <= 1


def test_mix_names_its_bound(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        mixing.mix_by_source(table(spark, [(i, "x", str(i)) for i in range(3)]))
