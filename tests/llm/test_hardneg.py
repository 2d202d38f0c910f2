import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, id string, row int, v int, score string"


def table(spark, rows):
    """Rows (vec_id, vector, label) with extra columns whose names clash."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def mined(spark, rows, every=5, **more):
    return sorted(tuple(r) for r in hardneg.mine(table(spark, rows), F.col("vec_id") % every == 0, **more).collect())


def brute(rows, every=5):
    own = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and v and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, c in own:
        if i % every == 0:
            anchors[i] = max(anchors.get(i, (v, c)), (v, c))
    out = []
    for a, (av, ac) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(av, v, strict=True)), i, c) for i, v, c in own if i != a)
        for s, p, _ in [x for x in scored if x[2] == ac][:5]:
            hits = [(i, -t) for t, i, c in scored if c != ac and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, rank, i, -s, t) for rank, (i, t) in enumerate(hits[:3], 1)]
    return sorted(out)


def clustered(n, width=6, clusters=8, spread=0.2, seed=1, labels=3, size=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, width))
    return [(i, (size * (centres[i % clusters] + spread * rng.standard_normal(width))).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_negatives_like_brute_force_over_many_blocks(spark):
    rows = clustered(900)
    want = brute(rows)
    assert len(want) > 500
    assert mined(spark, rows) == want
    assert mined(spark, rows, block_rows=70, anchor_rows=16, group_rows=8) == want


def test_negatives_of_ties_and_equal_vectors(spark):
    """A third of the rows is one vector; small whole vectors tie over blocks; ids and rows repeat."""
    random.seed(2)
    rows = [(i, [0.5, 0.25, -0.25], i % 2) for i in range(0, 300)]
    rows += [(300 + i, [random.choice([0.0, 0.25, 0.5]) for _ in range(3)], i % 4) for i in range(500)]
    rows += [rows[0], rows[10], (15, [1.0, 0.0, 0.0], 1)]
    want = brute(rows)
    assert mined(spark, rows, block_rows=64, anchor_rows=32, group_rows=16) == want
    assert mined(spark, rows) == want


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 1.0], 1), (5, None, 1), (10, [1.0, None], 1), (15, [nan, 1.0], 1), (20, [inf, 1.0], 2), (25, [0.0, 0.0], 1), (30, [1.0, 1.0], None), (35, [], 1), (40, [1.0, 1.0, 1.0], 1)]
    fine = [(100 + i, [1.0, i / 50], i % 2) for i in range(40)] + [(1, [-1.0, -1.0], 1), (-5, [1.0, 0.3], 0)]
    assert mined(spark, odd + fine) == brute([r for r in odd if r[0] != 40] + fine)
    assert mined(spark, []) == [] and mined(spark, odd[:3]) == []
    alone = [(0, [1.0], 1), (1, [1.0], 2)]  # no positive
    assert mined(spark, alone) == []


def test_negatives_in_whole_numbers_beyond_doubles(spark):
    rows = clustered(300, size=2.0**19 / 3)
    assert max(abs(t[4]) for t in brute(rows)) > 2**53
    assert mined(spark, rows, block_rows=50) == brute(rows)


def test_node_pairs_are_left_out():
    """Clusters far apart: most leaf pairs aren't scored, and no interval leaves out a pair that counts."""
    rng = np.random.default_rng(3)
    sets = [np.floor(256 * (10 * rng.standard_normal(5) + rng.standard_normal((40, 5)))) for _ in range(20)]
    bounds = hardneg.Bounds.of(sets)
    for i in range(20):
        lo, hi = bounds.interval(i, bounds, slice(None))
        for j in range(20):
            s = sets[i] @ sets[j].T
            assert lo[j] <= s.min() and s.max() <= hi[j]
    assert (bounds.interval(0, bounds, slice(None))[1] < (sets[0] @ sets[0].T).max()).sum() > 5


def test_pairs_of_a_block_like_all_pairs():
    rng = np.random.default_rng(4)
    for same in (True, False):
        rows = {"id": np.arange(2000), "label": rng.integers(0, 5, 2000), "v": np.floor(256 * rng.standard_normal((2000, 8)))}
        own = {c: x[::7] for c, x in rows.items()} | {"least": np.full((286, 1), -(10**9)), "most": np.full((286, 1), 400_000)}
        found = defaultdict(list)
        for at, w, i, s in zip(*hardneg.search_pair(own, rows, same, 4), strict=True):
            assert w == 0
            found[own["id"][at]].append((-s, i))
        for a, label, v in zip(own["id"], own["label"], own["v"], strict=True):
            s = (rows["v"] @ v).astype(int)
            fits = [(-x, i) for i, x in enumerate(s) if i != a and (rows["label"][i] == label) == same and x <= 400_000]
            assert found[a] == sorted(fits)[:4]
