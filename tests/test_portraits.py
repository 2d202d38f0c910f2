import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import portraits as P
from lodestar.operators import search as S


def blobs(n, k, width, spread, seed):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.standard_normal((k, width)) * 5, n // k, axis=0) + spread * rng.standard_normal((n // k * k, width))


@pytest.mark.parametrize(("n", "k", "spread"), [(60, 3, 0.1), (400, 8, 1.0), (500, 20, 4.0), (24, 12, 1.0)])
def test_bounds_keep_the_brute_force_assignment(n, k, spread):
    x = blobs(n, k, 6, spread, 1)
    run = P._Assignment(x, P._seeds(x, k, np.random.default_rng(2)))
    steps = 0
    while steps < 60 and run.moved() > 1e-18:
        steps += 1
        away = ((x[:, None] - run.centres[None]) ** 2).sum(2)
        assert np.allclose(away[np.arange(len(x)), run.labels], away.min(1))
    if steps > 6:
        assert run.seen < 0.9 * len(x) * (steps + 2)  # rows left unseen


def test_clusters_are_found_and_filled():
    x = blobs(300, 6, 5, 0.05, 3)
    labels, centres, inertia = P._cluster(x, 6)
    assert all(len(set(labels[i * 50 : i * 50 + 50])) == 1 for i in range(6)) and len(set(labels)) == 6
    assert np.allclose(inertia, ((x - centres[labels]) ** 2).sum())
    same = np.vstack([np.zeros((30, 2)), np.ones((1, 2))])
    labels, _, inertia = P._cluster(same, 3)
    assert set(labels) == {0, 1, 2} and inertia < 1e-9


def test_silhouette_like_brute_force():
    x = blobs(330, 5, 3, 2.0, 4)
    labels = np.r_[np.arange(329) % 4, 7]
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    scores = []
    for i, c in enumerate(labels):
        own = [j for j in range(len(x)) if labels[j] == c and j != i]
        a = away[i, own].mean() if own else 0
        b = min(away[i, labels == d].mean() for d in set(labels) - {c})
        scores.append((b - a) / max(a, b) if own else 0.0)
    assert abs(P.silhouette(x, labels, 64) - np.mean(scores)) < 1e-9
    assert P.silhouette(x, np.zeros(330, int)) == 0.0


def test_routing_by_built_portraits(spark):
    """Each question goes to the knowledge bases whose portraits are near, worked out again by hand."""
    rng = np.random.default_rng(5)
    middle = rng.standard_normal((4, 8)) * 3
    rows = [(i, i % 4, (middle[i % 4] + rng.standard_normal(8)).tolist(), "doc") for i in range(240)]
    points = spark.createDataFrame(rows, "id long, kb_id int, vec array<double>, modality string")
    built = P.portraits(points).select("kb_id", "cluster", "vec")
    asked = {100 + q: (middle[q] + rng.standard_normal(8)).tolist() for q in range(4)}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query_vec array<double>")
    held = [(r["kb_id"], np.array(r["vec"])) for r in built.collect()]
    got = {(r["query_id"], r["kb_id"]): r["raw"] for r in S.route_scores(S.nearest_portraits(queries, built)).collect()}
    for q, v in asked.items():
        v = np.array(v)
        near = sorted(((float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)), kb) for kb, c in held), reverse=True)[:30]
        for kb in {kb for _, kb in near}:
            sims = [s for s, k in near if k == kb][:5]
            w = [0.9**i for i in range(len(sims))]
            assert abs(got[q, kb] - sum(a * b for a, b in zip(sims, w, strict=True)) / sum(w)) < 1e-9
        assert max((s, k) for (i, k), s in got.items() if i == q)[1] == q - 100


def test_members_share_all_points(spark):
    """Above the sample's bound every point belongs to its nearest portrait, in one part or in several; below it to its own as well."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 3 // 2, rng.standard_normal(4).tolist(), "doc") for i in range(9000)]  # 6000 and 3000
    points = spark.createDataFrame(rows, "id long, kb_id int, vec array<double>, modality string")
    built = spark.createDataFrame(P.portraits(points).collect(), P.portraits(points).schema)
    assert sum(r["cluster_size"] for r in built.filter("kb_id = 0").collect()) == 1000
    centres = {k: np.array([r["vec"] for r in built.filter(f"kb_id = {k}").orderBy("cluster").collect()]) for k in (0, 1)}
    wanted = {i: (k, int(((centres[k] - np.array(v)) ** 2).sum(1).argmin())) for i, k, v, _ in rows}
    for part_rows in (700, 50_000):
        got = P.members(points, built, part_rows).collect()
        assert len(got) == 9000 and {r["id"]: (r["kb_id"], r["cluster"]) for r in got} == wanted
