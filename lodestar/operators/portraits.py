"""Knowledge-base portraits: clusters of a bounded sample of each knowledge base's vectors, all of them in one job."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.search import PART_ROWS, dealt

#: Least points of a portrait, sample sizes, seed and restarts of the clustering, rules of the refresh.
LEAST, FULL, SAMPLE_LEAST, SAMPLE_MOST, SHARE, SEED, RESTARTS = 10, 5000, 50, 1000, 0.2, 42, 10
CHANGE, DAYS, THRESHOLD = 0.2, 7, 50
MOST_STEPS, TOLERANCE = 300, 1e-4
MODALITIES = ["doc", "image", "audio", "video"]


def clusters_for(n: int) -> int:
    return max(2, min(20, int(math.sqrt(n / 2))))


def quotas(points: DataFrame) -> DataFrame:
    """points (kb_id, modality) -> kb_id, modality, n, quota: all where a knowledge base is small, else a share of a bounded
    sample, of which the last modality takes what rounding leaves."""
    every = Window.partitionBy("kb_id")
    n, total = F.col("n"), F.sum("n").over(every)
    counts = points.groupBy("kb_id", "modality").agg(F.count(F.lit(1)).alias("n")).withColumn("total", total)
    size = F.least(F.lit(SAMPLE_MOST), F.greatest(F.lit(SAMPLE_LEAST), F.floor(SHARE * F.col("total"))))
    own = F.floor(size * n / F.col("total"))
    others = F.sum(F.when(F.col("modality") != MODALITIES[-1], own).otherwise(0)).over(every)
    quota = F.when(F.col("total") < FULL, n).when(F.col("modality") == MODALITIES[-1], size - others).otherwise(own)
    return counts.withColumn("quota", quota.cast("long")).select("kb_id", "modality", "n", "quota")


def sample(points: DataFrame, seed: int = SEED) -> DataFrame:
    """Of points (id, kb_id, modality, ..) each modality's quota, by a hash of the id; below ``FULL`` rows a knowledge base."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"))
    place = F.row_number().over(Window.partitionBy("kb_id", "modality").orderBy(draw, "id"))
    few = points.withColumn("place", place).filter(F.col("place") <= FULL)
    return few.join(quotas(points).select("kb_id", "modality", "quota"), ["kb_id", "modality"]).filter(F.col("place") <= F.col("quota")).drop("quota")


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each of ``c``."""
    return np.maximum(0.0, (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1))


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Rows drawn one after the other by their squared distance to those that are drawn; of a few draws the best is kept."""
    chosen = [int(rng.integers(len(x)))]
    near = _squared(x, x[chosen])[:, 0]
    for _ in range(1, k):
        total = near.sum()
        draws = rng.choice(len(x), 2 + int(math.log(k)), p=near / total) if total > 0 else rng.integers(len(x), size=1)
        left = np.minimum(near[:, None], _squared(x, x[draws]))
        best = int(left.sum(0).argmin())
        chosen.append(int(draws[best]))
        near = left[:, best]
    return x[chosen].copy()


class _Assignment:
    """Rows and their nearest centres, with a bound from above on the distance to the own one and from below to any other.

    When centres move, the bounds move with them; by the triangle inequality a row whose upper bound is below its lower
    one, or below half the way to the next centre, keeps its label unseen.
    """

    def __init__(self, x: np.ndarray, centres: np.ndarray):
        self.x, self.centres, self.seen = x, centres, 0
        self.labels = np.zeros(len(x), np.int64)
        self.upper, self.lower = np.empty(len(x)), np.empty(len(x))
        self._look(np.arange(len(x)))

    def _look(self, rows: np.ndarray) -> None:
        away = np.sqrt(_squared(self.x[rows], self.centres))
        self.seen += len(rows)
        self.labels[rows] = away.argmin(1)
        nearest = np.partition(away, 1, axis=1)[:, :2]
        self.upper[rows], self.lower[rows] = nearest[:, 0], nearest[:, 1]

    def _filled(self) -> None:
        """A cluster that is empty takes the row that is farthest from its centre and not alone there."""
        for c in np.setdiff1d(np.arange(len(self.centres)), self.labels):
            size = np.bincount(self.labels, minlength=len(self.centres))[self.labels]
            away = ((self.x - self.centres[self.labels]) ** 2).sum(1)
            far = int(np.where(size > 1, away, -1.0).argmax())
            self.labels[far], self.upper[far], self.lower[far] = c, np.inf, 0.0

    def moved(self) -> float:
        """Centres go to the means of their rows, rows to their nearest centres; how far the centres went, squared and summed."""
        self._filled()
        sums = np.zeros_like(self.centres)
        np.add.at(sums, self.labels, self.x)
        new = sums / np.bincount(self.labels, minlength=len(sums))[:, None]
        went = np.sqrt(((new - self.centres) ** 2).sum(1))
        self.centres = new
        order = np.argsort(went)
        others = np.where(self.labels == order[-1], went[order[-2]], went[order[-1]])
        self.upper += went[self.labels]
        self.lower -= others
        between = np.sqrt(_squared(new, new))
        np.fill_diagonal(between, np.inf)
        slack = 1e-7 * (1 + np.abs(self.upper))
        doubtful = self.upper >= np.maximum(self.lower, between.min(1)[self.labels] / 2) - slack
        self._look(np.flatnonzero(doubtful))
        return float((went**2).sum())


def _cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, centres, inertia) of the best of RESTARTS runs, each until its centres rest or MOST_STEPS are done."""
    rng, best, rest = np.random.default_rng(SEED), None, TOLERANCE * x.var(0).mean()
    for _ in range(RESTARTS):
        run = _Assignment(x, _seeds(x, k, rng))
        for _ in range(MOST_STEPS):
            before = run.labels.copy()
            if run.moved() <= rest or (before == run.labels).all():
                break
        run._filled()
        labels = run.labels
        centres = np.stack([x[labels == c].mean(0) for c in range(k)])
        inertia = float(((x - centres[labels]) ** 2).sum())
        if best is None or inertia < best[2]:
            best = labels.copy(), centres, inertia
    return best


def silhouette(x: np.ndarray, labels: np.ndarray, block: int = 256) -> float:
    """The mean over all points of (nearest other cluster's mean distance - own) / the larger of both, by blocks of distances."""
    kinds, own = np.unique(labels, return_inverse=True)
    if len(kinds) < 2:
        return 0.0
    sizes, member = np.bincount(own), np.eye(len(kinds))[own]
    total = 0.0
    for lo in range(0, len(x), block):
        at, mine = np.arange(len(x[lo : lo + block])), own[lo : lo + block]
        away = np.sqrt(_squared(x[lo : lo + block], x))
        away[at, lo + at] = 0.0
        sums = away @ member
        inner = sums[at, mine] / np.maximum(1, sizes[mine] - 1)
        outer = sums / sizes
        outer[at, mine] = np.inf
        outer = outer.min(1)
        total += np.where(sizes[mine] == 1, 0.0, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300)).sum()
    return float(total / len(x))


def portraits(points: DataFrame) -> DataFrame:
    """points (id, kb_id, modality, vec) -> kb_id, cluster, vec, cluster_size, nearest (ids of its central members), inertia, silhouette.

    Knowledge bases under ten points have none. A group holds less than FULL vectors, whatever the input.
    """
    kind, id_kind = (points.schema[c].dataType.simpleString() for c in ("kb_id", "id"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        columns = ["kb_id", "cluster", "vec", "cluster_size", "nearest", "inertia", "silhouette"]
        if len(frame) < LEAST:
            return pd.DataFrame(columns=columns)
        frame = frame.sort_values("id")
        x, ids = np.stack(frame["vec"].to_numpy()).astype(float), frame["id"].to_numpy()
        labels, centres, inertia = _cluster(x, clusters_for(len(x)))
        score, out = silhouette(x, labels), []
        for c, centre in enumerate(centres):
            own = np.flatnonzero(labels == c)
            near = own[np.argsort(np.linalg.norm(x[own] - centre, axis=1), kind="stable")][: min(15, max(10, len(own)))]
            out.append((frame["kb_id"].iloc[0], c, centre, len(own), ids[near], inertia, score))
        return pd.DataFrame(out, columns=columns)

    schema = f"kb_id {kind}, cluster int, vec array<double>, cluster_size long, nearest array<{id_kind}>, inertia double, silhouette double"
    return sample(points).select("kb_id", "id", "vec").groupBy("kb_id").applyInPandas(build, schema)


def members(points: DataFrame, built: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """points (id, kb_id, vec), portraits (kb_id, cluster, vec) -> id, kb_id, cluster: every point and the portrait of its knowledge base
    that it is nearest to, whether the portraits were made of it or of a sample. A large knowledge base's points are dealt over parts."""
    id_kind, kind, cluster = points.schema["id"].dataType.simpleString(), points.schema["kb_id"].dataType.simpleString(), built.schema["cluster"].dataType.simpleString()

    def nearest(own: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(centres):
            return pd.DataFrame({"id": [], "kb_id": [], "cluster": []})
        centres = centres.sort_values("cluster")
        away = _squared(np.stack(own["vec"].to_numpy()).astype(float), np.stack(centres["vec"].to_numpy()).astype(float))
        return own[["id", "kb_id"]].assign(cluster=centres["cluster"].to_numpy()[away.argmin(1)])

    keys = ["kb_id", "_part"]
    base, asking = dealt(points.select("id", "kb_id", "vec"), built.select("kb_id", "cluster", "vec"), ["kb_id"], part_rows)
    return base.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(nearest, f"id {id_kind}, kb_id {kind}, cluster {cluster}")


def replaced(stored: DataFrame, built: DataFrame, kbs: DataFrame) -> DataFrame:
    """Stored portraits after a run over ``kbs`` (kb_id): those of these knowledge bases go, and the new ones come."""
    return stored.join(kbs.select("kb_id").distinct(), "kb_id", "left_anti").unionByName(built, allowMissingColumns=True)


def needs_refresh(now: Column, last: Column, created: Column, today: Column, threshold: int = THRESHOLD) -> Column:
    """Whether a portrait is due: there is none, its count changed by a fifth, it is a week old, or the count crossed the threshold."""
    rules = [
        created.isNull(), (last > 0) & (F.abs(now - last) / F.greatest(last, F.lit(1)) >= CHANGE),
        F.datediff(today, created) >= DAYS, (now >= threshold) & (last < threshold),
    ]
    return reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in rules])
