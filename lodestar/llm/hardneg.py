"""Hard negatives by dual-tree search: exact for every anchor, with inner-product intervals of node pairs.

Candidates are dealt into blocks by the cells of a kd-tree that is split on a bounded sample, anchors into groups by
the same cells. Blocks and groups have a box, a centre and a radius, and so has each node of the trees that a task
grows over its block and over the anchors sent to it. From these follows an interval that holds every inner product
of a pair of nodes. A pair is left out, with all its anchors and candidates, if the interval is below what each of
the anchors still needs or above what any of them may take, or if the labels can't fit; leaf pairs are scored
exactly, in whole numbers.

An anchor asks twice: for its positives, then for negatives in the window of each positive. Each time it first asks
one block near it, and takes what it found there as a bound to the others. A block is copied only as often as the
anchors sent to it fill tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.ann import cell_of, cell_splits
from lodestar.llm.common import Scratch, materialize

BLOCK_ROWS, ANCHOR_ROWS, GROUP_ROWS = 16_384, 16_384, 2_048
MOST_CELLS, MOST_BLOCKS, SAMPLE_ROWS = 4_096, 65_536, 65_536
LEAF, ANCHOR_LEAF = 256, 64
NONE = 1 << 62  # beyond every score


class Bounds:
    """Box, centre and radius of sets of vectors, one a row."""

    def __init__(self, low: np.ndarray, high: np.ndarray, centre: np.ndarray, radius: np.ndarray):
        self.low, self.high, self.centre, self.radius = low, high, centre, radius
        self.norm = np.sqrt((centre**2).sum(1))

    @staticmethod
    def of(sets: list[np.ndarray]) -> Bounds:
        centres = np.array([s.mean(0) for s in sets])
        radius = np.array([np.sqrt(((s - c) ** 2).sum(1).max()) for s, c in zip(sets, centres, strict=True)])
        return Bounds(np.array([s.min(0) for s in sets], float), np.array([s.max(0) for s in sets], float), centres, radius)

    def interval(self, i: int, other: Bounds, j) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of row ``i`` with rows ``j`` of ``other``."""
        a, b = self.low[i], self.high[i]
        products = np.stack([a * other.low[j], a * other.high[j], b * other.low[j], b * other.high[j]])
        mid = other.centre[j] @ self.centre[i]
        spread = self.norm[i] * other.radius[j] + other.norm[j] * self.radius[i] + self.radius[i] * other.radius[j]
        slack = 1 + 1e-9 * (self.norm[i] + self.radius[i]) * (other.norm[j] + other.radius[j])
        return np.maximum(products.min(0).sum(-1), mid - spread) - slack, np.minimum(products.max(0).sum(-1), mid + spread) + slack


class Tree:
    """A binary tree over rows: split by label while there are several, else at the median of the widest axis.

    Nodes are runs of ``order``; a leaf has no children (-1) and its rows stand in the order of their ids.
    """

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, leaf: int):
        self.order, runs, children = np.arange(len(vectors)), [], []

        def grow(lo: int, hi: int) -> int:
            at, own = len(runs), self.order[lo:hi]
            runs.append((lo, hi))
            children.append((-1, -1))
            if hi - lo <= leaf:
                self.order[lo:hi] = own[np.argsort(ids[own], kind="stable")]
                return at
            if (labels[own] != labels[own[0]]).any():
                key = labels[own]
            else:
                v = vectors[own]
                key = v[:, int(np.argmax(v.max(0) - v.min(0)))]
            self.order[lo:hi] = own[np.argsort(key, kind="stable")]
            mid = (lo + hi) // 2
            children[at] = grow(lo, mid), grow(mid, hi)
            return at

        grow(0, len(vectors))
        self.runs, self.children = runs, children
        self.bounds = Bounds.of([vectors[self.order[a:b]] for a, b in runs])
        own = [labels[self.order[a:b]] for a, b in runs]
        self.labels = [(x.min(), x.max()) for x in own]


def search_pair(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's place, window, row id, score): of each window of each anchor its first ``k`` rows, best first.

    anchors: id, label, v, and the windows' least and most scores as a column a window (least above most: none).
    """
    kind = anchors["v"].dtype
    grove, tree = Tree(anchors["v"], anchors["label"], anchors["id"], ANCHOR_LEAF), Tree(rows["v"], rows["label"], rows["id"], LEAF)
    a_order, r_order = grove.order, tree.order
    av, al, ai = (anchors[c][a_order] for c in ("v", "label", "id"))
    rv, rl, ri = (rows[c][r_order] for c in ("v", "label", "id"))
    need, most = anchors["least"][a_order].astype(kind), anchors["most"][a_order].astype(kind)
    need[need > most] = NONE  # asks for nothing
    windows = need.shape[1]
    top = np.full((len(av), windows, k), -NONE, kind)
    top_id = np.full((len(av), windows, k), np.iinfo(np.int64).max)

    def score(a: tuple[int, int], r: tuple[int, int]) -> None:
        own, ids = slice(*a), ri[slice(*r)]
        s = av[own] @ rv[slice(*r)].T
        fits = ((al[own, None] == rl[None, slice(*r)]) == same) & (ai[own, None] != ids[None])
        for w in range(windows):
            hit = fits & (s >= need[own, w, None]) & (s <= most[own, w, None])
            n = hit.sum(1)
            asking = np.flatnonzero(n)
            if not len(asking):
                continue
            held = np.where(hit[asking], s[asking], -NONE).astype(kind)
            best = np.argsort(-held, axis=1, kind="stable")[:, :k]
            new, new_id = np.take_along_axis(held, best, 1), ids[best]
            at = a[0] + asking
            both, both_id = np.concatenate([top[at, w], new], 1), np.concatenate([top_id[at, w], new_id], 1)
            order = np.lexsort((both_id, -both), axis=-1)[:, :k]
            top[at, w], top_id[at, w] = np.take_along_axis(both, order, 1), np.take_along_axis(both_id, order, 1)
            need[at, w] = np.maximum(need[at, w], top[at, w, k - 1])

    def fitting(a: int, r: int) -> bool:
        (a_least, a_most), (r_least, r_most) = grove.labels[a], tree.labels[r]
        return (a_least <= r_most and r_least <= a_most) if same else not (a_least == a_most == r_least == r_most)

    stack = [(0, 0)]
    while stack:
        a, r = stack.pop()
        own = slice(*grove.runs[a])
        lo, hi = grove.bounds.interval(a, tree.bounds, r)
        if not fitting(a, r) or hi < need[own].min() or lo > most[own].max():
            continue
        a_parts, r_parts = grove.children[a], tree.children[r]
        if a_parts[0] < 0 and r_parts[0] < 0:
            score(grove.runs[a], tree.runs[r])
        elif r_parts[0] < 0 or (a_parts[0] >= 0 and (own.stop - own.start) * LEAF > (tree.runs[r][1] - tree.runs[r][0]) * ANCHOR_LEAF):
            stack += [(x, r) for x in a_parts]
        else:
            his = grove.bounds.interval(a, tree.bounds, list(r_parts))[1]
            stack += [(a, x) for _, x in sorted(zip(his, r_parts, strict=True))]  # the better one is popped first
    at, w, i = np.nonzero(top > -NONE)
    return a_order[at], w, top_id[at, w, i], top[at, w, i].astype(np.int64)


def _matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _dealt(df: DataFrame, rows: int, most: int, name: str) -> DataFrame:
    """``df`` with a number in cells of at most ``rows`` rows (more, if ``most`` numbers wouldn't do); its rows are counted by cell."""
    counts = sorted((r["cell"], r["n"]) for r in df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())  # at most MOST_CELLS
    rows = max(rows, -(-sum(n for _, n in counts) // most))
    table, first = [], 0
    for cell, n in counts:
        table.append((cell, first, -(-n // rows)))
        first += -(-n // rows)
    table = df.sparkSession.createDataFrame(table, "cell int, _first long, _many long")
    return df.join(F.broadcast(table), "cell").withColumn(name, F.col("_first") + F.pmod(F.xxhash64("row"), "_many")).drop("_first", "_many")


def _summaries(df: DataFrame, by: str, width: int) -> DataFrame:
    """A row per number: rows, box, centre, radius, least and greatest label; of groups also what their windows span."""
    spans = "least" in df.columns

    def make(batch: pa.Table) -> pa.Table:
        b = Bounds.of([_matrix(batch["v"], width)])
        label = batch["label"].to_numpy()
        row = {by: batch[by][0].as_py(), "n": len(batch), "low": b.low[0].tolist(), "high": b.high[0].tolist(), "centre": b.centre[0].tolist(), "radius": float(b.radius[0]), "labels": [int(label.min()), int(label.max())]}
        row |= {"need": min(map(min, batch["least"].to_pylist())), "may": max(map(max, batch["most"].to_pylist()))} if spans else {}
        return pa.Table.from_pylist([row], schema=arrow)

    arrow = pa.schema([(by, pa.int64()), ("n", pa.int64()), *[(c, pa.list_(pa.float64())) for c in ("low", "high", "centre")], ("radius", pa.float64()), ("labels", pa.list_(pa.int64())), *([("need", pa.int64()), ("may", pa.int64())] if spans else [])])
    schema = f"{by} long, n long, low array<double>, high array<double>, centre array<double>, radius double, labels array<long>" + ", need long, may long" * spans
    return df.groupBy(by).applyInArrow(make, schema)


class Index:
    """Candidates in blocks, with the blocks' summaries: at most MOST_BLOCKS, held by the driver and sent to tasks."""

    def __init__(self, rows: DataFrame, width: int, kind: type, block_rows: int, scratch: Scratch):
        self.rows = scratch(_dealt(rows, block_rows, MOST_BLOCKS, "block").select("block", "id", "label", "v"), "negatives-blocks")
        self.width, self.kind, self.scratch = width, kind, scratch
        found = sorted(_summaries(self.rows, "block", width).collect(), key=lambda r: r["block"])
        self.numbers = np.array([r["block"] for r in found])
        self.labels = np.array([r["labels"] for r in found])
        self.bounds = Bounds(*(np.array([r[c] for r in found]) for c in ("low", "high", "centre", "radius")))

    def routes(self, asked: DataFrame, same: bool, home: bool) -> DataFrame:
        """group, block: of each group the block nearest to it, or all that its anchors may need."""
        numbers, labels, bounds = self.numbers, self.labels, self.bounds

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g in batch.to_pylist():
                    own = Bounds(*(np.array([g[c]]) for c in ("low", "high", "centre", "radius")))
                    lo, hi = own.interval(0, bounds, slice(None))
                    least, most = g["labels"]
                    fits = (least <= labels[:, 1]) & (labels[:, 0] <= most) if same else ~((labels == least).all(1) & (labels == most).all(1))
                    if home:
                        blocks = numbers[[int(np.argmax(np.where(fits, bounds.centre @ own.centre[0], -np.inf)))]]
                    else:
                        blocks = numbers[fits & (hi >= g["need"]) & (lo <= g["may"])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), g["group"])), pa.array(blocks)], names=["group", "block"])

        return _summaries(asked, "group", self.width).mapInArrow(route, "group long, block long")

    def search(self, asked: DataFrame, same: bool, k: int, anchor_rows: int) -> DataFrame:
        """id, window, vec_id, score: the first ``k`` of each window, of ``asked`` (group, id, label, v, least, most)."""
        home = self.scratch(self.routes(asked, same, True), "negatives-home")
        found = self._asked(asked, home, same, k, anchor_rows)
        if len(self.numbers) > 1:
            full = found.groupBy("id", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).filter(F.col("n") >= k)
            bounds = full.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("window", "worst"))).alias("bounds"))
            raised = F.transform("least", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("bounds", i.cast("long")), x)))
            left = asked.join(bounds, "id", "left").withColumn("least", F.when(F.col("bounds").isNull(), F.col("least")).otherwise(raised)).drop("bounds")
            left = self.scratch(left, "negatives-asked")
            others = self.scratch(self.routes(left, same, False).join(home, ["group", "block"], "left_anti"), "negatives-routes")
            found = found.unionByName(self._asked(left, others, same, k, anchor_rows))
        best = Window.partitionBy("id", "window").orderBy(F.desc("score"), "vec_id")
        return self.scratch(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "negatives-found")

    def _asked(self, asked: DataFrame, routes: DataFrame, same: bool, k: int, anchor_rows: int) -> DataFrame:
        width, kind = self.width, self.kind
        sent = asked.join(routes, "group")
        parts = sent.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / anchor_rows).alias("parts"))  # a row per block
        parts = self.scratch(parts, "negatives-parts")
        base = self.rows.join(F.broadcast(parts), "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        sent = sent.join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts", "group")

        def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
            out = [np.empty(0, np.int64)] * 4
            if len(anchors) and len(rows):
                own = {"id": anchors["id"].to_numpy(), "label": anchors["label"].to_numpy(), "v": _matrix(anchors["v"], width, kind)}
                own |= {c: np.array(anchors[c].to_pylist(), dtype=np.int64) for c in ("least", "most")}
                at, *rest = search_pair(own, {"id": rows["id"].to_numpy(), "label": rows["label"].to_numpy(), "v": _matrix(rows["v"], width, kind)}, same, k)
                out = [own["id"][at], *rest]
            return pa.table(dict(zip(("id", "window", "vec_id", "score"), map(pa.array, out), strict=True)))

        pairs = sent.groupBy("block", "part").cogroup(base.groupBy("block", "part"))
        return self.scratch(pairs.applyInArrow(run, "id long, window long, vec_id long, score long"), "negatives-pairs")


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5,
    negatives: int = 3, low: int = 50, high: int = 95, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    A score is the inner product of components times ``scale``, rounded down. An anchor's positives are its first rows of
    its label; negatives are rows of other labels whose score is ``low`` to ``high`` percent of the positive's.
    Ties go to the smaller id. ``anchors`` is a condition on the columns of ``vectors``.

    Ids and labels are integers. Rows without id or label, and vectors that are null, hold null or non-finite
    components, aren't of the commonest length (the larger of equally common ones) or whose scaled length squared is
    2**62 or more (their scores needn't fit a long) take no part, nor do empty ones; zero vectors do. Rows that repeat an id
    are candidates one by one, but never of an anchor with that id, which asks with the largest of their vectors. An
    empty table gives an empty result; other columns aren't read.
    """
    spark, scratch, v = vectors.sparkSession, Scratch(), F.col("v")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    rows = rows.withColumn("v", F.transform(v, lambda x: F.rint(x * scale) - (F.rint(x * scale) > x * scale).cast("int")))  # floor, as a double
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.withColumn("square", square).filter(F.col("square") < float(NONE))
    rows = scratch(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.max("square").alias("square")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    width, n = lengths[0]["n"], lengths[0]["c"]
    kind = np.float64 if lengths[0]["square"] < 2**52 else np.int64  # doubles are exact below
    rows = rows.filter(F.size("v") == width)

    cells, nodes = min(MOST_CELLS, -(-n // block_rows)), []
    if cells > 1:
        sample = rows.filter(F.rand(7) < SAMPLE_ROWS / n).select("v").collect()
        nodes = cell_splits(np.array([r["v"] for r in sample]).reshape(-1, width), cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = pa.array(cell_of(_matrix(batch.column("v"), width), nodes).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[*batch.schema.names, "cell"])

    placed = rows.select("id", "label", "v", "asks", "row").mapInArrow(place, "id long, label long, v array<double>, asks boolean, row long, cell int")
    placed = scratch(placed, "negatives-placed")
    index = Index(placed, width, kind, block_rows, scratch)
    asked = placed.filter("asks").groupBy("id").agg(F.max(F.struct("v", "label", "cell", F.col("id").alias("row"))).alias("x")).select("id", "x.*")
    asked = _dealt(scratch(asked, "negatives-anchors"), group_rows, MOST_BLOCKS, "group").drop("cell", "row")
    every = F.array(F.lit(NONE))
    asked = asked.withColumns({"least": F.transform(every, lambda x: -x + 1), "most": F.transform(every, lambda x: x - 1)})
    asked = scratch(asked, "negatives-asked")
    found = index.search(asked, True, positives, anchor_rows).select("id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = [[*map(int, s)] + [None] * (positives - len(s)) for s in batch["scores"]]
            batch["least"] = [[NONE if s is None else -(-s * low // 100) for s in row] for row in scores]
            batch["most"] = [[-NONE if s is None else s * high // 100 for s in row] for row in scores]
            yield batch[["id", "least", "most"]]

    scores = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    scores = scores.mapInPandas(windows, "id long, least array<long>, most array<long>")
    again = scratch(asked.drop("least", "most").join(scores, "id"), "negatives-again")
    hard = index.search(again, False, negatives, anchor_rows)
    out = found.join(hard.withColumn("place", F.col("window") + 1), ["id", "place"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
    out = materialize(out, "hard-negatives")
    scratch.clear()
    return out


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY rank <= 3
"""
