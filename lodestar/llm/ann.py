"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

Vectors are projected on a few Gaussian (2-stable) directions. A kd-tree over the projected points, split on a
bounded sample, cuts space into cells that cover every row; within a cell a tree of its own goes on. A query
first searches the cell nearest to it. The distance of its ``k``-th neighbour there goes with it to the other
cells, nearest leaves first. The squared projected distance over the squared true distance follows a chi-square
law, so neither a cell nor a leaf is searched once its distance makes it likely enough that no nearer vector is
left in it. Inner products become distances by one more coordinate that gives all vectors the largest norm.

A task holds one block of a cell (``BLOCK_ROWS`` rows) and one block of queries (``QUERY_ROWS``). A cell with more
rows, such as one of many equal vectors, is dealt over several blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, materialize

DIMENSIONS, LEAF, CONFIDENCE, SEED = 8, 512, 0.93, 7
BLOCK_ROWS, QUERY_ROWS = 16_384, 32_768
SAMPLE_ROWS, MOST_CELLS = 65_536, 16_384


def chi_square_quantile(p: float, m: int) -> float:
    """Of ``m`` (even) degrees of freedom, by bisection of the closed form."""
    lo, hi = 0.0, 1000.0
    while hi - lo > 1e-9:
        x = (lo + hi) / 4
        below = 1 - math.exp(-x) * sum(x**k / math.factorial(k) for k in range(m // 2))
        lo, hi = (2 * x, hi) if below < p else (lo, 2 * x)
    return lo


class Tree:
    """A kd-tree over projected points: leaves as runs of ``order``, with the boxes of their points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order, bounds = np.arange(len(points)), [0]

        def split(lo: int, hi: int) -> None:
            if hi - lo <= leaf:
                bounds.append(hi)
                return
            own = points[self.order[lo:hi]]
            axis, mid = int(np.argmax(own.max(0) - own.min(0))), (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argsort(own[:, axis], kind="stable")]
            split(lo, lo + mid)
            split(lo + mid, hi)

        split(0, len(points))
        self.bounds = np.array(bounds)
        runs = [points[self.order[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
        self.low, self.high = np.array([r.min(0) for r in runs]), np.array([r.max(0) for r in runs])


def box_distances(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distance from each point to each box."""
    out = np.zeros((len(points), len(low)))
    for axis in range(low.shape[1]):
        own = points[:, axis, None]
        out += (np.maximum(low[None, :, axis] - own, 0) + np.maximum(own - high[None, :, axis], 0)) ** 2
    return out


def cell_splits(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Inner nodes (axis, value, lower, upper) of a tree with ``cells`` leaves; a negative child ``-1 - c`` is cell c."""
    nodes: list[tuple[int, float, int, int]] = []

    def split(own: np.ndarray, n: int, first: int) -> int:
        if n == 1:
            return -1 - first
        at, half = len(nodes), n // 2
        nodes.append((0, 0.0, 0, 0))
        axis = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
        value = float(np.quantile(own[:, axis], half / n)) if len(own) else 0.0
        below = own[:, axis] <= value if len(own) else np.zeros(0, bool)
        nodes[at] = (axis, value, split(own[below], half, first), split(own[~below], n - half, first + half))
        return at

    split(points, cells, 0)
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64) - (not nodes)
    while (inner := at >= 0).any():
        axis, value, lower, upper = (np.array(x) for x in zip(*nodes, strict=True))
        own = at[inner]
        at[inner] = np.where(points[inner, axis[own]] <= value[own], lower[own], upper[own])
    return -1 - at


@dataclass
class Space:
    """How vectors and queries are projected. Sent to tasks with the cells: at most MOST_CELLS of them."""

    width: int
    top_norm: float

    def directions(self) -> np.ndarray:
        return np.random.default_rng(SEED).standard_normal((self.width + 1, DIMENSIONS))

    def points(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.top_norm**2 - np.einsum("ij,ij->i", vectors, vectors)))
        d = self.directions()
        return vectors @ d[:-1] + rest[:, None] * d[-1]

    def scales(self, queries: np.ndarray) -> np.ndarray:
        return self.top_norm / np.sqrt(np.einsum("ij,ij->i", queries, queries))

    def query_points(self, queries: np.ndarray) -> np.ndarray:
        return (queries * self.scales(queries)[:, None]) @ self.directions()[:-1]

    def reach(self, queries: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The squared distance that belongs to an inner product; infinite where there is none yet."""
        return np.where(np.isfinite(scores), np.maximum(0.0, 2 * self.top_norm**2 - 2 * self.scales(queries) * np.where(np.isfinite(scores), scores, 0)), np.inf)


def search_block(ids, vectors, query_ids, queries, least, k: int, space: Space, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, inner product): each query's up to ``k`` nearest of these vectors that score ``least`` or more.

    A query's leaves are met in order of their distance, twice as many at each step; after a step the stopping test
    is made anew. The matrix products only sort out: what is left is scored again pair by pair, so that equal
    vectors have equal scores.
    """
    tree, enough = Tree(space.points(vectors)), chi_square_quantile(confidence, DIMENSIONS)
    ids, vectors = ids[tree.order], vectors[tree.order]
    slack = 1e-9 * space.top_norm
    out = []
    for lo in range(0, len(queries), 1024):
        own_ids, own, cut = query_ids[lo : lo + 1024], queries[lo : lo + 1024], least[lo : lo + 1024].copy()
        away = box_distances(tree.low, tree.high, space.query_points(own))
        place = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1, kind="stable")
        norms = np.sqrt(np.einsum("ij,ij->i", own, own))
        who, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        begin, end = 0, 1
        while begin < away.shape[1]:
            wanted = (place >= begin) & (place < end) & (away <= enough * space.reach(own, cut)[:, None])
            found = [(who, at, score)]
            for leaf in np.flatnonzero(wanted.any(0)):
                a, b = tree.bounds[leaf], tree.bounds[leaf + 1]
                asking = np.flatnonzero(wanted[:, leaf])
                s = own[asking] @ vectors[a:b].T
                s[own_ids[asking][:, None] == ids[None, a:b]] = -np.inf
                floor = cut[asking]
                if b - a > k:
                    floor = np.maximum(floor, np.partition(s, b - a - k, axis=1)[:, b - a - k])
                i, j = np.nonzero((s >= (floor - slack * norms[asking])[:, None]) & np.isfinite(s))
                found.append((asking[i], a + j, np.einsum("ij,ij->i", own[asking[i]], vectors[a + j])))
            who, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ids[at], -score, who))
            who, at, score = who[order], at[order], score[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            keep = (rank < k) & (score >= cut[who])
            full = rank == k - 1
            cut[who[full]] = np.maximum(cut[who[full]], score[full])
            who, at, score = who[keep], at[keep], score[keep]
            begin, end = end, 2 * end
        out.append((own_ids[who], ids[at], score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _search_blocks(base: DataFrame, asked: DataFrame, query_rows: int, k: int, space: Space, confidence: float, scratch: Scratch) -> DataFrame:
    """base (block, id, v), asked (block, id, v, least): each block against the queries sent to it. A block that was sent more than
    ``query_rows`` is copied as often as they fill; one that was sent none isn't copied at all."""
    asked = scratch(asked, "ann-asked")
    chunks = scratch(asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("chunks")), "ann-chunks")  # a row per block

    def run(_, base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if len(base) and len(asked):
            by_id = np.argsort(base["id"].to_numpy(), kind="stable")
            ids, vectors = base["id"].to_numpy()[by_id], np.stack(base["v"].to_numpy())[by_id].astype(np.float64)
            queries = np.stack(asked["v"].to_numpy()).astype(np.float64)
            found = search_block(ids, vectors, asked["id"].to_numpy(), queries, asked["least"].to_numpy(), k, space, confidence)
        else:
            found = [], [], []
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    copies = base.join(F.broadcast(chunks), "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    dealt = asked.join(F.broadcast(chunks), "block").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).drop("chunks")
    return copies.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk")).applyInPandas(run, "query_id long, vec_id long, score double")


def search(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20,
    confidence: float = CONFIDENCE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the nearest rows by inner product, ties to the smaller id.

    Queries are the rows of ``queries``, else those whose id is divisible by ``every``; candidates are the rows
    with another id. Ids are integers. Rows without an id, and vectors that are null, zero, hold null or
    non-finite components or aren't of the commonest length (the larger of equally common ones), take no part. Of
    rows that repeat with an equal id and vector each is a candidate; a query id that stands on different vectors
    asks with the largest of them. An empty table gives an empty result. ``confidence`` is the least chance to
    find a neighbour; the cells are split on about SAMPLE_ROWS rows of the whole table, and every row belongs to one.
    Above MOST_CELLS cells of ``block_rows`` rows a cell is dealt over several blocks, all of which are searched.
    """
    spark, v, scratch = vectors.sparkSession, F.col("v"), Scratch()
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return rows.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))

    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    base = usable(vectors)
    lengths = base.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.max(norm).alias("norm")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n = lengths[0]["n"], lengths[0]["c"]
    space = Space(width, lengths[0]["norm"] * (1 + 1e-9))
    base = base.filter(F.size("v") == width)
    asked = base.filter(F.col("id") % every == 0) if queries is None else usable(queries).filter(F.size("v") == width)
    asked = asked.groupBy("id").agg(F.max("v").alias("v"))

    cells = min(MOST_CELLS, -(-n // block_rows))
    nodes: list = []
    if cells > 1:
        sample = base.filter(F.rand(SEED) < SAMPLE_ROWS / n).select("v").collect()  # from all rows alike
        nodes = cell_splits(space.points(np.array([r["v"] for r in sample], dtype=float)), cells) if sample else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = space.points(_matrix(batch.column(1), width))
            columns = [batch.column(0), batch.column(1), pa.array(cell_of(points, nodes).astype(np.int32)), *map(pa.array, points.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "cell", *axes])

    axes = [f"p{i}" for i in range(DIMENSIONS)]
    placed = base.mapInArrow(place, f"id long, v array<{kind}>, cell int, " + ", ".join(f"{a} double" for a in axes))
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(a) for a in axes]).alias("low"), F.array(*[F.max(a) for a in axes]).alias("high"))
    boxes = sorted(boxes.collect())  # at most MOST_CELLS
    number, low, high = np.array([b["cell"] for b in boxes]), np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])
    blocks = np.array([-(-b["n"] // block_rows) for b in boxes])
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])

    def number_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(number, cell_of(space.points(_matrix(batch.column(1), width)), nodes))
            salt = batch.column(2).to_numpy(zero_copy_only=False) % blocks[at]
            yield pa.RecordBatch.from_arrays([pa.array(first[at] + salt), batch.column(0), batch.column(1)], names=["block", "id", "v"])

    base = base.select("id", "v", F.abs(F.xxhash64("id", "v") % (1 << 40)).alias("salt")).mapInArrow(number_blocks, f"block long, id long, v array<{kind}>")
    base = scratch(base, "ann-base")
    asked = scratch(asked, "ann-queries")
    enough = chi_square_quantile(confidence, DIMENSIONS)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = box_distances(low, high, space.query_points(_matrix(batch.column(1), width))).argmin(1)
            block = first[near] + batch.column(0).to_numpy() % blocks[near]
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(0), batch.column(1), pa.array(np.full(len(block), -np.inf))], names=["block", "id", "v", "least"])

    schema = f"block long, id long, v array<{kind}>, least double"
    at_home = scratch(_search_blocks(base, asked.mapInArrow(home, schema), query_rows, k, space, confidence, scratch), "ann-home")
    found = at_home
    if int(blocks.sum()) > 1:
        bounds = at_home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        bounds = bounds.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("least"))

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, len(whole), 256):
                    batch = whole.slice(lo, 256)
                    q = _matrix(batch.column(1), width)
                    least = batch.column(2).to_numpy(zero_copy_only=False)
                    away = box_distances(low, high, space.query_points(q))
                    near = away.argmin(1)
                    done = first[near] + batch.column(0).to_numpy() % blocks[near]
                    query, cell = np.nonzero(away <= enough * space.reach(q, np.where(np.isnan(least), -np.inf, least))[:, None])
                    many = blocks[cell]
                    query = np.repeat(query, many)
                    block = np.repeat(first[cell], many) + np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)
                    left = block != done[query]
                    query, block = pa.array(query[left]), pa.array(block[left])
                    floor = pa.array(np.where(np.isnan(least), -np.inf, least)).take(query)
                    yield pa.RecordBatch.from_arrays([block, batch.column(0).take(query), batch.column(1).take(query), floor], names=["block", "id", "v", "least"])

        sent = asked.join(bounds, "id", "left").select("id", "v", "least").mapInArrow(others, schema)
        found = at_home.unionByName(_search_blocks(base, sent, query_rows, k, space, confidence, scratch))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = materialize(found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")
    scratch.clear()
    return out
