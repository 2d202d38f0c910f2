"""Text quality by a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. Shallow trees are boosted feature by feature in turn, each adding
its leaves to the feature's lookup table; then the pairs of features that explain most of what is left get
tables over two coarser sets of bins in the same way. A text's score is the sum of the entries its bins select.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

TRAIN_ROWS = 12_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15

FEATURES = [
    "chars", "words", "word_length", "unique_words", "upper", "digits", "other", "runs", "marked_words", "stops", "commas", "repeated_lines", "line_length", "long_words", "wide_bytes", "word_entropy",
]
_UPPER, _DIGITS, _ASCII = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128))
_PLAIN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 \t\r\n" + bytes(range(128, 256))
_LONG, _RUN, _MARKED = re.compile(r"\S{30,}"), re.compile(rb"([^\s\w])\1"), re.compile(r"[^\w\s](?=\s|$)")


def features(text: str) -> tuple[float, ...]:
    data = text.encode("utf-8", "replace")
    n, words = max(1, len(data)), text.split()
    k, lines = max(1, len(words)), text.split("\n")
    share = lambda chars: (n - len(data.translate(None, chars))) / n
    unique = len(set(words))
    return (
        np.log1p(len(text)), np.log1p(len(words)), len(text) / k, unique / k, share(_UPPER), share(_DIGITS), len(data.translate(None, _PLAIN)) / n, len(_RUN.findall(data)) / k,
        len(_MARKED.findall(text)) / k, data.count(b".") / k, data.count(b",") / k,
        1 - len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), len(_LONG.findall(text)) / k, (n - len(data.translate(None, _ASCII))) / n, np.log1p(unique) / np.log1p(k),
    )


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: np.ndarray  # feature x bin
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # pair x bin x bin
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), dtype=int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = self.base + self.tables[np.arange(len(self.edges)), b].sum(1)
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z = z + t[self.coarse(b, i), self.coarse(b, j)]
        return 1 / (1 + np.exp(-z))

    def coarse(self, b: np.ndarray, f: int) -> np.ndarray:
        """A feature's bins, as many as its own edges make, in PAIR_BINS at most."""
        return b[:, f] * PAIR_BINS // max(PAIR_BINS, len(self.edges[f]) + 1)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Where to cut the bins in two, and the gain."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(np.argmax(gain)) if len(gain) else 0
    return at + 1, float(gain[at]) if len(gain) else 0.0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of a shallow tree over bins, a value per bin."""
    at, gain = _cut(g, h) if depth and len(g) > 1 else (0, 0.0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """One cut along the first axis, then one along the second on either side (or the other way round); values and gain."""
    best, value = -1.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        at, _ = _cut(a.sum(1), b.sum(1))
        out, gain = np.zeros_like(a), 0.0
        for half in (slice(0, at), slice(at, None)):
            u, v = a[half].sum(0), b[half].sum(0)
            leaf = _tree(u, v, 1)
            out[half] = leaf
            gain += float((leaf * u).sum())
        if gain > best:
            best, value = gain, out.T if turn else out
    return value, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Without a row of each label the model gives the share of label 1 (one half without any row)."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for f in range(len(FEATURES))]
    p = (y.sum() + 1) / (len(y) + 2)
    model = Model(edges, np.zeros((len(FEATURES), BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)), float(np.log(p / (1 - p))))
    if len(y) == 0 or y.min() == y.max():
        return model
    b, z = model.bins(x), np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for f in range(len(FEATURES)):
            q = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(b[:, f], y - q, BINS), np.bincount(b[:, f], q * (1 - q), BINS))
            model.tables[f] += step
            z += step[b[:, f]]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell, q = model.coarse(b, i) * PAIR_BINS + model.coarse(b, j), 1 / (1 + np.exp(-z))
        grid = lambda w: np.bincount(cell, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
        return cell, grid(y - q), grid(q * (1 - q))

    gains = [(_pair_tree(*grids(i, j)[1:])[1], i, j) for i in range(len(FEATURES)) for j in range(i)]
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            cell, g, h = grids(i, j)
            step = RATE * _pair_tree(g, h)[0]
            model.pair_tables[k] += step
            z += step.ravel()[cell]
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows of ``docs``, picked by a hash of their id; null labels and ids take no part.

    Rows that repeat, in either table, count once: those of one id, label and features. So the driver gets ``rows`` at most,
    however often ids repeat. Ids of different types, unless both are numbers, are equal if they are the same as text.
    """
    kinds = [t.schema[id_col].dataType for t in (docs, labels)]
    as_they_are = kinds[0] == kinds[1] or all(isinstance(k, NumericType) for k in kinds)
    same = F.col("_id") if as_they_are else F.col("_id").cast("string")
    picked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("double").alias("_y")).distinct()
    picked = F.broadcast(picked.orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows).select(same.alias("_of"), "_y"))
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_of", same).join(picked, "_of").select("_id", "_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [list(map(float, features(t or ""))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["_id", "_y", "x"])

    kind = kinds[0].simpleString()
    found = sample.mapInArrow(run, f"_id {kind}, _y double, x array<double>").distinct().orderBy(F.xxhash64("_id"), "_id", "_y", "x").limit(rows)
    got = sorted((r["_id"], r["_y"], tuple(r["x"])) for r in found.collect())
    return fit(np.array([r[2] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: the id, ``score``, ``predicted``; or with ``keep`` the rows of at least ``threshold``, as they were.

    A null text counts as empty; empty texts are scored by their features like any other. Repeated rows and null
    ids are carried through. An empty table gives an empty result. The model is a few kilobytes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: list) -> np.ndarray:
        return sent.value.score(np.array([features(t or "") for t in texts]).reshape(-1, len(FEATURES)))

    if keep:
        at = docs.columns.index(text_col)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(scored(batch.column(at).to_pylist()) >= threshold))

        return docs.mapInArrow(kept, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scored(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
