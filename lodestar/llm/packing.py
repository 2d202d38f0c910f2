"""Best-fit packing of token sequences by exact complements.

What is packed is described by how many pieces there are of each length from 1 to the capacity: a table that
doesn't grow with the data. On it the plan is made. Sums of two lengths are indexed by their value, and sums of
three by their value as a length and an indexed sum of two. From the longest length down, the gap that a piece
leaves is looked up among single lengths, sums of two and sums of three; a combination that fills it exactly is
consumed as often as its lengths are available. What remains goes best-fit, longest first. The plan is made for
several least lengths that may start an exact combination, and the one with the fewest sequences is taken; one of
them starts none, so the result is never worse than best fit. A plan is a short list of runs ("pieces of this
length with these numbers go to these sequences at this offset"). Pieces are numbered within their length by
Spark, and each looks up its run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import tokenizers_io
from lodestar.llm.common import materialize, shuffle_partitions


class _Sums:
    """Combinations of available lengths by their sum, beside the lengths ``taken`` for the same sequence.

    Counts only fall, so a place of the index that has run out is passed for good.
    """

    def __init__(self, left: list[int]):
        self.left = left
        self.lengths = [x for x in range(len(left) - 1, 0, -1) if left[x]]
        self.pair_at: dict[int, int] = {}
        self.triple_at: dict[int, int] = {}

    def available(self, parts: tuple[int, ...]) -> int:
        return min(self.left[x] // parts.count(x) for x in parts)

    def _first(self, places: dict[int, int], total: int, taken: tuple[int, ...], parts_with) -> tuple[int, ...] | None:
        passing = True
        for i in range(places.get(total, 0), len(self.lengths)):
            x = self.lengths[i]
            if x < total and self.left[x] and (parts := parts_with(x, ())) and self.available(parts):
                if passing:
                    places[total], passing = i, False
                if (parts := parts_with(x, taken)) and self.available((*parts, *taken)):
                    return parts
        if passing:
            places[total] = len(self.lengths)
        return None

    def single(self, total: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        return (total,) if self.available((total, *taken)) else None

    def pair(self, total: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths, the larger one as large as it can be."""
        return self._first(self.pair_at, total, taken, lambda x, _: (x, total - x) if 2 * x >= total else None)

    def triple(self, total: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        return self._first(self.triple_at, total, taken, lambda x, beside: (pair := self.pair(total - x, (x, *beside))) and (x, *pair))


def plan(counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """counts[n]: pieces of length n, up to the capacity ``len(counts) - 1``.

    Returns runs (length, first number, how many, first sequence, offset); a run's i-th piece goes to sequence
    ``first sequence + i``.
    """
    capacity = len(counts) - 1
    plans = (_plan(counts, least) for least in (1, capacity // 3, capacity // 2, capacity + 1))
    return min(plans, key=lambda runs: max((first + n for _, _, n, first, _ in runs), default=0))


def _plan(counts: np.ndarray, least: int) -> list[tuple[int, int, int, int, int]]:
    """One sequence after the other, each begun by the longest length left. A gap of at least ``least`` looks for an
    exact combination; without one the longest length that fits goes in, and the gap that is left looks again. Each
    step empties a length, so there are few runs."""
    capacity = len(counts) - 1
    left = [int(c) for c in counts]
    used = [0] * (capacity + 1)
    runs: list[tuple[int, int, int, int, int]] = []
    sums, sequence = _Sums(left), 0
    for a in range(capacity, 0, -1):
        while left[a]:
            parts, gap = (a,), capacity - a
            while gap:
                rest = gap >= least and (sums.single(gap, parts) or sums.pair(gap, parts) or sums.triple(gap, parts))
                rest = rest or next(((x,) for x in range(gap, 0, -1) if left[x] > parts.count(x)), None)
                if not rest:
                    break
                parts += rest
                gap -= sum(rest)
            n, offset = sums.available(parts), 0
            for x in parts:
                runs.append((x, used[x], n, sequence, offset))
                used[x] += n
                left[x] -= n
                offset += x
            sequence += n
    return runs


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row per piece. A document longer than the capacity is cut from its end, so only its first piece is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizers_io.unit_encoder(tokenizer_path, False)
        end, width = int(end_id).to_bytes(4, "little"), 4
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                packed = encode(text or "") + end
                n = len(packed) // width
                bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k in range(len(bounds) - 1):
                    row.append(i)
                    piece.append(k)
                    start.append(bounds[k])
                    length.append(bounds[k + 1] - bounds[k])
                    crc.append(zlib.crc32(packed[bounds[k] * width : bounds[k + 1] * width]))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A null or empty text is one piece that holds the end token alone. Repeated rows are packed as often as they
    occur; a null id is carried through. Other columns aren't read. An empty table gives an empty result. The
    driver holds the plan, which is bounded by the capacity alone. Pieces of a length are numbered in blocks of an
    eighth of a partition's even share, so the table of blocks has at most a row per length and eight per partition.
    """
    spark = docs.sparkSession
    pieces = materialize(cut(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    share = max(1, int(counts.sum()) // (8 * shuffle_partitions(spark)))
    blocks = F.lit([int(-(-c // share)) or 1 for c in counts])
    pieces = pieces.withColumn("_block", F.pmod(F.xxhash64(id_col, "piece"), F.get(blocks, F.col("length").cast("int"))))
    sizes = pieces.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "piece-sizes")
    runs = sorted(plan(counts)) or [(0, 0, 0, 0, 0)]
    length, first, _, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*runs))
    starts = {n: np.flatnonzero(length == n) for n in np.unique(length)}
    plan_ = spark.sparkContext.broadcast((first, sequence, offset, {int(n): (int(i[0]), int(i[-1]) + 1) for n, i in starts.items()}))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        first, sequence, offset, span = plan_.value
        n, k = lengths.to_numpy(), numbers.to_numpy()
        at = np.empty(len(n), dtype=np.int64)
        for value in np.unique(n):
            lo, hi = span[int(value)]
            mask = n == value
            at[mask] = lo + np.searchsorted(first[lo:hi], k[mask], side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + k - first[at], "offset": offset[at]})

    within = Window.partitionBy("length", "_block").orderBy(id_col, "piece", "start", "ids_crc32")
    numbered = pieces.withColumn("_k", F.row_number().over(within)).join(sizes.select("length", "_block", "_before"), ["length", "_block"])
    placed = numbered.withColumn("_at", place("length", F.col("_before") + F.col("_k") - 1))
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
