"""Byte-level BPE by a monoid tree reduction.

``encode`` of a string splits it by the pattern; each match is encoded alone. A match's bytes are halved down to
single bytes; a half's tokens are an element of a monoid whose product re-encodes a window around the joint.
Tokens stand if every neighbouring pair stands, since a merge needs only what its two sides hold; so once the
window's outermost tokens are those that were there before, what lies outside can't change. Until then the
window doubles. Short halves and windows recur, so a worker remembers what they encode to. Decoding concatenates
byte strings up a tree.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm import tokenizers_io
from lodestar.llm.units import UnitEncoder

LONG = 128  # bytes from which the merges of a window go through a heap
FAN = 64  # children of a node of the decoding tree
REMEMBERED, SHORT = 400_000, 12  # halves and windows that a worker remembers, and their bytes


def greedy(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the lowest-ranked neighbouring pair, the leftmost of equals, until none is left."""
    if len(piece) > LONG:
        return _greedy_heap(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    scores = [get(piece[i : i + 2], 1 << 60) for i in range(len(piece) - 1)]
    while scores:
        best = min(scores)
        if best == 1 << 60:
            break
        i = scores.index(best)
        parts[i] += parts[i + 1]
        del parts[i + 1], scores[i]
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
    return parts


def _greedy_heap(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (r := ranks.get(piece[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[after[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j] = False
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    return [piece[i : end[i]] for i in range(n) if alive[i]]


class Monoid:
    """The tokens of byte strings under the product that encodes their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.halves: dict[bytes, list[bytes]] = {}
        self.windows: dict[bytes, list[bytes]] = {}

    def window(self, piece: bytes) -> list[bytes]:
        got = self.windows.get(piece)
        if got is None:
            got = greedy(piece, self.ranks)
            if len(piece) <= SHORT:
                if len(self.windows) >= REMEMBERED:
                    self.windows.clear()
                self.windows[piece] = got
        return got

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Tokens of the concatenation of what ``left`` and ``right`` encode."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.window(b"".join(left[-i:] + right[:j]))
            left_stands = i == len(left) or window[0] == left[-i]
            right_stands = j == len(right) or window[-1] == right[j - 1]
            if left_stands and right_stands:
                return left[:-i] + window + right[j:]
            i, j = i * (1 if left_stands else 2), j * (1 if right_stands else 2)

    def reduce(self, piece: bytes) -> list[bytes]:
        if len(piece) < 2:
            return [piece] if piece else []
        got = self.halves.get(piece)
        if got is None:
            mid = len(piece) // 2
            got = self.join(self.reduce(piece[:mid]), self.reduce(piece[mid:]))
            if len(piece) <= SHORT:
                if len(self.halves) >= REMEMBERED:
                    self.halves.clear()
                self.halves[piece] = got
        return got

    def encode(self, piece: bytes) -> list[bytes]:
        """A match that is a token as it stands is that token."""
        return [piece] if piece in self.ranks else self.reduce(piece)


def decode(ids, table: list[bytes]) -> bytes:
    """Concatenates up a tree; ``table[id]`` holds a token's bytes."""
    parts = list(map(table.__getitem__, ids))
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
    return parts[0] if parts else b""


@functools.lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str | None = None):
    """(encode: str -> little-endian unsigned 32-bit ids, decode: those bytes -> text's bytes)."""
    import public_tokenizers
    import regex

    ranks = tokenizers_io.read_ranks(ranks_path)
    find = regex.compile(pattern or public_tokenizers.PATTERN).findall
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    known: dict[str, bytes] = {}
    tokens_of = Monoid(ranks).encode

    def of_piece(piece: str) -> bytes:
        packed = known.get(piece)
        if packed is None:
            packed = array("I", map(ranks.__getitem__, tokens_of(piece.encode("utf-8", "replace")))).tobytes()
            if len(piece) <= 64:
                if len(known) > 200_000:
                    known.clear()
                known[piece] = packed
        return packed

    parts = UnitEncoder(lambda s: b"".join(map(of_piece, find(s))), 600_000).parts
    return (lambda text: b"".join(parts(text))), (lambda packed: decode(np.frombuffer(packed, "<u4").tolist(), table))


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and ``ids`` if asked for).

    A null text counts as empty: no token, digests of no bytes. Rows with equal or null ids are separate rows.
    Only the two named columns are read, so others can't clash. An empty table gives an empty result. Memory is
    bounded by an Arrow batch and the worker's caches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode_ = codec(ranks_path)
        for batch in batches:
            rows = {"n": [], "a": [], "b": [], "ids": []}
            for text in batch.column(1).to_pylist():
                packed = encode(text or "")
                rows["n"].append(len(packed) // 4)
                rows["a"].append(hashlib.sha256(packed).hexdigest())
                rows["b"].append(hashlib.sha256(decode_(packed)).hexdigest())
                if keep_ids:
                    rows["ids"].append(packed)
            columns = [batch.column(0), pa.array(rows["n"], pa.int64()), pa.array(rows["a"], pa.string()), pa.array(rows["b"], pa.string())]
            if keep_ids:
                columns.append(pa.array(rows["ids"], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)
