"""Near-duplicate classes by ProbMinHash, banding and verification.

A text's words (lower-cased runs of letters and digits) give shingles of five words, weighted by how often they
occur. Each shingle is a Poisson process whose rate is its weight; its arrivals fall on random registers, and a
register keeps the shingle that arrives first. Two texts agree on a register with the probability Jaccard
similarity of their weighted shingles. A shingle's process ends as soon as its next arrival comes later than
all registers' first ones. Bands of registers are keys; texts that share a key are candidates, and candidates
are compared on their full shingles. Two texts count as alike by the larger of plain and probability Jaccard, so a
text that repeats shingles has the keys of its plain set too; for any other text both are the same.

Texts with equal words are one node from the start. The texts of a key don't become all pairs: few of them
(``SMALL``) do, and in a larger group each is compared with its centre, the text that shares keys with most
others; those not like it are compared with ``SECOND`` further centres. Links become classes by spreading the
smallest node number.

An id may stand on different texts. A row is therefore known by its id and ``mark``, a digest of its text as it
stands; nodes are numbered, and a class is named by its smallest (id, mark).

Two kinds of pairs are left, and only where the texts are of different classes: two texts of a key like none of its
centres, and a text like a centre with one unlike it. Both similarities are one minus a metric, so two texts are alike
only if their similarities to the centre differ by at most ``1 - SIMILARITY``. Such pairs are told apart by longer
sketches of one bit a register, within the join; those that differ in few enough bits are compared in full. A bit is
taken from shingle and register together, so that the bits of a text of few shingles are independent too. At a
similarity of 0.8 the bound (``DIFFER`` of ``BITS``) lies more than five standard deviations above the mean. The texts
of a key or centre are dealt over ``SALTS`` parts, so that these joins don't fall to one task.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, join_split, materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 6
SMALL, SECOND = 8, 8
BITS, DIFFER = 2048, 275
SALTS = 16

_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their counts. A text of fewer words than a shingle has one of all its words; one of none has none."""
    width = min(SHINGLE, len(words))
    if not width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(words) - width + 1
    s = np.full(n, width, np.uint64)
    for k in range(width):
        s = _mix((s ^ words[k : k + n]) * _MULTIPLIER)
    return np.unique(s, return_counts=True)


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """The Jaccard similarity of the shingle sets and the probability Jaccard of the weighted shingles."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0, 0.0
    plain = len(common) / (len(a[0]) + len(b[0]) - len(common))
    if a[1].max() == 1 and b[1].max() == 1:
        return plain, plain
    # with r = x / y over the common shingles, shingle i adds 1 / sum_j max(x_j / x_i, y_j / y_i)
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    by_ratio = np.argsort(x / y, kind="stable")
    x, y = x[by_ratio], y[by_ratio]
    y_up_to = np.cumsum(y)
    x_after = x.sum() - np.cumsum(x)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    return plain, float(np.sum(1 / ((x_after + only_a) / x + (y_up_to + only_b) / y)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the two similarities."""
    return max(similarities(a, b))


def sketch(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """ProbMinHash signatures, one row per set; a set without shingles keeps zeros."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    first = np.full(n * registers, np.inf)
    signature = np.zeros(n * registers, np.uint64)
    if not len(owner):
        return signature.reshape(n, registers)
    element, weight = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]).astype(float)
    state, arrival, of, latest = element.copy(), np.zeros(len(element)), owner, np.full(n, np.inf)
    while len(element):
        state = state + _MULTIPLIER
        draw = _mix(state)
        arrival = arrival - np.log(((draw >> np.uint64(12)).astype(float) + 0.5) / 2.0**52) / weight
        alive = arrival < latest[of]
        element, weight, state, arrival, of, draw = (v[alive] for v in (element, weight, state, arrival, of, draw))
        place = of * registers + (_mix(draw ^ _MULTIPLIER) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, arrival)
        won = first[place] == arrival
        signature[place[won]] = element[won]
        latest = first.reshape(n, registers).max(1)
    return signature.reshape(n, registers)


def _band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = signature.reshape(len(signature), -1, rows)
    key = np.arange(bands.shape[1], dtype=np.uint64)[None, :] * _MULTIPLIER
    for r in range(rows):
        key = _mix((key ^ bands[:, :, r]) * _MULTIPLIER)
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, ``mark``, ``content`` (a digest of the words; null if there is none) and ``keys``: one per band, and for a text that repeats shingles those of their set too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                words = [word_hashes(t) for t in batch.column(1).to_pylist()]
                content = [xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None for w in words]
                sets = [shingles(w) for w in words]
                keys = list(_band_keys(sketch(sets, bands * rows), rows))
                repeating = [i for i, (_, n) in enumerate(sets) if len(n) and n.max() > 1]
                if repeating:
                    plain = _band_keys(sketch([(sets[i][0], np.ones_like(sets[i][1])) for i in repeating], bands * rows), rows)
                    for i, own in zip(repeating, plain, strict=True):
                        keys[i] = np.union1d(keys[i], own)
                ends = np.cumsum([0, *map(len, keys)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(content, pa.binary()), lists], names=["id", "mark", "content", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col), F.xxhash64(text_col).alias("mark")).mapInArrow(run, f"id {kind}, mark long, content binary, keys array<long>")


def _bits(texts: DataFrame) -> DataFrame:
    """id and two sketches of one bit a register, as longs: of the weighted shingles and of their set."""
    names = [f"{kind}{k}" for kind in ("weighted", "plain") for k in range(BITS // 64)]
    register = np.arange(BITS, dtype=np.uint64) * _MULTIPLIER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 64):
                batch = whole.slice(lo, 64)
                sets = [shingles(word_hashes(t)) for t in batch.column(1).to_pylist()]
                both = [sketch(s, BITS) for s in (sets, [(e, np.ones_like(n)) for e, n in sets])]
                longs = np.concatenate([np.packbits(_mix(s ^ register) & np.uint64(1) > 0, axis=1).view(np.int64) for s in both], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, longs.T.copy())], names=["id", *names])

    return texts.select("id", "text").mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def _close(left: str, right: str) -> Column:
    """Whether two rows' sketches differ in few enough bits."""
    kinds = ([F.bit_count(F.col(f"{left}.{kind}{k}").bitwiseXOR(F.col(f"{right}.{kind}{k}"))) for k in range(BITS // 64)] for kind in ("weighted", "plain"))
    weighted, plain = (functools.reduce(Column.__add__, counts) <= DIFFER for counts in kinds)
    return weighted | plain


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with both similarities of their full texts."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, tuple] = {}

        def of(i: int, text: str):
            if i not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[i] = shingles(word_hashes(text))
            return kept[i]

        for batch in batches:
            both = [similarities(of(a, ta), of(b, tb)) for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True)]
            plain, weighted = np.array(both, float).reshape(-1, 2).T
            yield batch[["a", "b"]].assign(plain=plain, weighted=weighted)

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return joined.mapInPandas(run, "a long, b long, plain double, weighted double")


def components(links: DataFrame, keep: Scratch) -> DataFrame:
    """(id, root): each linked node's class, named by its smallest id. Each round is written to the shared folder."""
    both = keep(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = keep(step.join(jump, "root", "left").select("id", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        changed = step.filter("root <> old").limit(1).count()
        labels = step.select("id", "root")
        if not changed:
            return labels


def _candidates(members: DataFrame, small: int, centres: int, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(key, id) -> pairs (a, b) to compare, and the members of large keys with their centres (key, id, centre)."""
    sizes = keep(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key-sizes")
    members = keep(join_split(members, sizes, "key", keep=keep), "members")
    few = members.filter(F.col("n") <= small).select("key", "id")
    pairs = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").filter("a < b").select("a", "b")
    large = members.filter(F.col("n") > small)
    ranked = large.join(large.groupBy("id").agg(F.sum("n").alias("degree")), "id")
    best = F.sort_array(F.collect_list(F.struct((-F.col("degree")).alias("d"), "id")))
    # the first members of each of a key's SALTS parts, then the first of those
    part = ranked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for keys in (("key", "part"), ("key",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("degree"), "id"))
        part = part.withColumn("place", place).filter(F.col("place") <= centres)
    top = keep(part.groupBy("key").agg(F.transform(best, lambda x: x["id"]).alias("centres")), "centres")
    stars = join_split(large.select("key", "id"), top, "key", keep=keep).select("key", "id", F.explode("centres").alias("centre"))
    pairs = pairs.union(stars.filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")))
    return pairs.distinct(), stars


def _like() -> Column:
    return F.greatest("plain", "weighted") >= SIMILARITY


def _dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on a frequent key: ``right`` in SALTS parts, ``left`` in each."""
    every = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return every.alias("l"), right.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).alias("r")


def _left_pairs(members: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (key, id) of one key, of different classes and with close sketches. ``known``: id, root, sketches."""
    left, right = _dealt(members.join(known, "id"), members.join(known, "id"))
    same = (F.col("l.key") == F.col("r.key")) & (F.col("l.part") == F.col("r.part"))
    on = same & (F.col("l.id") < F.col("r.id")) & (F.col("l.root") != F.col("r.root")) & _close("l", "r")
    return left.join(right, on).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def _border_pairs(spokes: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes, one like and one unlike their centre, that may be alike.

    ``spokes`` are (centre, id, plain, weighted). A text not like the centre comes into question if its similarity
    lies at most ``1 - SIMILARITY`` below that of one which is.
    """
    reach = 1 - SIMILARITY + 1e-9
    like, unlike = spokes.filter(_like()), spokes.filter(~_like())
    floors = like.groupBy("centre").agg(F.min("plain").alias("p"), F.min("weighted").alias("w"))
    near = (F.col("plain") >= F.col("p") - reach) | (F.col("weighted") >= F.col("w") - reach)
    unlike = unlike.join(floors, "centre").filter(near).drop("p", "w")
    left, right = _dealt(unlike.join(known, "id"), like.join(known, "id"))
    near = (F.abs(F.col("l.plain") - F.col("r.plain")) <= reach) | (F.abs(F.col("l.weighted") - F.col("r.weighted")) <= reach)
    same = (F.col("l.centre") == F.col("r.centre")) & (F.col("l.part") == F.col("r.part"))
    pairs = left.join(right, same & (F.col("l.root") != F.col("r.root")) & near & _close("l", "r"))
    return pairs.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))


def _classes(docs: DataFrame, id_col: str, text_col: str, small: int, second: int) -> DataFrame:
    """(id, mark, class_id, class_size, kept) for every row of ``docs``; see ``classes``."""
    keep = Scratch()
    signed = materialize(signatures(docs, id_col, text_col), "signatures")
    row = F.when(F.col("id").isNotNull(), F.struct("id", "mark"))
    nodes = signed.filter("content IS NOT NULL").groupBy("content").agg(F.min(row).alias("row"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"))
    nodes = nodes.filter("row IS NOT NULL").select("content", "row.id", "row.mark", "n", "keys", F.monotonically_increasing_id().alias("node"))
    nodes = keep(nodes, "nodes")
    members = nodes.select(F.explode("keys").alias("key"), F.col("node").alias("id"))
    texts, compared, spokes = None, None, None
    for centres in (1, second):
        pairs, stars = _candidates(members, small, centres, keep)
        pairs, stars = keep(pairs, "pairs"), keep(stars, "stars")
        if texts is None:
            wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
            wanted = nodes.select("id", "mark", "node").join(wanted.withColumnRenamed("id", "node"), "node", "left_semi")
            texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
            texts = texts.join(wanted.hint("merge"), ["id", "mark"]).select(F.col("node").alias("id"), "text").dropDuplicates(["id"])
            texts = keep(texts, "texts")
        found = keep(_compare(pairs, texts), "compared")
        of = stars.filter("id <> centre").select("centre", "id", F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        now = keep(of.join(found, ["a", "b"]).select("centre", "id", "plain", "weighted"), "spokes")
        compared, spokes = (found, now) if compared is None else (compared.union(found), spokes.union(now))
        done = stars.join(now.filter(_like()), ["id", "centre"]).select("key", "id").union(stars.select("key", F.col("centre").alias("id"))).distinct()
        members = keep(stars.select("key", "id").distinct().join(done, ["key", "id"], "left_anti"), "unlike")
        if not members.limit(1).count():
            break
    roots = components(compared.filter(_like()), keep)
    if spokes.filter(~_like()).limit(1).count():
        starred = spokes.select("id").union(members.select("id")).distinct()
        known = _bits(texts.join(starred, "id", "left_semi")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        known = keep(known, "sketches")
        left = keep(_left_pairs(members, known).union(_border_pairs(spokes, known)).distinct(), "left")
        between = _compare(left, texts).filter(_like())
        for side in ("a", "b"):
            between = between.join(roots.withColumnRenamed("id", side), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        between = keep(between, "between")
        if between.limit(1).count():
            joined = components(between, keep).select(F.col("id").alias("root"), F.col("root").alias("further"))
            alone = joined.join(roots.select(F.col("id").alias("root")), "root", "left_anti").select(F.col("root").alias("id"), F.col("further").alias("root"))
            roots = keep(roots.join(joined, "root", "left").select("id", F.coalesce("further", "root").alias("root")).union(alone), "roots")
    linked = keep(nodes.select("node", "id", "mark", "n").join(roots.withColumnRenamed("id", "node"), "node"), "linked")
    named = linked.groupBy("root").agg(F.min(F.struct("id", "mark")).alias("first"), F.sum("n").alias("size"))
    linked = join_split(linked.select("node", "root"), keep(named, "named"), "root", keep=keep).select("node", "first", "size")
    own = nodes.select("content", "node", "id", "mark", "n").join(linked, "node", "left")
    own = own.select("content", F.coalesce("first.id", "id").alias("class_id"), F.coalesce("first.mark", "mark").alias("class_mark"), F.coalesce("size", "n").alias("class_size"))
    kept = F.col("id").isNull() | F.col("class_mark").isNull() | ((F.col("id") == F.col("class_id")) & (F.col("mark") == F.col("class_mark")))
    classed = materialize(own, "classes")
    keep.clear()
    out = join_split(signed.select("id", "mark", "content"), classed, "content", "left")
    return out.select("id", "mark", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), kept.alias("kept"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, second: int = SECOND) -> DataFrame:
    """One row per row of ``docs``: the id, ``class_id`` (the smallest id of its class), ``class_size``, ``kept``.

    The row named by the class stays. Texts without a word (null, empty) are classes of their own, and so are
    rows with a null id, whose class is null and which stay. Of rows that repeat an id with the same text all are
    kept or dropped together; rows that repeat it with different texts are told apart, so that each class keeps its
    own row, and classes named by the same id are counted apart. Ids may be of any type that has an order. Texts
    are read whole, however long, and ties are broken by the smaller id. Other columns aren't read. An empty table gives
    an empty result. In a key's group larger than ``small``, members are compared with one centre, those unlike it with
    ``second`` others, and the pairs then left by their sketches.
    """
    return _classes(docs, id_col, text_col, small, second).select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    dropped = _classes(docs, id_col, text_col, SMALL, SECOND).filter("NOT kept").select(F.col("id").alias("_dropped_id"), F.col("mark").alias("_dropped_mark")).distinct()
    same = (docs[id_col] == dropped["_dropped_id"]) & (F.xxhash64(docs[text_col]) == dropped["_dropped_mark"])
    return docs.join(dropped, same, "left_anti").select(*[f"`{c}`" for c in docs.columns])
