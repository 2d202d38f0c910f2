"""The prefix trie of rebuilt conversations, merged family by family first.

A family is the conversations that share a base id. Its rows are brought together and sorted, and streamed through a
task: the members are rebuilt from the base's first turns and their own, and become one small trie. Only the nodes of
those tries are shuffled on, by a key that sums a hash of (depth, turn) along the path, so nodes that many families
share arrive as sums. Turns travel as digests and byte counts, however long their texts are.

Subtree totals need no walk over levels. A node belongs to its smallest member, its owner. What a conversation owns
is the end of its path, from one depth on, so a second pass over the families that knows this depth (and whether the
end is a leaf) can add up children, leaves and owned bytes for each prefix of each member.

A conversation with more turns than LONG_TURNS and than an eighth of a partition's even share (there can't be more
than eight a partition) isn't gathered: its turns are numbered by a range sort, and its path's keys come from sums of
blocks. The ids that end at a node are hashed in order of a range sort, as chunks, so a node at which a third of all
conversations ends is joined up by many tasks and only hashed by one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, join_split, materialize, shuffle_partitions

FAMILY, HEADS, LONG_TURNS = 5, 9, 1024
_KEYS = 1 << 128
CHUNK_CHARS = 1 << 18


def _step(depth: int, digest: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(digest + depth.to_bytes(8, "little"), digest_size=16).digest(), "little")


def _binary(key: int) -> bytes:
    return key.to_bytes(16, "little")


def own_from(conv: int) -> int:
    """From which of its own turns on a conversation keeps them."""
    return zlib.crc32(str(conv).encode()) % HEADS


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _mapped(df: DataFrame, make: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])
    return df.mapInArrow(lambda batches: _batches(make(_rows(batches)), arrow), schema)


def _families(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """For each family the members: (conv, path, is long, depth from which it owns its path or None, is leaf).

    The path is a list of (digest, bytes); of a long conversation only the base's part.
    """
    for base, own in groupby(rows, itemgetter(0)):
        members: dict[int, list] = {}
        for _, conv, turn_of, digest, size, long, depth, leaf in own:
            m = members.setdefault(conv, [[], False, None, False])
            if turn_of:
                m[0].append((digest, size))
                m[1] = long
            else:
                m[2:] = depth, leaf
        head = members[base][0][: HEADS - 1] if base in members else []
        out = []
        for conv, (turns, long, depth, leaf) in members.items():
            h = own_from(conv)
            out.append((conv, head[:h] + ([] if long else turns[h:]), long, depth, leaf))
        yield out


def _node_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """key, depth, bytes, parent, n, owner, ends: the nodes of each family's trie."""
    for members in _families(rows):
        trie: dict[int, list] = {}
        for conv, path, long, _, _ in members:
            key, parent = 0, None
            for depth in range(len(path) + 1):
                size = 0
                if depth:
                    digest, size = path[depth - 1]
                    parent, key = key, (key + _step(depth, digest)) % _KEYS
                node = trie.setdefault(key, [depth, size, parent, 0, conv, 0])
                node[3] += 1
                node[4] = min(node[4], conv)
            node[5] += not long
        for key, (depth, size, parent, n, owner, ends) in trie.items():
            yield _binary(key), depth, size, None if parent is None else _binary(parent), n, owner, ends


def _start_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """conv, depth, key, bytes: where the own turns of long conversations begin."""
    for members in _families(rows):
        for conv, path, long, _, _ in members:
            if long:
                key = sum(_step(d, digest) for d, (digest, _) in enumerate(path, 1)) % _KEYS
                yield conv, len(path), _binary(key), sum(size for _, size in path)


def _total_rows(rows: Iterator[tuple], whole: dict[int, tuple[int, int, int]]) -> Iterator[tuple]:
    """key, children, leaves, saved, base, ends: what the members of a family add to the nodes of their paths.

    ``whole`` has the depth, the bytes and the bytes before the owned part of each long conversation.
    """
    for members in _families(rows):
        trie: dict[int, list] = {}
        for conv, path, long, own, leaf in members:
            before = [0]
            for _, size in path:
                before.append(before[-1] + size)
            length, total, start = whole[conv] if long else (len(path), before[-1], before[max(own - 1, 0)] if own is not None else 0)
            key = 0
            for depth in range(len(path) + 1):
                if depth:
                    key = (key + _step(depth, path[depth - 1][0])) % _KEYS
                node = trie.setdefault(key, [0, 0, 0, []])
                passed = before[depth - 1] if depth else 0
                node[2] += total - passed
                if own is not None:
                    node[0] += own <= depth + 1 <= length
                    node[1] += leaf
                    node[2] -= total - (passed if depth >= own else start)
            if not long:
                node[3].append(conv)
        first, alone = min(m[0] for m in members), any(m[2] for m in members)  # ids of a long member may stand between
        for key, (children, leaves, saved, ends) in trie.items():
            joined = ",".join(map(str, sorted(ends))) if ends and not alone else None
            yield _binary(key), children, leaves, saved, first, joined
            for conv in ends if alone else ():
                yield _binary(key), 0, 0, 0, conv, str(conv)


def _head_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """conv, depth, before: the bytes above each node of the base's part of long conversations."""
    for members in _families(rows):
        for conv, path, long, _, _ in members:
            for depth in range(len(path) + 1) if long else ():
                yield conv, depth, sum(size for _, size in path[: max(depth - 1, 0)])


def _chunk_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """key, first, ids: runs of sorted (key, first, ids) of one key joined by commas, up to CHUNK_CHARS and one more."""
    for key, own in groupby(rows, itemgetter(0)):
        held, first, size = [], None, 0
        for _, at, ids in own:
            first = at if not held else first
            held.append(ids)
            size += len(ids) + 1
            if size >= CHUNK_CHARS:
                yield key, first, ",".join(held)
                held, size = [], 0
        if held:
            yield key, first, ",".join(held)


def _sha_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """key, sha: of each key's chunks in order, joined by commas; they stream through, one at a time."""
    for key, own in groupby(rows, itemgetter(0)):
        sha, glue = hashlib.sha256(), b""
        for _, _, ids in own:
            sha.update(glue + ids.encode())
            glue = b","
        yield key, sha.hexdigest()


def _ends(totals: DataFrame) -> DataFrame:
    ended = totals.filter(F.col("ends").isNotNull()).select("key", "base", "ends")
    ranged = ended.repartitionByRange("key", "base").sortWithinPartitions("key", "base")
    chunks = _mapped(ranged, _chunk_rows, "key binary, first long, ids string")
    return _mapped(chunks.repartition("key").sortWithinPartitions("key", "first"), _sha_rows, "key binary, sha string")


class _Long:
    """The turns of the conversations that aren't gathered: numbered by a range sort, summed by blocks."""

    def __init__(self, rows: DataFrame, block: int, scratch: Scratch):
        self.block, self.scratch = block, scratch
        order = ["conv", F.asc_nulls_first("turn"), "digest"]
        ordered = rows.repartitionByRange(*order, F.rand(7)).sortWithinPartitions(*order)
        ordered = scratch(ordered.select("conv", "digest", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "trie-long")
        # a row per partition and conversation that meet: at most as many as both together
        spans, shifts, done = sorted(ordered.groupBy("part", "conv").agg(F.min("at"), F.count(F.lit(1))).collect()), [], {}
        for part, conv, at, n in spans:
            shifts.append((part, conv, done.get(conv, 0) - at))
            done[conv] = done.get(conv, 0) + n
        self.counts = done
        shift = rows.sparkSession.createDataFrame(shifts, "part int, conv long, shift long")
        self.turns = scratch(ordered.join(F.broadcast(shift), ["part", "conv"]).select("conv", (F.col("at") + F.col("shift")).alias("turn"), "digest", "bytes"), "trie-numbered")

    def tails(self, starts: list) -> DataFrame:
        """key, depth, bytes, parent, conv, before, last: the nodes of own turns, ``before`` the bytes above them."""
        block, at = self.block, {r["conv"]: (r["depth"], r["key"], r["bytes"]) for r in starts}
        own = self.turns.filter(F.col("turn") >= F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS)
        own = own.withColumn("block", F.floor(F.col("turn") / block)).select("conv", "block", "turn", "digest", "bytes")
        own = own.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn")

        def depth_of(conv: int, turn: int) -> int:
            return at[conv][0] + turn - own_from(conv) + 1

        def sums(rows: Iterator[tuple]) -> Iterator[tuple]:
            for (conv, number), turns in groupby(rows, itemgetter(0, 1)):
                key = size = 0
                for _, _, turn, digest, n in turns:
                    key, size = key + _step(depth_of(conv, turn), digest), size + n
                yield conv, number, _binary(key % _KEYS), size

        # as many blocks as conversations and partitions allow
        begins, now = {}, {c: (int.from_bytes(k, "little"), b) for c, (_, k, b) in at.items()}
        for conv, number, key, size in sorted(_mapped(own, sums, "conv long, block long, key binary, bytes long").collect()):
            begins[conv, number] = now[conv]
            now[conv] = (now[conv][0] + int.from_bytes(key, "little")) % _KEYS, now[conv][1] + size
        self.whole = {c: (depth_of(c, self.counts[c] - 1), now[c][1]) for c in at}
        lengths = {c: x[0] for c, x in self.whole.items()}

        def nodes(rows: Iterator[tuple]) -> Iterator[tuple]:
            for which, turns in groupby(rows, itemgetter(0, 1)):
                key, before = begins[which]
                for conv, _, turn, digest, n in turns:
                    parent, depth = key, depth_of(conv, turn)
                    key = (key + _step(depth, digest)) % _KEYS
                    yield _binary(key), depth, n, _binary(parent), conv, before, depth == lengths[conv]
                    before += n

        return self.scratch(_mapped(own, nodes, "key binary, depth long, bytes long, parent binary, conv long, before long, last boolean"), "trie-tails")


def build(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long_turns: int = LONG_TURNS) -> DataFrame:
    """A row per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``.

    Ids and turns are integers. Turns are ordered with null first, those that tie by the digest of role and text, so
    rows that repeat stand one after the other. Null role or text counts as empty, and empty ones are turns like any.
    Rows without an id take no part. A base is the id less its remainder by FAMILY, which rounds towards zero. Very
    long texts are hashed whole; other columns aren't read. An empty table has no node, not even a root.
    """
    spark, parts, scratch = turns.sparkSession, shuffle_partitions(turns.sparkSession), Scratch()
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("r"), text.alias("t")).filter(F.col("conv").isNotNull())
    digest = F.unhex(F.left(F.sha2(F.concat(F.length("r").cast("string"), F.lit(":"), "r", "t").cast("binary"), 256), F.lit(32)))
    rows = scratch(rows.select("conv", "turn", digest.alias("digest"), F.octet_length("t").cast("long").alias("bytes")), "trie-turns")

    counts = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    share = -(-rows.count() // (8 * parts))
    hot = scratch(counts.filter(F.col("n") > max(long_turns, share, HEADS)).select("conv"), "trie-hot")  # at most eight a partition
    some = hot.count() > 0
    base = (F.col("conv") - F.col("conv") % FAMILY).alias("base")
    fields = [base, "conv", F.lit(True).alias("is_turn"), "turn", "digest", "bytes"]
    gathered = rows.select(*fields, F.lit(False).alias("long"))
    if some:
        long = _Long(rows.join(F.broadcast(hot), "conv", "left_semi"), max(share, 1), scratch)
        heads = long.turns.filter(F.col("turn") < HEADS).select(*fields, F.lit(True).alias("long"))
        gathered = gathered.join(F.broadcast(hot), "conv", "left_anti").select(gathered.columns).unionByName(heads)
    gathered = gathered.withColumns({"depth": F.lit(None).cast("long"), "leaf": F.lit(None).cast("boolean")})

    def by_family(df: DataFrame) -> DataFrame:
        sort = ["base", "conv", "is_turn", F.asc_nulls_first("turn"), "digest"]
        return df.repartition("base").sortWithinPartitions(*sort).drop("turn")

    nodes = _mapped(by_family(gathered), _node_rows, "key binary, depth long, bytes long, parent binary, n long, owner long, ends long")
    if some:
        families = hot.select(base).distinct()
        starts = _mapped(by_family(gathered.join(F.broadcast(families), "base", "left_semi")), _start_rows, "conv long, depth long, key binary, bytes long").collect()
        tails = long.tails(starts)
        nodes = nodes.unionByName(tails.select("key", "depth", "bytes", "parent", F.lit(1).cast("long").alias("n"), F.col("conv").alias("owner"), F.col("last").cast("long").alias("ends")))
    merged = nodes.groupBy("key").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.sum("n").alias("n"), F.min("owner").alias("owner"), F.sum("ends").alias("ends"))
    merged = scratch(merged, "trie-nodes")

    own = merged.groupBy(F.col("owner").alias("conv")).agg(F.min(F.struct("depth", "key", "parent")).alias("top"), F.max(F.col("n") == F.col("ends")).alias("leaf"))
    own = scratch(own.select("conv", "top.*", "leaf"), "trie-owners")
    owners = own.select(base, "conv", F.lit(False).alias("is_turn"), *[F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("digest", "binary"), ("bytes", "long"), ("long", "boolean"))], "depth", "leaf")
    whole: dict[int, tuple[int, int, int]] = {}
    if some:
        mine = own.join(F.broadcast(hot), "conv", "left_semi").select("conv", F.col("depth").alias("top"), "leaf")
        info = {r["conv"]: (r["top"], r["leaf"]) for r in mine.collect()}
        found = tails.join(F.broadcast(mine), "conv").filter(F.col("depth") == F.col("top")).select("conv", "before").collect()
        before = {r["conv"]: r["before"] for r in found}
        whole = {c: (n, total, before.get(c, 0)) for c, (n, total) in long.whole.items()}
        early = [c for c, (top, _) in info.items() if c not in before]
        if early:
            kept = _mapped(by_family(gathered.join(F.broadcast(families), "base", "left_semi")), _head_rows, "conv long, depth long, before long")
            tops = {(c, info[c][0]) for c in early}
            for r in kept.collect():
                if (r["conv"], r["depth"]) in tops:
                    whole[r["conv"]] = (*whole[r["conv"]][:2], r["before"])
    totals = _mapped(by_family(gathered.unionByName(owners)), lambda r: _total_rows(r, whole), "key binary, children long, leaves long, saved long, base long, ends string")
    if some:
        table = spark.createDataFrame([(c, *x, *info.get(c, (None, False))) for c, x in whole.items()], "conv long, length long, total long, start long, top long, leaf boolean")
        t = tails.join(F.broadcast(table), "conv")
        has, zero = F.col("top").isNotNull(), F.lit(0).cast("long")
        owned = F.when(has, F.col("total") - F.when(F.col("depth") >= F.col("top"), F.col("before")).otherwise(F.col("start"))).otherwise(zero)
        child = F.when(has & (F.col("top") <= F.col("depth") + 1) & (F.col("depth") < F.col("length")), F.lit(1).cast("long")).otherwise(zero)
        totals = totals.unionByName(t.select("key", child.alias("children"), F.when(has & F.col("leaf"), F.lit(1).cast("long")).otherwise(zero).alias("leaves"), (F.col("total") - F.col("before") - owned).alias("saved"), F.col("conv").alias("base"), F.when(F.col("last"), F.col("conv").cast("string")).alias("ends")))
    totals = scratch(totals, "trie-totals")

    tops = own.filter("depth > 0").select("key", "parent")
    above = join_split(tops, merged.select(F.col("key").alias("parent"), F.col("owner").alias("above")), "parent", keep=scratch)
    pieces = [
        merged.select("key", "depth", "owner", "n"), totals.select("key", "children", "leaves", "saved"),
        above.select("key", "above"), _ends(totals),
    ]
    union = pieces[0]
    for piece in pieces[1:]:
        union = union.unionByName(piece, allowMissingColumns=True)
    out = union.groupBy("key").agg(*[F.max(c).alias(c) for c in ("depth", "owner", "n", "above", "sha")], *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    out = out.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("above", "owner")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    out = materialize(out, "trie")
    scratch.clear()
    return out


ORACLE_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), ids AS (
  SELECT DISTINCT conv_id AS c, conv_id - conv_id % 5 AS base FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1])), 4294967295) % 9 AS h FROM ids, crc
), turns AS (
  SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) - 1 AS j FROM turns
), rebuilt AS (
  SELECT v.c, 0 AS own, j, digest, bytes FROM convs v JOIN numbered n ON n.c = v.base AND j < h
  UNION ALL SELECT v.c, 1, j, digest, bytes FROM convs v JOIN numbered n ON n.c = v.c AND j >= h
), paths AS (
  SELECT c, row_number() OVER w AS depth, bytes, string_agg(digest, '') OVER w AS path FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, j)
  UNION ALL SELECT c, 0, 0, '' FROM convs
), sized AS (
  SELECT *, md5(path) AS key, max(depth) OVER (PARTITION BY c) AS len, lag(md5(path)) OVER (PARTITION BY c ORDER BY depth) AS up FROM paths
), nodes AS (
  SELECT key, depth, any_value(up) AS up, min(c) AS owner, count(*) AS n, max(bytes) AS bytes,
         coalesce(string_agg(CASE WHEN depth = len THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM sized GROUP BY key, depth
), children AS (
  SELECT up AS key, count(*) AS k FROM nodes WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT s.key, sum((m.n - 1) * m.bytes)::BIGINT AS saved, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END)::BIGINT AS leaves
  FROM nodes m LEFT JOIN children ON children.key = m.key JOIN sized s ON s.c = m.owner AND s.depth <= m.depth GROUP BY s.key
)
SELECT m.owner AS conv_id, m.depth, p.owner AS parent_conv_id, m.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens,
       sha256(m.ends) AS ends_sha256
FROM nodes m JOIN below ON below.key = m.key LEFT JOIN children ON children.key = m.key LEFT JOIN nodes p ON p.key = m.up
"""
