import hashlib
import random
import zlib
from collections import defaultdict

from lodestar.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, conv string"


def table(spark, rows):
    """Rows (conv_id, turn, role, text) with extra columns whose names clash."""
    return spark.createDataFrame([(*r, 7, "k", "c") for r in rows], SCHEMA)


def brute(rows):
    """The contract, node by node: every prefix of every rebuilt conversation, and each node's whole subtree."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest(), r, t))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = (*own.get(base, [])[:h], *turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    out = []
    for node, own_members in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(o[: len(m)] == m and len(o) > len(m) for o in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own_members), len(node), parent, len(own_members), len(children), len(leaves), saved, sha))
    return sorted(out, key=str)


def built(spark, rows, **more):
    return sorted((tuple(r) for r in trie.build(table(spark, rows), **more).collect()), key=str)


def conversations(seed, families=12, words="ab", most=12):
    random.seed(seed)
    rows = []
    for c in random.sample(range(families * 5), families * 3):
        rows += [(c, random.choice([t, t, None]), random.choice(["user", "user", None]), random.choice([*words, "é", None])) for t in range(random.randint(1, most))]
    return rows


def test_trie_like_brute_force(spark):
    for seed in range(3):
        rows = conversations(seed)
        assert built(spark, rows) == brute(rows)


def test_trie_of_long_conversations(spark):
    """Conversations above the bound are numbered by ranges and summed by blocks: some alike, one inside another, a third of all rows."""
    rows = conversations(5, families=6)
    chain = [("user", str(i % 3)) for i in range(200)]
    for c, n in ((10, 200), (11, 200), (13, 150), (20, 40), (101, 40), (102, 40), (100, 30), (-3, 60), (-7, 60)):
        rows += [(c, t, *x) for t, x in enumerate(chain[:n])]
    rows += [(205, None, "user", "same")] * 150
    assert built(spark, rows, long_turns=9) == brute(rows)
    assert built(spark, rows) == brute(rows)


def test_trie_of_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_CHARS", 20)
    hot = [(c, t, "user", "hello " * 3) for c in range(0, 400, 2) for t in range(2)]
    odd = [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None), (9, 1, "", ""), (1003, 5, "a", "z" * 100_000), (1001, -1, "user", "hello")]
    assert built(spark, hot + odd) == brute(hot + odd)
    assert built(spark, []) == []
    assert built(spark, odd[:1]) == []
    one = built(spark, [(3, 0, "user", "x")])  # shorter than what it would keep, and without a base: a turnless root
    assert one == brute([(3, 0, "user", "x")])
