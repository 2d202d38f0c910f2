"""Packing against all packings, and language verdicts against sizes summed up one by one."""

import functools
import random

import numpy as np
import zstandard

from lodestar.llm import langid, packing, quality


def fewest(lengths, capacity):
    """The least number of sequences, over all packings: by subsets, the best (sequences, filled) of each."""

    @functools.cache
    def best(left):
        if not left:
            return 0, capacity
        out = (len(lengths) + 1, 0)
        for i in range(len(lengths)):
            if left >> i & 1:
                n, filled = best(left & ~(1 << i))
                out = min(out, (n, filled + lengths[i]) if filled + lengths[i] <= capacity else (n + 1, lengths[i]))
        return out

    return best((1 << len(lengths)) - 1)[0]


def placed(lengths, capacity):
    """Number of sequences of the plan, which is held to be whole: every piece once, none over another, no gap."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    rows, taken = [], np.zeros(capacity + 1, int)
    for length, first, n, sequence, offset in packing.plan(counts):
        assert first == taken[length]
        taken[length] += n
        rows += [(sequence + i, offset, length) for i in range(n)]
    assert (taken == counts).all()
    at = {}
    for sequence, offset, length in sorted(rows):
        assert offset == at.get(sequence, 0) and offset + length <= capacity
        at[sequence] = offset + length
    return len(at)


def test_packing_like_all_packings():
    random.seed(1)
    worse = 0
    for _ in range(300):
        capacity = random.choice([7, 12, 30])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(1, 9))]
        least, got = fewest(lengths, capacity), placed(lengths, capacity)
        assert least <= got <= least + 1
        worse += got > least
    assert worse <= 15


def test_packing_takes_exact_complements():
    assert placed([9, 1, 5, 5, 4, 3, 3, 6, 2, 2], 10) == 4  # pairs and triples that fill a sequence to the last place
    assert placed([7, 2, 1] * 40 + [5, 3, 2] * 11, 10) == 51


def test_language_like_sizes_one_by_one():
    """Each block's size under each dictionary, added up by hand, with compressors made anew for every block."""
    random.seed(2)
    words = {lang: ["".join(random.choices(letters, k=random.randint(2, 7))) for _ in range(80)] for lang, letters in (("a", "abcdefghij"), ("b", "fghijklmno"), ("c", "éèçabcdxyz"))}
    text = lambda lang, n: " ".join(random.choices(words[lang], k=n))
    learned = {lang: text(lang, 3000).encode() for lang in words}
    classify = langid.Classifier(learned)
    shared = {"min_match": 4, "window_log": 18, "hash_log": 17, "chain_log": 17, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    ways = [zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=8, search_log=1, **shared), zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, target_length=32, search_log=8, **shared)]

    def size(data, lang, way):
        total = 0
        for lo in range(0, len(data), langid.BLOCK_BYTES):
            d = zstandard.ZstdCompressionDict(learned[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=way)
            total += len(zstandard.ZstdCompressor(dict_data=d, compression_params=way).compress(data[lo : lo + langid.BLOCK_BYTES] + langid.PAD))
        return total

    hits = 0
    for k in range(40):
        lang = random.choice("abc")
        t = text(lang, random.choice([3, 40, 1500])) if k % 5 else text("a", 20) + " " + text("b", 20)
        for way in ways:
            sizes = sorted((size(t.lower().encode(), x, way), x) for x in learned)
            margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
            if margin >= langid.CLOSE:
                break
        found, score, got = classify(t)
        assert (found, got) == (sizes[0][1], margin) and 0.5 <= score <= 1
        hits += found == lang or not k % 5
    assert hits >= 38


def best_cut(rows, bins, leaf_gain):
    """(gain, cut) by trying each cut of bins in turn, over rows (bin, residual, weight); the first of equal ones."""
    whole = leaf_gain(rows)
    found = (0.0, 0)
    for at in range(1, bins):
        gain = leaf_gain([r for r in rows if r[0] < at]) + leaf_gain([r for r in rows if r[0] >= at]) - whole
        if gain > found[0] + 1e-12:
            found = gain, at
    return found


def leaf_gain(rows):
    return sum(g for _, g, _ in rows) ** 2 / (sum(h for _, _, h in rows) + 1)


def leaves(rows, lo, hi, depth):
    """bin -> value of a tree of that depth, each cut found by exhaustion."""
    gain, at = best_cut([(b - lo, g, h) for b, g, h in rows], hi - lo, leaf_gain) if depth and hi - lo > 1 else (0.0, 0)
    if gain <= 1e-9:
        return dict.fromkeys(range(lo, hi), sum(g for _, g, _ in rows) / (sum(h for _, _, h in rows) + 1))
    at += lo
    return leaves([r for r in rows if r[0] < at], lo, at, depth - 1) | leaves([r for r in rows if r[0] >= at], at, hi, depth - 1)


def test_quality_fit_like_exhaustive_cuts():
    """The tables of single features refitted row by row, with every cut tried; pairs must then only lower the loss."""
    rng = np.random.default_rng(3)
    n, width = 40, len(quality.FEATURES)
    x = rng.standard_normal((n, width)).round(1)
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + 0.3 * rng.standard_normal(n) > 0).astype(float)
    model = quality.fit(x, y)
    bins = np.array([[sum(e <= v for e in model.edges[f]) for f, v in enumerate(row)] for row in x])
    assert (bins == model.bins(x)).all()
    p = (y.sum() + 1) / (n + 2)
    z = [float(np.log(p / (1 - p)))] * n
    tables = np.zeros((width, quality.BINS))
    for _ in range(quality.ROUNDS):
        for f in range(width):
            q = [1 / (1 + np.exp(-v)) for v in z]
            rows = [(bins[i, f], y[i] - q[i], q[i] * (1 - q[i])) for i in range(n)]
            value = leaves(rows, 0, quality.BINS, 2)
            for b, v in value.items():
                tables[f, b] += quality.RATE * v
            z = [z[i] + quality.RATE * value[bins[i, f]] for i in range(n)]
    assert np.allclose(tables, model.tables, atol=1e-6)
    loss = lambda s: -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))
    assert loss(model.score(x)) <= loss(1 / (1 + np.exp(-np.array(z)))) + 1e-9
