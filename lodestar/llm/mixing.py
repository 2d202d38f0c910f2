"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded documents.

Documents are summed up by pattern, the set of sources they belong to. Targets follow from weights, bounded by what
repeating a source allows. The flow takes tokens from patterns to the quotas of their sources; a pattern's further
repetitions cost more than its first, in STEPS steps a copy, so that nothing is repeated before what fits is used
once and patterns of a source are used evenly.

Within a pattern, documents stand in the order of a seeded hash of id and size, lap after lap. A quota ends at a place on
this line. The bucket of hashes that holds the place comes from a histogram by pattern; only its documents are put in
order, all others are told by their bucket. At the end of a pattern's use, documents of that bucket are taken in order
as they fit, so that what is missing is less than each of those left out.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, materialize

WEIGHTS, SHARE, MOST, STEPS, SEED = (3, 1, 2), Fraction(3, 2), 2, 4, 13
MOST_PATTERNS, BUCKET_ROWS, MOST_BITS = 100_000, 512, 16
CHUNK_ROWS = 65_536
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], total: Fraction, most: int) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is above goes to the others by weight."""
    out, left, rest = [Fraction(0)] * len(sizes), Fraction(total), sum(weights)
    for i in sorted(range(len(sizes)), key=lambda i: Fraction(sizes[i], weights[i])):  # those that reach their bound first
        out[i] = min(Fraction(most * sizes[i]), left * weights[i] / rest)
        left, rest = left - out[i], rest - weights[i]
    return out


def route(patterns: list[tuple[list[int], int]], quotas: list[int], most: int = MOST, steps: int = STEPS) -> list[dict[int, int]]:
    """For each pattern (sources, tokens) the tokens that each of its sources takes, of least cost among the largest flows.

    Costs lie on the steps of a pattern's use alone and grow, so the cheapest step that still reaches a quota comes
    first: all steps of one cost are opened at once and augmented until no path is left.
    """
    quota, flow = list(quotas), [dict.fromkeys(members, 0) for members, _ in patterns]
    users: list[list[int]] = [[] for _ in quotas]
    for p, (members, _) in enumerate(patterns):
        for s in members:
            users[s].append(p)
    for level in range(most * steps):
        supply = [c * (level % steps + 1) // steps - c * (level % steps) // steps for _, c in patterns]
        for p, (members, _) in enumerate(patterns):
            for s in members:
                n = min(supply[p], quota[s])
                flow[p][s], supply[p], quota[s] = flow[p][s] + n, supply[p] - n, quota[s] - n
        while True:
            queue = deque(("p", p) for p in range(len(patterns)) if supply[p])
            came: dict = dict.fromkeys(queue)
            end = None
            while queue and end is None:
                kind, i = at = queue.popleft()
                if kind == "s" and quota[i]:
                    end = at
                for x in [("s", s) for s in flow[i]] if kind == "p" else [("p", p) for p in users[i] if flow[p][i]]:
                    if x not in came:
                        came[x] = at
                        queue.append(x)
            if end is None:
                break
            path = [end]
            while came[path[-1]]:
                path.append(came[path[-1]])
            path.reverse()
            steps_on = list(zip(path, path[1:], strict=False))
            n = min([supply[path[0][1]], quota[end[1]], *(flow[b[1]][a[1]] for a, b in steps_on if a[0] == "s")])
            supply[path[0][1]] -= n
            quota[end[1]] -= n
            for a, b in steps_on:
                if a[0] == "p":
                    flow[a[1]][b[1]] += n
                else:
                    flow[b[1]][a[1]] -= n
    return flow


def _fill(edge: pd.DataFrame, bounds: list[tuple[int, int, int]]) -> list[list[tuple[int, list[int]]]]:
    """For each group of equal rows of ``edge``, in order: (rows, copies up to each bound), the rows split where copies differ.

    A bound is (lap, bucket, words of the lap before its bucket and up to the bound). At the last one documents are
    taken as they fit, at the others a copy belongs to the bound before which it begins.
    """
    counts = []
    for j, (lap, bucket, left) in enumerate(bounds):
        last, at, own = j == len(bounds) - 1, 0, []
        for b, size, m in zip(edge["bucket"], edge["size"], edge["m"], strict=True):
            if b != bucket:
                k = m if b < bucket else 0
            elif last:
                k = int(min(m, left // size)) if size else m
                left -= k * size
            else:
                k = int(min(m, max(0, -(-(left - at) // size)))) if size else m * (at < left)
                at += m * size
            own.append((lap, int(k)))
        counts.append(own)
    out = []
    for g, m in enumerate(edge["m"]):
        cuts = sorted({0, int(m), *(c[g][1] for c in counts)})
        out.append([(b - a, [c[g][0] + (a < c[g][1]) for c in counts]) for a, b in zip(cuts, cuts[1:], strict=False)])
    return out


def mix(
    docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE,
    most: int = MOST, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """A row per document (``id_col``, ``sources``, ``size``, ``copies``, ``taken``, ``uses``), and one per source
    (``source``, ``source_size``, ``target``).

    ``sources`` is an array; null in it is a source like any, listed last. Sources take the weights in the order of
    their code points, over and over. A null or empty array belongs to none and isn't taken. ``uses`` has the copies
    that each source took. Null and empty text has size 0 and takes 0 words, in copies as its order says. Very long
    texts are counted whole and taken whole or not at all. Of rows that repeat an id, size and sources each counts and
    is taken by itself; which of them doesn't matter, as they give equal rows. The result depends on ids, sizes, sources
    and seed, not on how rows lie. An empty table gives two empty results. Other columns aren't read. There may be
    MOST_PATTERNS patterns, a row of each is held by the driver; more is an error.
    """
    spark, scratch = docs.sparkSession, Scratch()
    own = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    sized = docs.select(F.col(id_col).alias("_id"), own.alias("_own"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"))
    sized = sized.withColumn("_key", F.to_json("_own")).withColumn("_u", F.xxhash64(F.lit(seed), "_id", "_size", "_key"))
    sized = scratch(sized, "mixing-sizes")

    found = sized.groupBy("_key").agg(F.first("_own").alias("own"), F.count(F.lit(1)).alias("n"), F.sum("_size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources: merge rare sources first")
    found = sorted(found, key=lambda r: r["_key"])
    names = sorted({s for r in found for s in r["own"]}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for s in r["own"]:
            sizes[number[s]] += r["size"]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(r["size"] for r in found if r["own"]), most)
    flow = route([([number[s] for s in r["own"]], r["size"]) for r in found], [int(t + Fraction(1, 2)) for t in wanted], most)

    bits = [min(MOST_BITS, max(0, -(-r["n"] // BUCKET_ROWS) - 1).bit_length()) for r in found]
    places = []  # pattern, bits, bound, lap, place in the lap
    for r, b, f in zip(found, bits, flow, strict=True):
        at = 0
        for j, s in enumerate(sorted(f)):
            at += f[s]
            lap, place = divmod(at, r["size"]) if r["size"] else (0, 0)
            places.append((r["_key"], b, j, lap, place, names[s]))
    table = spark.createDataFrame(places, "_key string, _bits int, _bound int, _lap long, _place long, _source string")
    kinds = table.select("_key", "_bits").distinct()
    bucket = F.when(F.col("_bits") > 0, F.expr("shiftrightunsigned(_u, 64 - _bits)")).otherwise(F.lit(0).cast("long"))
    binned = sized.join(F.broadcast(kinds), "_key").withColumn("_bucket", bucket)

    upto = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = binned.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_words")).withColumn("_before", F.sum("_words").over(upto) - F.col("_words"))
    inside = (F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_words"))
    met = histogram.join(F.broadcast(table), "_key").filter(inside).select("_key", "_bound", "_bucket", (F.col("_place") - F.col("_before")).alias("_left"))
    bounds = table.join(met, ["_key", "_bound"], "left").groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct("_bound", "_lap", F.coalesce("_bucket", F.lit(-1).cast("long")).alias("_bucket"), F.coalesce("_left", F.lit(0).cast("long")).alias("_left"), "_source"))).alias("_bounds")
    )
    bounds = scratch(bounds, "mixing-bounds")  # a row per pattern
    placed = binned.join(F.broadcast(bounds), "_key").withColumn("_edge", F.exists("_bounds", lambda b: b["_bucket"] == F.col("_bucket")))
    upto_each = F.transform("_bounds", lambda b: (b["_lap"] + (b["_bucket"] > F.col("_bucket")).cast("long")))
    plain = placed.filter(~F.col("_edge")).select("_id", "_own", "_size", upto_each.alias("_upto"), F.transform("_bounds", lambda b: b["_source"]).alias("_names"))

    edge = placed.filter("_edge").groupBy("_key", "_u", "_id", "_size", "_bucket").agg(F.count(F.lit(1)).alias("m"), F.first("_own").alias("_own"))
    edge = edge.join(F.broadcast(bounds), "_key")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_bucket", "_u", "_id", "_size"], na_position="first", kind="stable").reset_index(drop=True)
        plan = [(b["_lap"], b["_bucket"], b["_left"]) for b in group["_bounds"][0]]
        parts = _fill(pd.DataFrame({"bucket": group["_bucket"], "size": group["_size"], "m": group["m"]}), plan)
        rows = [(g, n, upto) for g, own_parts in enumerate(parts) for n, upto in own_parts if n]
        out = group.loc[[g for g, _, _ in rows], ["_id", "_own", "_size"]].reset_index(drop=True)
        out["n"], out["_upto"] = [n for _, n, _ in rows], [u for _, _, u in rows]
        out["_names"] = [[b["_source"] for b in group["_bounds"][0]]] * len(rows)
        return out

    kind = sized.schema["_id"].dataType.simpleString()
    # nullable ids would turn into floats in pandas, so they go in and out as strings
    edge = edge.withColumn("_id", F.col("_id").cast("string"))
    split = edge.groupBy("_key").applyInPandas(fill, "_id string, _own array<string>, _size long, n long, _upto array<long>, _names array<string>")
    # a group of equal rows may hold a third of all: its rows are made by many tasks
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK_ROWS)))
    chunks = scratch(split, "mixing-edges").withColumn("_chunk", chunk)
    chunks = chunks.repartition("_id", "_size", "_chunk").withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK_ROWS), F.col("n") - F.col("_chunk") * CHUNK_ROWS))))
    rows = plain.unionByName(chunks.select(F.col("_id").cast(kind).alias("_id"), "_own", "_size", "_upto", "_names"))
    none = sized.filter(F.size("_own") == 0).select("_id", "_own", "_size", F.array().cast("array<long>").alias("_upto"), F.array().cast("array<string>").alias("_names"))
    rows = rows.unionByName(none)

    copies = F.coalesce(F.try_element_at("_upto", F.lit(-1)), F.lit(0).cast("long"))
    capped = F.transform("_upto", lambda x: F.least(x, F.col("copies")))
    ends = F.transform("_capped", lambda x, i: x - F.when(i > 0, F.get("_capped", i - 1)).otherwise(F.lit(0)))
    rows = rows.withColumn("copies", copies).withColumn("_capped", capped).withColumn("_each", ends)
    uses = F.filter(F.transform("_names", lambda s, i: F.struct(s.alias("source"), F.get("_each", i).alias("copies"))), lambda x: x["copies"] > 0)
    out = rows.select(F.col("_id").alias(id_col), F.col("_own").alias("sources"), F.col("_size").alias("size"), "copies", (F.col("copies") * F.col("_size")).alias("taken"), uses.alias("uses"))
    out = materialize(out, "mixing")
    scratch.clear()
    return out, spark.createDataFrame([(s, n, float(t)) for s, n, t in zip(names, sizes, wanted, strict=True)], "source string, source_size long, target double")


def mix_by_source(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Documents of one source each: the id, ``size``, ``source_size``, ``target``, ``taken``; null is a source of its own."""
    rows, sources = mix(docs, F.array(F.col(source_col).cast("string")), id_col)
    own = F.col("sources")[0].eqNullSafe(F.col("source"))
    return rows.join(F.broadcast(sources), own).select(id_col, "size", "source_size", "target", "taken")
