"""Streams: counters that fire, duplicates within a time, pending items, session state and event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.streaming import stateful

THRESHOLD, DEDUP_TTL, PENDING_TTL = 50, "10 minutes", "120 seconds"


def sequential(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Each key's rows in order through ``step(state, row) -> (state, rows out)``, the state begun by ``start()``.

    A key's rows stream through one task, which holds its state alone; what order rows have within a key can't be divided.
    """
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *order)
    at = rows.columns.index(key)
    target = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[at] != now:
                    now, state = row[at], start()
                state, found = step(state, row)
                out += found
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return sorted_rows.mapInArrow(run, schema)


def counter_triggers(events: DataFrame, key: str, delta: str, order: list[str], threshold: int = THRESHOLD) -> DataFrame:
    """(key, order, total): a row whenever a key's deltas, summed in order, come to the threshold; the counter is deleted then.

    Streams take their order from the first of ``order``.
    """
    if events.isStreaming:
        return stateful.counters(events, key, delta, order[0], threshold)
    kinds = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in (key, *order))

    def step(n: int, row: tuple) -> tuple[int, list]:
        n += row[-1] or 0
        return (0, [(*row[:-1], n)]) if n >= threshold else (n, [])

    return sequential(events.select(key, *order, F.col(delta).cast("long")), key, order, int, step, f"{kinds}, total long")


def deduplicated(events: DataFrame, key: str, time: str, ttl: str = DEDUP_TTL) -> DataFrame:
    """The first event of each key within the time to live."""
    return events.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def pending(events: DataFrame, key: str, time: str, item: str, most: int = 3, ttl: str = PENDING_TTL) -> DataFrame:
    """Items of a key that came without a longer pause: their number, and the first few."""
    late = events.withWatermark(time, ttl) if events.isStreaming else events
    g = late.groupBy(key, F.session_window(time, ttl).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.least("n", F.lit(most)).alias("taken"), "n", "first")


def windows(events: DataFrame, time: str, length: str, slide: str | None = None, keys: tuple[str, ...] = (), delay: str = "10 minutes") -> DataFrame:
    """Counts over tumbling or sliding windows; later events than the delay are dropped by the watermark."""
    late = events.withWatermark(time, delay) if events.isStreaming else events
    g = late.groupBy(F.window(time, length, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


STAGES = ["connected", "intent", "routing", "retrieval", "message", "citation", "complete"]


def staged(queries: DataFrame, cites) -> DataFrame:
    """A row per stage of each query, numbered in the order in which clients are told; ``citation`` only where something is cited."""
    rows = queries.withColumn("_cites", cites).select("*", F.posexplode(F.lit(STAGES)).alias("place", "stage"))
    return rows.withColumn("place", F.col("place") + 1).filter(F.col("_cites") | (F.col("stage") != "citation")).drop("_cites")


def latest(updates: DataFrame, key: str, order: list[str], fields: dict) -> DataFrame:
    """(key, fields): each field's last value that isn't null, or its default. Partial maxima, so it runs as a stream too."""
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct(*order, F.col(f).alias("_v")))).alias(f) for f in fields]
    return updates.groupBy(key).agg(*last).select(key, *[F.coalesce(F.col(f"{f}._v"), F.lit(default)).alias(f) for f, default in fields.items()])


def within(begun, now, seconds: int):
    """Whether no more than that many seconds lie between."""
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(begun.cast("timestamp")) <= seconds * 1_000_000


def alive(rows: DataFrame, time: str, now, seconds: int) -> DataFrame:
    """Rows that aren't older than their time to live."""
    return rows.filter(within(F.col(time), now, seconds))


def taken(events: DataFrame, key: str, item: str, time: str, taking: str, most: int = 3, ttl_seconds: int = 120) -> DataFrame:
    """(key, at, items): what waits for each event that takes all. Other events wait, at most ``most`` of them, until a pause
    longer than the time to live. A stream holds what waits as state, and tells what expired as well (``stateful.pending``)."""
    if events.isStreaming:
        told = stateful.pending(events, key, item, time, taking, most, ttl_seconds)
        return told.filter("NOT expired").select(key, "at", F.array_join("items", ",").alias("items"))
    kind, item_kind = (events.schema[c].dataType.simpleString() for c in (key, item))
    rows = events.select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.col(item).alias("_item"), F.col(taking).alias("_taking"))

    def step(state: tuple, row: tuple) -> tuple[tuple, list]:
        (held, until), (own, at, what, takes) = state, row
        held = held if until is None or at <= until else []
        if takes:
            return ([], until), [(own, what, ",".join(map(str, held)))]
        return (([*held, what], at + ttl_seconds * 1_000_000) if len(held) < most else (held, until)), []

    return sequential(rows, key, ["_t", "_item"], lambda: ([], None), step, f"`{key}` {kind}, at {item_kind}, items string")


def preferences(events: DataFrame, session: str, name: str, value: str, time: str, tie: str, ttl_seconds: int = 600) -> DataFrame:
    """(session, name, value): the last value of each setting, unless it was cleared (null) or lies further back than the
    time to live before the session's last event."""
    last = events.groupBy(session, name).agg(F.max(F.struct(time, tie, value)).alias("m"))
    alive = F.unix_micros(F.max(f"m.{time}").over(Window.partitionBy(session)).cast("timestamp")) - F.unix_micros(F.col(f"m.{time}").cast("timestamp"))
    kept = last.withColumn("rest", alive).filter((F.col("rest") <= ttl_seconds * 1_000_000) & F.col(f"m.{value}").isNotNull())
    return kept.select(session, name, F.col(f"m.{value}").alias(value))
