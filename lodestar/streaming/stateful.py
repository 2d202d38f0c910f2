"""Keyed states that live for a time: value, list and map state in RocksDB, with time to live and timers.

Each is a processor for ``transformWithStateInPandas``. Rows of a key come in the order in which they arrive, so
sources should deliver them by time; within a batch of rows they are put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
SESSION_TTL_MS, WIZARD_TTL_MS, LEAST_WIZARD_MS = 30 * DAY_MS, 600_000, 60_000


def with_rocks(spark: SparkSession) -> None:
    """State with several values and time to live needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Counter(StatefulProcessor):
    """Adds up deltas; at the threshold the total is told and the counter deleted, so that it starts from nothing."""

    def __init__(self, key: str, order: str, threshold: int):
        self.key, self.order, self.threshold = key, order, threshold

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for frame in rows:
            for at, delta in frame.sort_values(self.order)[[self.order, "delta_"]].itertuples(index=False):
                n += int(delta)
                if n >= self.threshold:
                    out.append((key[0], at, n))
                    n = 0
        if n:
            self.count.update((n,))
        else:
            self.count.clear()
        if out:
            yield pd.DataFrame(out, columns=[self.key, self.order, "total"])


class Session(StatefulProcessor):
    """The last turns of a session, its settings, and what its next text is asked for.

    Rows have ``kind``: ``turn`` (name: role, value: text), ``set`` (name, value), ``clear`` (name) or ``ask`` (value, and
    ``ttl_ms`` if it isn't the usual). Any change lets the whole session live for the time to live anew; what is asked
    for ends by itself.
    """

    def __init__(self, key: str, order: str, most: int, ttl_ms: int, ask_ttl_ms: int, least_ask_ms: int):
        self.key, self.order, self.most, self.ttl_ms, self.ask_ttl_ms, self.least_ask_ms = key, order, most, ttl_ms, ask_ttl_ms, least_ask_ms

    def init(self, handle) -> None:
        self.turns = handle.getListState("turns", "role string, text string", self.ttl_ms)
        self.settings = handle.getMapState("settings", "name string", "value string", self.ttl_ms)
        self.asked = handle.getValueState("asked", "value string, until long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        turns = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        settings = {k[0]: v[0] for k, v in self.settings.iterator()} if self.settings.exists() else {}
        asked = tuple(self.asked.get()) if self.asked.exists() else None
        for frame in rows:
            for kind, name, value, ttl in frame.sort_values(self.order)[["kind", "name", "value", "ttl_ms"]].itertuples(index=False):
                if kind == "turn":
                    turns = [*turns, (name, value or "")][-self.most :]
                elif kind == "set" and (value or "").strip():
                    settings[name] = value.strip()
                elif kind in ("set", "clear"):
                    settings.pop(name, None)
                    asked = None if name == "ask" else asked
                elif kind == "ask":
                    asked = value, now + int(max(self.least_ask_ms, self.ask_ttl_ms if pd.isna(ttl) else ttl))
        asked = asked if asked and asked[1] >= now else None
        self.turns.clear()
        if turns:
            self.turns.put(turns)
        self.settings.clear()
        for name, value in settings.items():
            self.settings.updateValue((name,), (value,))
        if asked:
            self.asked.update(asked)
        else:
            self.asked.clear()
        context = [t for r, t in turns if r in ("user", "assistant")]
        yield pd.DataFrame({self.key: [key[0]], "turns": [context], "settings": [settings], "asked": [asked[0] if asked else None]})


class Pending(StatefulProcessor):
    """Items wait, at most ``most``, until an event takes all, or until a timer finds them left for the time to live."""

    def __init__(self, key: str, item: str, time: str, taking: str, most: int, ttl_ms: int):
        self.key, self.item, self.time, self.taking, self.most, self.ttl_ms = key, item, time, taking, most, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "item string")
        self.until = handle.getValueState("until", "t long")

    def _shown(self, key, at, items: list[str], expired: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "at": [at], "items": [items], "expired": [expired]})

    def _held(self) -> list[str]:
        return [x[0] for x in self.items.get()] if self.items.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, until = self._held(), self.until.get()[0] if self.until.exists() else None
        out = []
        for frame in rows:
            for at, item, taking in frame.sort_values([self.time, self.item])[[self.time, self.item, self.taking]].itertuples(index=False):
                t = at.value // 1_000_000
                if held and t > until:
                    out.append(self._shown(key, None, held, True))
                    held = []
                if taking:
                    out.append(self._shown(key, str(item), held, False))
                    held = []
                elif len(held) < self.most:
                    held, until = [*held, str(item)], t + self.ttl_ms
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.items.clear()
        self.until.clear()
        if held:
            self.items.put([(x,) for x in held])
            self.until.update((until,))
            self.handle.registerTimer(until)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        self.items.clear()
        self.until.clear()
        if held:
            yield self._shown(key, None, held, True)


def counters(events: DataFrame, key: str, delta: str, order: str, threshold: int) -> DataFrame:
    """(key, order, total): a row whenever a key's deltas have come to the threshold."""
    with_rocks(events.sparkSession)
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}
    rows = events.selectExpr(f"`{key}`", f"`{order}`", f"cast(`{delta}` as long) AS delta_")
    return rows.groupBy(key).transformWithStateInPandas(Counter(key, order, threshold), f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, total long", "Append", "None")


def sessions(events: DataFrame, key: str, order: str, most: int = 10, ttl_ms: int = SESSION_TTL_MS, ask_ttl_ms: int = WIZARD_TTL_MS, least_ask_ms: int = LEAST_WIZARD_MS) -> DataFrame:
    """(key, turns, settings, asked): each session's state after a batch that changed it; see ``Session`` for the rows it reads."""
    with_rocks(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    rows = events.selectExpr(f"`{key}`", f"`{order}`", "kind", "name", "value", "cast(ttl_ms as long) AS ttl_ms")
    processor = Session(key, order, most, ttl_ms, ask_ttl_ms, least_ask_ms)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, turns array<string>, settings map<string,string>, asked string", "Update", "ProcessingTime")


def pending(events: DataFrame, key: str, item: str, time: str, taking: str, most: int = 3, ttl_seconds: int = 120, delay: str = "0 seconds") -> DataFrame:
    """(key, at, items, expired): what waited for each event that takes all, and what was left until it expired."""
    with_rocks(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, item, time, taking).withWatermark(time, delay)
    processor = Pending(key, item, time, taking, most, ttl_seconds * 1000)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, at string, items array<string>, expired boolean", "Append", "EventTime")
