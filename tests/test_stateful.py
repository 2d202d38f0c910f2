import time

import pytest

from lodestar.streaming import stateful


def ran(df, path, name, mode="append", expected=None):
    """Run a stream over all its files, from its checkpoint if there is one, and give this run's rows.

    Streams by processing time always have a next batch, so they run until ``expected`` rows have come.
    """
    rows = []
    writer = df.writeStream.foreachBatch(lambda batch, _: rows.extend(r.asDict() for r in batch.collect())).outputMode(mode)
    writer = writer.option("checkpointLocation", f"{path}/checkpoint-{name.split('_')[0]}")
    if expected is None:
        writer.trigger(availableNow=True).start().awaitTermination(60)
        return rows
    q, until = writer.start(), time.time() + 60
    while len(rows) < expected and time.time() < until and q.isActive:
        time.sleep(0.1)
    q.stop()
    return rows


def source(spark, path, rows, schema, batch):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{batch}")
    return spark.readStream.schema(schema).parquet(f"{path}/*")


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_counter_sums_deltas_and_is_deleted_on_firing(rocks, tmp_path):
    schema = "kb string, n long, delta int"
    rows = [("a", 1, 30), ("a", 2, 30), ("a", 3, 49), ("b", 4, 1), ("c", 5, 500)]
    events = source(rocks, tmp_path / "in", rows, schema, 1)
    got = ran(stateful.counters(events, "kb", "delta", "n", 50), tmp_path, "fired_1")
    assert sorted((r["kb"], r["n"], r["total"]) for r in got) == [("a", 2, 60), ("c", 5, 500)]  # nothing is carried over
    events = source(rocks, tmp_path / "in", [("a", 6, 1), ("b", 7, 48), ("c", 8, 49)], schema, 2)
    got = ran(stateful.counters(events, "kb", "delta", "n", 50), tmp_path, "fired_2")
    assert [(r["kb"], r["n"], r["total"]) for r in got] == [("a", 6, 50)]  # from the checkpoint: 49 and 1
    events = source(rocks, tmp_path / "in", [("b", 9, 1), ("c", 10, 0)], schema, 3)
    got = ran(stateful.counters(events, "kb", "delta", "n", 50), tmp_path, "fired_3")
    assert [(r["kb"], r["n"], r["total"]) for r in got] == [("b", 9, 50)]


def test_session_lives_on_and_expires(rocks, tmp_path):
    schema = "s string, n long, kind string, name string, value string, ttl_ms long"
    turns = [("x", i, "turn", ["user", "assistant", "system"][i % 3], f"t{i}", None) for i in range(14)]
    events = source(rocks, tmp_path / "in", [*turns, ("x", 20, "set", "kb", " k1 ", None), ("x", 21, "set", "upload", "k2", None), ("x", 22, "ask", None, "new name", 1), ("y", 1, "set", "kb", "k3", None)], schema, 1)
    options = {"most": 10, "ttl_ms": 8000, "ask_ttl_ms": 5, "least_ask_ms": 2500}
    got = {r["s"]: r for r in ran(stateful.sessions(events, "s", "n", **options), tmp_path, "session_1", "update", 2)}
    assert got["x"]["turns"] == [f"t{i}" for i in range(4, 14) if i % 3 != 2]  # the last ten, then those of users and assistants
    assert got["x"]["settings"] == {"kb": "k1", "upload": "k2"} and got["x"]["asked"] == "new name"
    assert got["y"]["settings"] == {"kb": "k3"} and got["y"]["turns"] == []
    time.sleep(3)
    events = source(rocks, tmp_path / "in", [("x", 30, "set", "kb", "  ", None), ("x", 31, "turn", "user", None, None)], schema, 2)
    got = {r["s"]: r for r in ran(stateful.sessions(events, "s", "n", **options), tmp_path, "session_2", "update", 1)}
    assert set(got) == {"x"} and got["x"]["settings"] == {"upload": "k2"} and got["x"]["turns"][-1] == "" and got["x"]["asked"] is None
    time.sleep(10)
    events = source(rocks, tmp_path / "in", [("x", 40, "turn", "user", "again", None), ("y", 41, "clear", "none", None, None)], schema, 3)
    got = {r["s"]: r for r in ran(stateful.sessions(events, "s", "n", **options), tmp_path, "session_3", "update", 2)}
    assert got["x"]["turns"] == ["again"] and got["x"]["settings"] == {} and got["y"]["settings"] == {}


def test_pending_items_are_taken_or_expire(rocks, tmp_path):
    schema = "s string, id long, ts timestamp, takes boolean"
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, s // 60, s % 60)
    rows = [("a", 1, at(0), False), ("a", 2, at(10), False), ("a", 3, at(20), False), ("a", 4, at(30), False), ("a", 5, at(40), True), ("b", 6, at(0), False), ("c", 7, at(0), True)]
    events = source(rocks, tmp_path / "in", rows, schema, 1)
    got = ran(stateful.pending(events, "s", "id", "ts", "takes"), tmp_path, "pending_1")
    assert sorted((r["s"], r["at"], r["items"], r["expired"]) for r in got) == [("a", "5", ["1", "2", "3"], False), ("c", "7", [], False)]
    events = source(rocks, tmp_path / "in", [("b", 8, at(300), True), ("d", 9, at(900), True)], schema, 2)
    got = ran(stateful.pending(events, "s", "id", "ts", "takes"), tmp_path, "pending_2")
    assert ("b", None, ["6"], True) in [(r["s"], r["at"], r["items"], r["expired"]) for r in got]
    assert [(r["at"], r["items"]) for r in got if r["s"] == "b" and not r["expired"]] == [("8", [])]
    events = source(rocks, tmp_path / "in", [("e", 10, at(901), False)], schema, 3)
    ran(stateful.pending(events, "s", "id", "ts", "takes"), tmp_path, "pending_3")
    events = source(rocks, tmp_path / "in", [("f", 11, at(2000), True)], schema, 4)
    got = ran(stateful.pending(events, "s", "id", "ts", "takes"), tmp_path, "pending_4")
    got += ran(stateful.pending(source(rocks, tmp_path / "in", [("f", 12, at(2001), True)], schema, 5), "s", "id", "ts", "takes"), tmp_path, "pending_5")
    assert ("e", None, ["10"], True) in [(r["s"], r["at"], r["items"], r["expired"]) for r in got]  # by its timer
