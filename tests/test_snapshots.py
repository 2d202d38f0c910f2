import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators.questions import QuestionStore
from lodestar.sources.snapshots import Conflict, SnapshotTable
from lodestar.streaming import progress

SCHEMA = "kb_id string, n int"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replace_read_and_pin(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), SCHEMA)
    assert t.read().count() == 0 and t.manifest()[0] == 0
    assert t.replace(rows(spark, ("a", 1), ("a", 2), ("b", 3), ("x/y=z %", 4), (None, 5))) == 1
    pinned = t.read()
    assert t.replace(rows(spark, ("a", 9)), ["b"]) == 2
    assert held(t.read()) == [("a", 9), ("x/y=z %", 4), (None, 5)]
    assert held(pinned) == held(t.read(1)) == sorted([("a", 1), ("a", 2), ("b", 3), ("x/y=z %", 4), (None, 5)], key=str)
    assert t.remove(["x/y=z %", None]) == 3 and held(t.read()) == [("a", 9)]
    assert t.vacuum(keep=1) == 2 and held(t.read()) == [("a", 9)] and t.versions() == [3]


def test_a_failed_replace_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, str(tmp_path / "t"), SCHEMA)
    t.replace(rows(spark, ("a", 1)))
    broken = rows(spark, ("a", 2)).withColumn("n", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        t.replace(broken)
    assert held(t.read()) == [("a", 1)] and t.versions() == [1]
    monkeypatch.setattr(SnapshotTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("died before the rename")))
    with pytest.raises(OSError):
        t.replace(rows(spark, ("a", 3)))
    monkeypatch.undo()
    assert held(t.read()) == [("a", 1)] and t.replace(rows(spark, ("a", 4))) == 2


def test_two_writers(spark, tmp_path):
    one, two = (SnapshotTable(spark, str(tmp_path / "t"), SCHEMA) for _ in range(2))
    one.replace(rows(spark, ("a", 1), ("b", 1)))
    base = two.manifest()[0]
    one.replace(rows(spark, ("a", 2)))
    assert two.replace(rows(spark, ("b", 2)), base=base) == 3 and held(two.read()) == [("a", 2), ("b", 2)]  # other keys
    with pytest.raises(Conflict, match="'a'"):
        two.replace(rows(spark, ("a", 3)), base=base)
    with pytest.raises(Conflict, match="taken"):
        two._commit(3, {"folders": {}, "changed": []})
    assert held(one.read()) == [("a", 2), ("b", 2)] and one.versions() == [1, 2, 3]
    calls = []

    def change(old):
        calls.append(1)
        if len(calls) == 1:
            one.replace(rows(spark, ("a", 10)))  # another writer between the read and the commit
        return old.withColumn("n", F.col("n") + 1)

    two.update(change, ["a"])
    assert len(calls) == 2 and held(two.read()) == [("a", 11), ("b", 2)]


def test_question_banks(spark, tmp_path):
    store = QuestionStore(spark, str(tmp_path / "bank"))
    new = lambda *qs: spark.createDataFrame([(kb, q, None, f, i) for i, (kb, q, f) in enumerate(qs)], "kb_id string, text string, kb_name string, file_id string, place long")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    store.add(new(("k", "1. 什么是检索。", "f1"), ("k", "什么是检索？", "f2"), ("k", " ", "f1"), ("m", "Other", None)), "upload", at(1000))
    got = store.table.read().collect()
    assert sorted((r["kb_id"], r["text"], r["file_id"], r["kb_name"], r["source"]) for r in got) == [("k", "什么是检索？", "f1", "k", "upload"), ("m", "Other？", None, "m", "upload")]
    assert all(len(r["id"]) == 16 for r in got)
    store.add(new(*[("k", f"q{i}", "f3") for i in range(5)], ("k", "什么是检索", "f9")), "refresh", at(5000), most=4)
    assert [r["text"] for r in store.table.read().filter("kb_id = 'k'").orderBy("place").collect()] == ["q1？", "q2？", "q3？", "q4？"]
    assert {r["kb_id"] for r in store.fresh(at(5500), 3600).collect()} == {"k"}
    store.remove_file("k", "f3")
    assert held(store.table.read().select("kb_id", "place")) == [("m", 1)]
    store.remove_kb("m")
    assert store.table.read().count() == 0


def test_running_counts_and_progress_rows(spark, tmp_path):
    told = progress.ProgressRows(spark, f"{tmp_path}/told", {"counted": 30})
    spark.streams.addListener(told)
    try:
        for batch, wanted in ((1, {("a", 10), ("b", 5)}), (2, {("a", 20), ("b", 10)})):
            spark.range(15).select(F.when(F.col("id") % 3 < 2, "a").otherwise("b").alias("kb")).coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
            stream = spark.readStream.schema("kb string").parquet(f"{tmp_path}/in/*")
            progress.running_counts(stream, ["kb"], f"{tmp_path}/counts", f"{tmp_path}/checkpoint", "counted").awaitTermination(60)
            assert set(map(tuple, progress.counts(spark, {"kb": "string"}, f"{tmp_path}/counts").collect())) == wanted
            until = time.time() + 60  # the end of a stream is told a little later than it comes
            while time.time() < until and spark.read.schema(progress.SCHEMA).json(f"{tmp_path}/told").filter("stage = 'completed'").count() < batch:
                time.sleep(0.3)
        bad = spark.readStream.schema("kb string").parquet(f"{tmp_path}/in/*").select(F.raise_error(F.lit("broke")).cast("string").alias("kb"))
        with pytest.raises(Exception, match="broke"):
            bad.writeStream.format("noop").queryName("bad").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination(60)
        until = time.time() + 60
        while time.time() < until and {r["query"]: r["stage"] for r in progress.status(spark, f"{tmp_path}/told").collect()} != {"counted": "completed", "bad": "failed"}:
            time.sleep(0.3)
    finally:
        spark.streams.removeListener(told)
    rows = spark.read.schema(progress.SCHEMA).json(f"{tmp_path}/told").orderBy("at").collect()
    counted = [(r["stage"], r["percent"], r["total"]) for r in rows if r["query"] == "counted"]
    assert [c[0] for c in counted if c[0] != "processing"] == ["initializing", "completed"] * 2
    assert ("processing", 50, 15) in counted and counted[-1][1] == 100
    last = {r["query"]: r for r in progress.status(spark, f"{tmp_path}/told").collect()}
    assert last["bad"]["percent"] == 0 and "broke" in last["bad"]["message"]
