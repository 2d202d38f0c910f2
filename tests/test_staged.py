import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import chain
from lodestar.operators import selected as chosen
from lodestar.streaming import staged


def base(spark):
    rows = [(i, f"k{i % 3}", [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2), i / 100]) for i in range(60)]
    points = spark.createDataFrame(rows, "id long, kb_id string, vec array<double>")
    portraits = points.groupBy("kb_id").agg(F.first("vec").alias("vec")).withColumn("cluster", F.lit(0))
    terms = points.select("id", "kb_id", F.concat(F.lit("t"), F.col("id") % 5).alias("token"), F.lit(1).alias("weight"))
    terms_of = lambda q: q.select("query_id", F.explode(F.split("refined_query", " ")).alias("token"), F.lit(1).alias("weight"))
    return staged.Retrieval(points, terms, portraits, terms_of, lambda c: c.limit(0).select("query_id", F.lit("").alias("answer")))


ASKED = "query_id long, text string, query_vec array<double>"


def test_each_question_is_told_in_stages(spark):
    questions = spark.createDataFrame([(1, " t1 架构图 ", [1.0, 0.0, 0.0, 0.1]), (2, None, None)], ASKED)
    got = {(r["query_id"], r["stage"]): json.loads(r["payload"]) for r in base(spark).stages(questions).collect()}
    assert {s for q, s in got if q == "1"} == {s for q, s in got if q == "2"} == set(staged.STAGES)
    assert got["1", "routing"]["target_kbs"][0]["id"] == "k0" and not got["1", "routing"]["fallback_search"]
    assert got["1", "intent"]["refined_query"] == "t1 架构图" and got["1", "retrieval"]["sparse_keywords"] == ["t1", "架构图"]
    results = got["1", "result"]["results"]
    assert [r["position"] for r in results] == list(range(1, len(results) + 1)) and len(results) == got["1", "retrieval"]["reranked_count"] == 10
    assert all(r["id"] % 3 == 0 for r in results)
    assert got["2", "routing"] == {"target_kbs": [], "fallback_search": True} and got["2", "result"] == {"results": []}


class Died(Exception):
    pass


def test_a_killed_batch_is_told_once(spark, tmp_path, monkeypatch):
    retrieval, path = base(spark), str(tmp_path)
    ask = lambda *ids: spark.createDataFrame([(i, f"t{i}", [1.0, 0.0, 0.0, 0.0]) for i in ids], ASKED).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = lambda: spark.readStream.schema(ASKED).parquet(f"{path}/in")
    ledger = staged.Ledger(spark, f"{path}/told")
    assert ledger.read().count() == 0
    ask(1, 2)
    staged.start(stream(), retrieval, path).awaitTermination(100)
    assert sorted({r["query_id"] for r in ledger.read().collect()}) == ["1", "2"]
    ask(3)
    commit = staged.Ledger.commit
    monkeypatch.setattr(staged.Ledger, "commit", lambda *_: (_ for _ in ()).throw(Died()))
    with pytest.raises(Exception, match="Died"):
        staged.start(stream(), retrieval, path).awaitTermination(100)
    assert sorted({r["query_id"] for r in ledger.read().collect()}) == ["1", "2"]  # written, but not whole
    monkeypatch.setattr(staged.Ledger, "commit", commit)
    staged.start(stream(), retrieval, path).awaitTermination(100)
    rows = ledger.read().collect()
    assert len(rows) == 3 * len(staged.STAGES) and {r["batch"] for r in rows if r["query_id"] == "3"} == {1}
    before = rows
    ledger.write(spark.createDataFrame([("9", 1, "intent", "{}")], staged.ROWS_SCHEMA), 1)  # a replay after the entry
    assert sorted(map(tuple, ledger.read().collect())) == sorted(map(tuple, before))


def test_answers_are_joined_by_position(spark):
    coarse = spark.createDataFrame([(q, 10 * q + i, "doc", 1.0 - i / 10, i + 1) for q in (1, 2, 3) for i in range(3)], "query_id long, id long, content_type string, total double, place int")
    said = [(1, '{"results": [{"index": 2, "relevance_score": 0.9}, {"index": 0, "score": 0.3}, {"index": 2, "relevance_score": 0.1}]}'), (2, '[{"score": 0.5}, {"relevance": 0.4}]')]
    got = {r["id"]: r["ce"] for r in chain.cross_scored(coarse, spark.createDataFrame(said, "query_id long, answer string")).collect()}
    assert got == {10: 0.3, 11: 0.0, 12: 0.9, 20: 0.5, 21: 0.4, 22: 0.0, 30: 1.0, 31: 0.9, 32: 0.8}


def test_fusions_differ_and_are_named(spark):
    hits = spark.createDataFrame([(1, 1, "k", 0.9, 0, "dense"), (1, 2, "k", 0.8, 1, "dense"), (1, 2, "k", 7.0, 0, "sparse"), (1, 3, "k", 5.0, 1, "sparse")], "query_id long, id long, kb_id string, score double, rank int, route string")
    raw = {r["id"]: (r["total"], r["place"]) for r in chain.candidates(hits).collect()}
    assert raw == {3: (5.0, 1), 1: (0.9, 2), 2: (0.8, 3)}
    rrf = {r["id"]: r["place"] for r in chain.candidates(hits, fusion="rrf").collect()}
    assert rrf == {2: 1, 1: 2, 3: 3}
    with pytest.raises(ValueError, match="fusion"):
        chain.candidates(hits, fusion="sum")


def test_selected_files_fall_back(spark):
    points = spark.createDataFrame([(1, "k", "f", None, 1), (2, "k", "f", "f", 0), (3, "k", "g", "f", 2), (4, "m", "h", None, 0), (5, "m", None, "i", None)], "id long, kb_id string, file_id string, source_file_id string, chunk_index int")
    rows = [(1, 0, "k", "f", "doc", "p"), (1, 1, "k", "h", "doc", "p"), (1, 2, "k", "none", "doc", "shown"), (1, 3, "k", "none", "doc", "  "), (1, 4, None, "i", "image", None), (1, 8, "k", "f", "doc", "p"), (2, 7, "m", "f", "image", "")]
    got = chosen.candidates(spark.createDataFrame(rows, "query_id int, nth int, kb_id string, file_id string, kind string, preview string"), points).collect()
    assert sorted((r["query_id"], r["id"], r["item"], r["score"], r["origin"]) for r in got) == [
        (1, "1", 1, 0.99, "kb"), (1, "2", 0, 1.0, "kb"), (1, "4", 0, 0.97, "any"), (1, "5", 0, 0.88, "any"), (1, "selected:none", 0, 0.94, "preview"), (2, "2", 0, 0.82, "any"),
    ]
