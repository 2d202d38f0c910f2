"""Questions as a stream: each batch goes through intent, routing, retrieval and result, and no batch is told twice.

A batch writes its stage rows to a folder of its own, and then its id to the ledger. Readers take only batches that the
ledger has. A batch that died before its ledger entry is replayed by Spark and overwrites what it had written; one
that is replayed after it is left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import chain
from lodestar.session import exists, saved

STAGES = ["intent", "routing", "retrieval", "result", "complete"]
ROWS_SCHEMA, LEDGER_SCHEMA = "query_id string, place int, stage string, payload string", "batch long"


def payload(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


class Retrieval:
    """What a question is held against: points (id, kb_id, vec), terms (id, kb_id, token, weight), portraits (kb_id, cluster, vec).

    ``terms_of`` gives (query_id, token, weight) of questions, ``answers_of`` what the cross-encoder says of candidates.
    """

    def __init__(
        self, points: DataFrame, terms: DataFrame, portraits: DataFrame, terms_of: Callable[[DataFrame], DataFrame],
        answers_of: Callable[[DataFrame], DataFrame] | None = None, kinds: DataFrame | None = None, fusion: str = "raw",
    ):
        self.points, self.terms, self.portraits, self.terms_of = points, terms, portraits, terms_of
        self.answers_of, self.kinds, self.fusion = answers_of, kinds, fusion

    def stages(self, questions: DataFrame) -> DataFrame:
        """questions (query_id, text, query_vec) -> query_id, place, stage, payload: five rows a question, in the order in which it is told.

        A question without a vector is searched by no route: its routing falls back and its result is empty.
        """
        asked = saved(chain.prepared(questions), "questions")
        scope = chain.routed(asked.filter("query_vec IS NOT NULL"), self.portraits, self.points.select("kb_id").distinct())
        coarse = saved(chain.candidates(chain.searched(scope, self.points, self.terms_of(asked), self.terms), self.kinds, self.fusion), "coarse")
        answers = self.answers_of(coarse) if self.answers_of else coarse.sparkSession.createDataFrame([], f"query_id {coarse.schema['query_id'].dataType.simpleString()}, answer string")
        final = saved(chain.cut(chain.cross_scored(coarse, answers), asked.filter("visual_intent = 'implicit_enrichment'")), "final")

        kbs = scope.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("norm").alias("score"), F.col("kb_id").alias("id"))), False).alias("target_kbs"))
        found = coarse.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_found"))
        kept = final.groupBy("query_id").agg(F.count(F.lit(1)).alias("reranked_count"), F.sort_array(F.collect_list(F.struct("position", "id", "final"))).alias("results"))
        every = asked.join(kbs, "query_id", "left").join(found, "query_id", "left").join(kept, "query_id", "left").fillna(0, ["total_found", "reranked_count"])
        none = F.coalesce("results", F.array().cast("array<struct<position:int,id:long,final:double>>"))
        rows = [
            payload(F.col("text").alias("original_query"), "refined_query", "intent_type", "is_complex", "visual_intent", "audio_intent", "video_intent"),
            payload(F.coalesce("target_kbs", F.array().cast(kbs.schema["target_kbs"].dataType)).alias("target_kbs"), F.col("target_kbs").isNull().alias("fallback_search")),
            payload(F.col("keywords").alias("sparse_keywords"), "total_found", "reranked_count"),
            payload(none.alias("results")),
            payload(F.lit("complete").alias("type")),
        ]
        told = every.select(F.col("query_id").cast("string").alias("query_id"), F.posexplode(F.array(*rows)).alias("place", "payload"))
        return told.select("query_id", (F.col("place") + 1).alias("place"), F.get(F.lit(STAGES), F.col("place")).alias("stage"), "payload")


class Ledger:
    """Rows of batches below ``path``, and the ids of the batches that are whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def has(self, batch: int) -> bool:
        return exists(self.spark, f"{self.path}/ledger/batch-{batch}/_SUCCESS")

    def write(self, rows: DataFrame, batch: int) -> None:
        if self.has(batch):
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        self.commit(batch)

    def commit(self, batch: int) -> None:
        self.spark.createDataFrame([(batch,)], LEDGER_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch-{batch}")

    def read(self, schema: str = ROWS_SCHEMA) -> DataFrame:
        """The rows of whole batches, with their batch."""
        if not exists(self.spark, f"{self.path}/ledger"):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        whole = self.spark.read.schema(LEDGER_SCHEMA).parquet(f"{self.path}/ledger/*")
        rows = self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        return rows.join(F.broadcast(whole), "batch", "left_semi")


def start(questions: DataFrame, retrieval: Retrieval, path: str, trigger: dict | None = None):
    """The running query that answers a stream of questions into ``path``."""
    ledger = Ledger(questions.sparkSession, f"{path}/told")

    def step(batch: DataFrame, number: int) -> None:
        if not ledger.has(number):
            ledger.write(retrieval.stages(batch), number)

    return questions.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
