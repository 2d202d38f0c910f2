"""What runs tell of themselves: counters that are always up to date, and stages with percent of streams."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lodestar.sources.snapshots import SnapshotTable

SCHEMA = "query string, at long, stage string, percent int, batch long, rows long, total long, message string"


class ProgressRows(StreamingQueryListener):
    """A listener that writes a row at the start of each stream, after each batch and at the end, as a file below ``path``.

    ``expected`` has the rows of a stream by its name, from which the percent follows; without it the percent stays at 0
    until the end. Only named streams are told of.
    """

    def __init__(self, spark: SparkSession, path: str, expected: dict[str, int] | None = None):
        self.spark, self.path, self.expected = spark, path.rstrip("/"), expected or {}
        self.names: dict[str, str] = {}
        self.rows: dict[str, int] = {}
        self.told = 0

    def _tell(self, run: str, stage: str, percent: int, batch: int | None = None, rows: int = 0, message: str | None = None) -> None:
        name = self.names.get(run)
        if not name:
            return
        self.told += 1
        row = {"query": name, "at": time.time_ns() // 1000, "stage": stage, "percent": percent, "batch": batch, "rows": rows, "total": self.rows.get(run, 0), "message": message}
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run}-{self.told:08}.json")
        out = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or ""
        self._tell(str(event.runId), "initializing", 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = str(p.runId)
        self.rows[run] = self.rows.get(run, 0) + p.numInputRows
        most = self.expected.get(self.names.get(run, ""), 0)
        self._tell(run, "processing", min(99, 100 * self.rows[run] // most) if most else 0, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        failed = event.exception is not None
        self._tell(str(event.runId), "failed" if failed else "completed", 0 if failed else 100, message=event.exception)


def status(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each stream that was told below ``path``; a name that isn't there has none."""
    last = F.max_by(F.struct("stage", "percent", "batch", "total", "message"), "at").alias("s")
    return spark.read.schema(SCHEMA).json(path).groupBy("query").agg(last).select("query", "s.*")


def running_counts(events: DataFrame, keys: list[str], path: str, checkpoint: str, name: str | None = None):
    """The running query that keeps a count of each combination of keys in a snapshot table at ``path``, whole after every batch."""
    kinds = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    table = SnapshotTable(events.sparkSession, path, f"{kinds}, n long, shard string", "shard")

    def step(batch: DataFrame, _: int) -> None:
        table.replace(batch.withColumn("shard", F.lit("all")), ["all"])

    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    writer = counts.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def counts(spark: SparkSession, keys: dict[str, str], path: str) -> DataFrame:
    """The counts as of the last whole batch; ``keys`` are names and types."""
    kinds = ", ".join(f"`{k}` {t}" for k, t in keys.items())
    return SnapshotTable(spark, path, f"{kinds}, n long, shard string", "shard").read().drop("shard")
