"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lodestar-')}"


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder serves a session on
    one machine; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
        base = _local_dir()
    return base.rstrip("/")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_base(spark)}/{what}-{uuid.uuid4().hex}"


_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and nothing is computed twice."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``materialize``, once whatever was read from them is written."""
    for df in tables:
        path = _written.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Makes tables by ``materialize`` and deletes all of them at once, when what was made of them is written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        self.tables.append(materialize(df, what))
        return self.tables[-1]

    def clear(self) -> None:
        discard(*self.tables)
        self.tables = []


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str, modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def join_split(left: DataFrame, right: DataFrame, key: str, how: str = "inner", keep: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """``left`` joined with ``right``, which has a row per key, without gathering the rows of a frequent key.

    Keys with more than an eighth of a partition's even share of ``left``, of which there can't be more than eight a
    partition, are joined by broadcast; the others by a shuffle. ``how`` is inner or left. ``keep`` writes the table of counts, which
    must stand until the result is written.
    """
    parts = shuffle_partitions(left.sparkSession)
    counts = keep(left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1"), "key-counts")
    most = (counts.agg(F.sum("_copies")).first()[0] or 0) / (8 * parts)
    # one key more, frequent or not, so that the plan is the same with and without such keys (a null alone would be seen as an empty side)
    none = left.sparkSession.range(1).select(F.lit("0").cast(left.schema[key].dataType).alias(key))
    hot = F.broadcast(counts.filter(F.col("_copies") > max(1.0, most)).select(key).unionByName(none).distinct())
    few = F.broadcast(right.join(hot, key, "left_semi"))
    rest = left.filter(F.col(key).isNotNull()).join(hot, key, "left_anti").join(right, key, how)
    out = left.join(hot, key, "left_semi").join(few, key, how).unionByName(rest)
    return out if how == "inner" else out.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)
