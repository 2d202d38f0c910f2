"""Sessions for local work, and the package's way to the workers."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodestar").config("spark.driver.memory", memory)
    settings = {
        "spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true",
    }
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


@functools.cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lodestar-tables-')}"


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below the folder that driver and executors share: ``spark.checkpoint.dir``, on one machine else a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what several parts of a query need is computed once."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@functools.cache
def _archive() -> str:
    folder = tempfile.mkdtemp(prefix="lodestar-package-")
    return shutil.make_archive(f"{folder}/lodestar", "zip", ROOT, "lodestar")


@functools.cache
def _sent(application: str) -> set:
    return set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, unless their PYTHONPATH has it."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sent = _sent(spark.sparkContext.applicationId)
    if not sent:
        sent.add(True)
        spark.sparkContext.addPyFile(_archive())
