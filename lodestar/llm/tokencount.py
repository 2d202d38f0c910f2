"""Token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import tokenizers_io
from lodestar.llm.common import discard, join_split, materialize, shared_base

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def lasting_cache(spark: SparkSession) -> str:
    """The cache folder that all calls of a cluster share, in its shared folder."""
    return f"{shared_base(spark)}/token-counts"


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_dir: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Texts are joined by the SHA-256 of their bytes and the tokenizer file's digest to the counts stored under
    ``cache_dir`` (by default ``lasting_cache``); only distinct texts that aren't there are encoded, and their counts
    appended. Digests are compared first, so that only texts which miss are moved. Two calls that append at once may
    store a count twice; both rows are equal, and the join takes one. Null counts as empty (0 bytes, 0 tokens). Very
    long texts are encoded whole. Repeated rows and repeated or null ids are all returned. Other columns are not read.
    """
    spark = docs.sparkSession
    cache_dir = cache_dir or lasting_cache(spark)
    version = tokenizers_io.file_digest(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_dir)

    def cached() -> DataFrame:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).filter(F.col("tokenizer") == version)
        return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    keyed = materialize(texts.select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), "digest"), "token-keys")
    copies = materialize(keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "token-digests")
    misses = materialize(copies.select("digest").join(cached(), "digest", "left_anti"), "token-misses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizers_io.unit_encoder(tokenizer_path, True)
        for batch in batches:
            n = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    # only texts that miss are moved, whatever their number; one text for each of them, rows of frequent digests where they are
    wanted = join_split(texts.select("digest", "_text"), misses, "digest").dropDuplicates(["digest"])
    wanted.mapInArrow(run, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_dir)

    counted = join_split(keyed, cached(), "digest")
    discard(misses, copies)
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
