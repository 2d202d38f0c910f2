"""From raw documents to packed training sequences. Each stage's rows are written, and read as the next one's.

Every stage but the last keeps the columns it is given, whatever else they are named, and repeated rows stand for
themselves until a dedup stage meets them. An empty table passes through each as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import exactdedup, langid, neardup, packing, quality
from lodestar.llm.common import discard, held_out, materialize, table
from lodestar.llm.tokenizers_io import public_path

TOKENIZER = "byte_bpe_50k.json"


def language_model(docs: DataFrame) -> dict[str, bytes]:
    """Learnt from the rows whose id's crc32 modulo 4 isn't 2."""
    return langid.learn(docs.filter(~held_out("doc_id", 4, 2)))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learnt from the labels of the rows whose id's crc32 modulo 3 isn't 1."""
    return quality.learn(docs, labels.filter(~held_out("doc_id", 3, 1)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; learnt as in the language query.

    Null and empty texts and texts without a letter go, as do those whose two smallest sizes are too close. Long
    texts are judged whole. Equal sizes are a margin of nothing, so such a text goes. Null ids are carried through.
    """
    return langid.predict(docs, language_model(table(spark, sf_dir, "documents")), keep=True)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at least one half; learnt as in the quality query.

    Null counts as empty, and empty texts are scored like any other. A score of exactly one half stays.
    """
    return quality.score(docs, quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), keep=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest id.

    Null counts as empty; a null id is smaller than any; of rows that tie in text and id one stays.
    """
    return exactdedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the row with the smallest id.

    Texts without a word and rows with a null id stay. Rows that tie in id and text stay or go together.
    """
    return neardup.drop_near_copies(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, placed in sequences of at most 1024 tokens; null text counts as empty."""
    return packing.pack(docs, public_path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the compression, the additive model, the sketches or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
