"""Language identification by compression.

Each language has a raw-content zstandard dictionary made from sample texts. A text is cut into blocks, each
block is compressed with every language's dictionary, and the language with the smallest total wins: its
dictionary holds most of the strings the text is made of. Blocks keep the dictionary useful for long texts,
which would otherwise soon be explained by their own beginning; the whole text counts. Case is ignored. The
compressor takes matches of four bytes and leaves literals as they are, so a size tells what the dictionary
could explain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
BLOCK_BYTES = 4096
SAMPLE_ROWS, PARTS = 120, 16
MIN_MARGIN, CLOSE = 0.002, 0.05
PAD = b"\n" * 12  # the compressor looks for no match in a block's last bytes
SCALE = 16


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """A dictionary per language: the whole texts of at most ``rows`` distinct ones, those with the smallest hashes.

    What is gathered is bounded by rows times languages; languages are taken to be few. Rows with null text or
    language, or without a letter, don't take part. No row gives no language, and then all is unknown. The first
    pass picks hashes, the second fetches their texts; copies of a text count once.
    """
    texts = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    texts = texts.filter(F.col("lang").isNotNull() & has_letter("text"))
    picked = texts.select("lang", "key", F.pmod("key", F.lit(PARTS)).alias("part")).distinct()
    for keys in (("lang", "part"), ("lang",)):  # the smallest of each part, then of those, so no task holds a language's rows
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("key"))
        picked = picked.withColumn("place", place).filter(F.col("place") <= rows)
    picked = picked.select("lang", "key")
    sample = texts.join(F.broadcast(picked), ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sample.orderBy("lang", "key").collect():
        out.setdefault(r["lang"], []).append(r["text"].lower())
    return {lang: "\n".join(own).encode() for lang, own in out.items()}


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


class Classifier:
    """Compressors for one worker: quick ones for every text, and ones that search longer for texts that those leave close."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.langs = sorted(dictionaries)
        shared = {"min_match": 4, "window_log": 18, "hash_log": 17, "chain_log": 17, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        quick = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=8, search_log=1, **shared)
        long = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, target_length=32, search_log=8, **shared)

        def compressors(how) -> list:
            out = []
            for lang in self.langs:
                d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
            return out

        self.quick, self.long = compressors(quick), compressors(long)

    def _best(self, blocks: list[bytes], compressors: list) -> tuple[int, float]:
        """(the language's place, by what share of the second smallest size it is smaller)"""
        sizes = sorted((sum(len(compress(b)) for b in blocks), i) for i, compress in enumerate(compressors))
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0]) if len(sizes) > 1 else 1.0

    def __call__(self, text: str) -> tuple[str, float, float]:
        """(language, score, margin). The score is a two-way softmax of the margin."""
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[i : i + BLOCK_BYTES] + PAD for i in range(0, len(data), BLOCK_BYTES)]
        i, margin = self._best(blocks, self.quick)
        if margin < CLOSE:
            i, margin = self._best(blocks, self.long)
        return self.langs[i], 1 / (1 + math.exp(-SCALE * margin)), margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", keep: bool = False, min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per row of ``docs``: the id, ``lang_pred``, ``score``, ``rejected``; or with ``keep`` the rows not rejected, as they were.

    A text that is null or has no letter is ``und`` with score 0 and rejected. So is, but with its language and
    score, one whose two smallest sizes differ by less than ``min_margin`` of the larger. Ties go to the
    alphabetically first language. Texts whose sizes under the quick compressor lie closer than ``CLOSE`` are
    compressed again by one that searches longer. A text is read whole, however long. Repeated rows and null ids
    are carried through, an empty table gives an empty result, and other columns aren't read (with ``keep`` they
    pass unchanged). The dictionaries are bounded by the sample and sent to each executor once.
    """
    learned = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kind = docs.schema[id_col].dataType.simpleString()

    def judged(batches: Iterator[pa.RecordBatch], text_at: int):
        import regex

        letter = regex.compile(r"\p{L}").search
        classify = Classifier(learned.value) if learned.value else None
        for batch in batches:
            yield batch, [(*classify(t),) if classify and t and letter(t) else (UNKNOWN, 0.0, -1.0) for t in batch.column(text_at).to_pylist()]

    if keep:
        at = docs.columns.index(text_col)

        def kept(batches):
            for batch, found in judged(batches, at):
                yield batch.filter(pa.array([f[2] >= min_margin for f in found], pa.bool_()))

        return docs.mapInArrow(kept, docs.schema)

    def run(batches):
        for batch, found in judged(batches, 1):
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] < min_margin for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
