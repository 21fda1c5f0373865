"""From raw documents to packed training sequences: language ID, near-dedup, passage dedup, packing.

Each stage works on all rows its predecessor kept and is written as Parquet before the next one reads it.
Row rules: the language stage keeps every row whose text has a language (text judged `und`, that is null or without a
letter, goes); the near-dedup stage keeps the document of the smallest id of each group; the passage stage cuts
repeated passages out of texts and keeps all rows; the last stage returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm import language, packing, similar, spans, work
from ragloom.llm.queries import vocabulary_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8."""
    return similar.keep_one(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spans.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [("language", language_stage), ("near_dedup", near_dedup_stage), ("passages", passage_stage), ("packing", packing_stage)]
#: SQL can express none of the four stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.table(docs, name)
    return docs
