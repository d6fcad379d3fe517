"""The corpus pipeline: language ID, toxicity, exact dedup, near-dedup, packing; each stage is written and read again.

Each stage reads all that its predecessor kept. Null and empty texts, and texts without a letter, go in the first stage, since
their language cannot be told; very long texts are read whole by every stage. Of equal texts the longest original stays, then
the smallest id; of near copies the smallest id (null ids last; one row only, if rows repeat). Further columns of any name
pass through to the last stage, which returns the packed pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, language_id, near_dedup, packing, toxicity
from tessera.llm.common import ensure_checkpoint_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.filter_documents(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.filter_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

ORACLE_SQL = None  # learned models and tokenizers have no SQL form; tests/llm holds stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents; each result is written as Parquet to the shared folder and read as the next one's docs.

    The folder of a stage is removed when the next one is written.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, f"{folder}/{before}")
        before = name
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on whatever storage it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
