"""Sinks: append, replace by key, and a directory swap for upserts; all write to storage that every executor shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.relational import replace_partitions, upsert
from tessera.sources.shared import arrow_batches, shared_folder, staged

__all__ = ["append", "arrow_batches", "replace_by_key", "shared_folder", "staged", "upsert_swap"]


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_by_key(df: DataFrame, path: str, key: str) -> None:
    """Deletes what the sink holds for the keys of df and inserts df's rows."""
    replace_partitions(df, path, key)


def upsert_swap(incoming: DataFrame, current: str, following: str, keys: list[str], merge: list[str]) -> str:
    """Writes the merged table to a new folder and returns it; the caller then points to it and drops the old one."""
    spark = incoming.sparkSession
    upsert(spark.read.parquet(current), incoming, keys, merge).write.parquet(following)
    return following
