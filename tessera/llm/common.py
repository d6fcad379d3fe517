"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a private one only where that is unset and Spark is local (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared checkpoint folder, so that later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo `modulus`; a null id counts as empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """At the end of a task, gives freed memory back to the system: the worker process stays for other operators."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def bitmap_words(keys: int) -> int:
    """Words of 64 bits for a bitmap of so many keys: 16 bits a key, from half a megabyte to 8 megabytes of bits."""
    return min(max(1 << 16, 1 << (max(keys, 1) // 4).bit_length()), 1 << 20)


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, name: str) -> DataFrame:
    """df with a boolean column `name`: false only where `key` is surely not among `keys` (a table that was cut).

    A bitmap is broadcast, at most 1,048,576 rows of 16 bytes, whatever the size of keys.
    """
    words = bitmap_words(keys.count())
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(words * 64))
    bits = (
        keys.select(slot(keys_key).alias("__slot")).groupBy(F.expr("__slot div 64").alias("__word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(__slot % 64 as int)))").alias("__bits"))
    )
    return (
        df.withColumn("__slot", slot(key)).withColumn("__word", F.expr("__slot div 64")).join(F.broadcast(bits), "__word", "left")
        .withColumn(name, F.expr("coalesce(shiftrightunsigned(__bits, cast(__slot % 64 as int)) & 1L, 0L) = 1L"))
        .drop("__word", "__bits", "__slot")
    )


def fresh(key: Column) -> Column:
    """The same long as a new expression: a join then deals both sides out itself, and a hot key's rows can be split."""
    return key.bitwiseXOR(F.lit(0).cast("long"))


def components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) -> (node, label): the smallest node of each connected component.

    Minimum labels move along edges, then each label is replaced by its own label, until nothing changes.
    """
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = both.join(labels.select(fresh(F.col("node")).alias("k"), "label"), F.col("u") == F.col("k")).groupBy(F.col("v").alias("n")).agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["n"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("new"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("to"))
        step = cut(step.join(jump, step["new"] == jump["j"], "left").select("node", "old", F.least("new", F.coalesce("to", "new")).alias("label")))
        labels = step.select("node", "label")
        if not step.where("old <> label").limit(1).count():
            return labels
