"""Exact dedup by progressive refinement: length, then prefix hash, then full hash for surviving groups only.

One narrow scan groups documents by (normalised length, prefix hash). The keys of groups with two or more members set
bits in a bitmap of bounded size, which is broadcast: 16 bits for each such key, at most 1,048,576 rows of 16 bytes. A
second scan takes the full SHA-256 only of rows whose bit is set. A bit set by another key costs one extra hash and
never changes the result; beyond some four million such keys a growing share of the single texts is hashed too.

Defined results: null text counts as empty; texts are equal when identical after deleting every character of
[\\x20\\x09-\\x0D], however long; the row with most code points in its original text stays, then the smallest doc_id, null ids last.
Rows that repeat an id and a text count as separate members, of which one stays: of rows with one id the one with most code
points, of rows equal in both any one. An empty table gives an empty result. Other columns are not read (`decisions`)
or pass through unchanged (`filter_documents`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bitmap_words, cut

WHITE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _keyed(docs: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    norm = docs.withColumn("__xd_norm", normalised(F.col(text_col)))
    return norm.withColumns({
        "__xd_len": F.length("__xd_norm"),
        "__xd_prefix": F.xxhash64(F.substring("__xd_norm", 1, prefix_chars)),
    })


def _slot(words: int) -> Column:
    return F.pmod(F.xxhash64("__xd_len", "__xd_prefix"), F.lit(words * 64))


def _flagged(docs: DataFrame, text_col: str, prefix_chars: int, words: int | None) -> DataFrame:
    """docs with __xd_norm and __xd_hit: whether its length and prefix may occur in another row."""
    keyed = _keyed(docs, text_col, prefix_chars)
    shared = cut(keyed.groupBy("__xd_len", "__xd_prefix").agg(F.count(F.lit(1)).alias("__xd_n")).where("__xd_n > 1"))
    words = words or bitmap_words(shared.count())
    bits = (
        shared.withColumn("__xd_slot", _slot(words))
        .groupBy(F.expr("__xd_slot div 64").alias("__xd_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(__xd_slot % 64 as int)))").alias("__xd_bits"))
    )
    return (
        keyed.withColumn("__xd_slot", _slot(words))
        .withColumn("__xd_word", F.expr("__xd_slot div 64"))
        .join(F.broadcast(bits), "__xd_word", "left")
        .withColumn("__xd_hit", F.expr("coalesce(shiftrightunsigned(__xd_bits, cast(__xd_slot % 64 as int)) & 1L, 0L) = 1L"))
        .drop("__xd_word", "__xd_bits", "__xd_slot", "__xd_len", "__xd_prefix")
    )


def _order(n: str, key: str, *more: str) -> Column:
    return F.struct((-F.col(n)).alias("n"), F.col(key).isNull().alias("no_id"), F.col(key).alias("id"), *more)


def _fresh(key: str) -> Column:
    """The same key as a new expression: the join then deals both sides out itself, and a hot key's rows can be split."""
    return F.concat(F.col(key), F.lit(b""))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest: bool = False,
              prefix_chars: int = 64, filter_words: int | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept; with `digest` also text_sha256 of the normalised text."""
    slim = docs.select(F.col(id_col).alias("__xd_id"), F.col(text_col).alias("__xd_text"))
    full = F.unhex(F.sha2("__xd_norm", 256))
    rows = _flagged(slim, "__xd_text", prefix_chars, filter_words).select(
        "__xd_id", "__xd_hit", F.monotonically_increasing_id().alias("__xd_row"), F.coalesce(F.length("__xd_text"), F.lit(0)).alias("__xd_chars"),
        (full if digest else F.when(F.col("__xd_hit"), full)
         .otherwise(F.unhex(F.hex(F.coalesce(F.col("__xd_id").cast("string"), F.lit("")))))).alias("__xd_sha"),
    )
    rows = cut(rows)
    groups = (
        rows.where("__xd_hit").groupBy("__xd_sha")
        .agg(F.count(F.lit(1)).alias("__xd_size"), F.min(_order("__xd_chars", "__xd_id", "__xd_row")).alias("__xd_best"))
        .where("__xd_size > 1").withColumn("__xd_grouped", F.lit(True)).withColumn("__xd_key", _fresh("__xd_sha")).drop("__xd_sha")
    )
    joined = rows.join(groups, F.col("__xd_sha") == F.col("__xd_key"), "left")
    keep = F.when(F.col("__xd_grouped"), F.col("__xd_best.id")).otherwise(F.col("__xd_id"))
    columns = [
        F.col("__xd_id").alias(id_col), keep.alias("keep_id"),
        F.coalesce("__xd_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("__xd_grouped").isNull() | (F.col("__xd_row") == F.col("__xd_best.__xd_row"))).alias("kept"),
    ]
    if digest:
        columns.append(F.lower(F.hex("__xd_sha")).alias("text_sha256"))
    return joined.select(*columns)


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                     prefix_chars: int = 64, filter_words: int | None = None) -> DataFrame:
    """docs without the copies: one row of each group of equal texts, all columns as they were.

    Rows whose bit is not set go straight through; only possible copies are shuffled with their texts.
    """
    flagged = _flagged(docs, text_col, prefix_chars, filter_words)
    flagged = flagged.withColumn("__xd_chars", F.coalesce(F.length(text_col), F.lit(0)))
    possible = flagged.where("__xd_hit").withColumn("__xd_sha", F.unhex(F.sha2("__xd_norm", 256))).drop("__xd_norm")
    best = possible.select("__xd_sha", F.col("__xd_chars"), F.col(id_col).alias("__xd_id")).groupBy("__xd_sha").agg(
        F.min(_order("__xd_chars", "__xd_id")).alias("__xd_best")).select(_fresh("__xd_sha").alias("__xd_key"), "__xd_best")
    winners = (
        possible.join(best, F.col("__xd_sha") == F.col("__xd_key"))
        .where(F.col(id_col).eqNullSafe(F.col("__xd_best.id")) & (F.col("__xd_chars") == -F.col("__xd_best.n")))
        .dropDuplicates(["__xd_sha"])
    )
    return flagged.where(~F.col("__xd_hit")).select(*[docs[c] for c in docs.columns]).unionByName(winners.select(*docs.columns))
