"""Filter interaction audit: what each of five filters removes in every order, and how much of it the others would too.

Duplicates are found by partition refinement. Rows are split by their length in code points, then by the hashes of
successive blocks of their texts (code points 1-64, 65-1,024, 1,025-16,384, the rest); after each split, rows that are alone
are dropped. Only rows that survive all splits have their full texts compared: texts are grouped as they are, copies of one
text merge before the shuffle, and every row but those of the smallest id is marked. The splits work on a slim table (a
hash for each block, no text), written once to the shared folder.

Every row gets a mask of the filters that it fails. All orders are then counted from the numbers of rows by part and mask,
at most 32 for a part: first for the 80 pairs of a filter and the filters before it, then for the 120 orders of five steps.

Defined results: null text counts as empty, a null part as the empty string. A text of no words fails A and, having neither
words nor capitals, not B or C. Ids decide E: a row fails if a smaller id has the same text, so rows that repeat the
smallest id of a text pass, and a null id counts as larger than all others. Of repeated labels of an id any 1 counts; ids
without a label count as 0. Very long texts are read whole. An empty table gives an empty result; all steps of a part with
rows are returned, zeros included. Columns other than those named are not read, so any further names may occur.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, maybe_in

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
BLOCKS = (64, 1024, 16384)  # last code point of each block but the last
WHITE = " \t\n\x0b\f\r"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"


def _own_mask(text: Column, words: Column) -> Column:
    """Filters A to D, which a text fails by itself; words is _words(text) as a column of its own, so that it is made once."""
    every = F.size(words).cast("long") - F.array_contains(F.slice(words, 1, 1), "").cast("long")  # a text without words splits into one empty string
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    bit = lambda k, fails: F.when(fails, 1 << k).otherwise(0)
    few = F.size(F.array_distinct(words)).cast("long") * 100 < every * MIN_DISTINCT_PERCENT
    return bit(0, every < MIN_WORDS) + bit(1, few) + bit(2, capitals * 100 > F.length(text) * MAX_CAPITALS_PERCENT) + bit(3, text.rlike(SYMBOLS))


def _words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(WHITE)), f"[{WHITE}]+")


def _blocks(text: Column) -> list[Column]:
    starts = [0, *BLOCKS]
    ends = [*BLOCKS, None]
    return [F.xxhash64(F.substring(text, a + 1, b - a) if b else F.when(F.length(text) > a, F.substr(text, F.lit(a + 1))).otherwise("")) for a, b in zip(starts, ends, strict=True)]


def _finest(text: Column) -> Column:
    """The key of the last split: the length and all blocks, chained."""
    key = F.xxhash64(F.length(text))
    for block in _blocks(text):
        key = F.xxhash64(key, block)
    return key


def surviving_keys(rows: DataFrame) -> DataFrame:
    """rows(chars, b0, b1, ...) -> the keys of the last split that two rows or more share; single rows go after each split."""
    left = rows.select(F.xxhash64("chars").alias("key"), *[f"b{k}" for k in range(len(BLOCKS) + 1)])
    for block in [f"b{k}" for k in range(len(BLOCKS) + 1)]:
        shared = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(fresh(F.col("key")).alias("shared"))
        left = left.join(shared, F.col("key") == F.col("shared"), "left_semi")
        left = cut(left.withColumn("key", F.xxhash64("key", block)).drop(block))
    return cut(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))


def first_ids(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """texts(id, text) -> (digest, first) for each text that occurs again: full texts are compared, the digest names them."""
    likely = maybe_in(texts.withColumn("key", _finest(F.col("text"))), F.col("key"), keys, F.col("key"), "maybe").where("maybe")
    same = likely.groupBy("text").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return same.select(F.unhex(F.sha2("text", 256)).alias("digest"), "first")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: id, part, mask (a bit for each failed filter, A = 1 to E = 16)."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    rows = cut(slim.withColumn("words", _words(text)).select("id", "part", _own_mask(text, F.col("words")).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"), F.length(text).alias("chars"),
                           *[b.alias(f"b{k}") for k, b in enumerate(_blocks(text))]))
    firsts = cut(first_ids(slim.select("id", "text"), surviving_keys(rows))).select(F.concat("digest", F.lit(b"")).alias("of"), "first")
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    marked = rows.join(firsts, F.col("digest") == F.col("of"), "left")
    return marked.select(F.col("id").alias(id_col), "part", (F.col("mask") + F.when(again, DUPLICATE).otherwise(0)).alias("mask"))


def _steps() -> Column:
    """All pairs of a filter's bit and the bits before it, each with the orders and steps in which it occurs."""
    places: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in map("".join, itertools.permutations(FILTERS)):
        for k, f in enumerate(order):
            places.setdefault((1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in order[:k])), []).append((order, k + 1))
    pair = lambda o, k: F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"))
    return F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(pre).alias("pre"), F.array(*[pair(*p) for p in at]).alias("places")) for (bit, pre), at in places.items()])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """labels(id, quality, toxic). One row per part, order and step, with the counts of the contract."""
    known = labels.groupBy(F.col(id_col).alias("of")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    rows = masks(docs, id_col, text_col, part_col)
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    counts = rows.join(known, F.col(id_col) == F.col("of"), "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("good").alias("good"), one("toxic").alias("toxic"))
    by = cut(counts).withColumn("at", F.explode(_steps())).select("part", "mask", "n", "good", "toxic", "at.bit", "at.pre", "at.places")
    fails, passed = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("pre")) == 0
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long")
    share = F.expr(f"{math.factorial(len(FILTERS))} div bit_count(mask)")  # orders in which a failed filter is the first of those that a row fails
    got = by.groupBy("part", "bit", "pre").agg(
        F.first("places").alias("places"), total("n", passed & ~fails).alias("kept"), total("n", passed & fails).alias("removed"), total("n", fails & ~passed).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"), total("good", passed & fails).alias("good_lost"), total("toxic", passed & fails).alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share).otherwise(0)).cast("long").alias("shapley"))
    numbers = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return got.select("part", F.explode("places").alias("place"), *numbers).select("part", "place.filter_order", "place.step", *numbers)
