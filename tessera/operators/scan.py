"""Ordered scans per key that no hot key can hold up: what all earlier rows of the key come to, for any associative rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.sinks import staged

FAN = 256


def positions(df: DataFrame, key: str, order: list, pos: str = "pos") -> DataFrame:
    """df with a long that grows with the key and the order. The sort deals rows out by ranges of key and order, so that a
    hot key is spread over many tasks; the result is written once, since the numbers depend on the ranges."""
    return staged(df.orderBy(key, *order).withColumn(pos, F.monotonically_increasing_id()))


def exclusive_scan(rows: DataFrame, key: str, pos: str, value: str, then: Callable[[Column, Column], Column], *, fan: int = FAN) -> DataFrame:
    """rows with a column `before`: the values of all rows of the same key with a smaller pos, joined by `then`; null for none.

    `then` is associative; a null value changes nothing. Where some key has more than `fan` rows, its rows are joined in
    blocks of neighbouring positions (`fan` at most), the blocks' results are scanned in the same way, and each block starts
    from what comes before it: about log(rows) / log(fan) levels, each a shuffle of lists of bounded length.
    """
    kind = rows.schema[value].dataType.simpleString()
    most = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    block = F.col(pos).cast("long") if most <= fan else F.shiftright(F.col(pos).cast("long"), fan.bit_length() - 1)
    both = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(then(a, b)).cast(kind)
    rest = [c for c in rows.columns if c not in (key, pos)]
    lists = rows.groupBy(key, (F.lit(0).cast("long") if most <= fan else block).alias("__block")).agg(F.array_sort(F.collect_list(F.struct(pos, *rest))).alias("__items"))
    nothing = F.struct(F.lit(None).cast(kind).alias("all"), F.array().cast(f"array<{kind}>").alias("before"))
    lists = lists.withColumn("__run", F.aggregate("__items", nothing, lambda got, x: F.struct(both(got["all"], x[value]).alias("all"), F.array_append(got["before"], got["all"]).alias("before"))))
    start = F.lit(None).cast(kind)
    if most > fan:
        lists = staged(lists)
        above = exclusive_scan(lists.select(key, "__block", F.col("__run.all").alias(value)), key, "__block", value, then, fan=fan)
        above = above.select(F.col(key).alias("__k"), F.col("__block").alias("__b"), F.col("before").alias("__start"))
        lists, start = lists.join(above, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__block") == F.col("__b"))), F.col("__start")
    each = lists.select(key, start.alias("__start"), F.explode(F.arrays_zip(F.col("__items").alias("x"), F.col("__run.before").alias("b"))).alias("__e"))
    return each.select(*[F.col(key) if c == key else F.col(f"__e.x.{c}").alias(c) for c in rows.columns], both(F.col("__start"), F.col("__e.b")).alias("before"))
