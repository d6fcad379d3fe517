"""Line dedup: normalised lines are exploded and hashed, the distinct documents of each hash counted, lines of frequent
hashes dropped, and the rest put together again by position.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased. Keys are told apart by 128 bits
(two seeded xxHash64). A row adds each of its keys once, so that counting rows counts documents, and counts merge before
they are shuffled: neither a frequent line nor a row of a million equal lines is gathered anywhere. Of every line to be
dropped only its place is kept, under 128 bits of its whole text, which equal texts share; so no row number is needed, and
copies of one text merge before the shuffle. Texts that surely lose no line (a bitmap of bounded size tells) are not
shuffled. The frequent keys are broadcast up to `broadcast_rows` of them (a count is checked); beyond that a bitmap and a
join on the key do the same.

Defined results: a text is split at every \\n, so it has one line more than it has \\n; null and empty texts have one empty
line and come back empty. A document is a row: rows that repeat an id or a text count one by one. Keys shorter than
`min_chars` code points are never dropped (with 1: blank lines). A line that occurs twice in a document counts once there
and both places go. Very long texts are read whole. An empty table gives an empty result. Further columns, of any name,
are not read (`decisions`) or pass through (`filter_documents`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, maybe_in

WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: Column) -> Column:
    """A-Z only; lower() is faster and does just that where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _hashes(value: Column, name: str) -> list[Column]:
    return [F.xxhash64(value).alias(f"{name}1"), F.xxhash64(F.lit(7919), value).alias(f"{name}2")]


def frequent_keys(texts: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """texts(__ld_text) -> (k1, k2) of the keys found in at least min_docs rows."""
    keys = F.array_distinct(F.transform(F.split(_lowered(F.col("__ld_text")), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE))))
    each = texts.select(F.explode(keys).alias("key")).where(F.length("key") >= min_chars)
    return each.select(*_hashes(F.col("key"), "k")).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("k1", "k2")


def _dropped_places(texts: DataFrame, hot: DataFrame, min_chars: int, broadcast_rows: int) -> DataFrame:
    """texts(__ld_text) -> (d1, d2, places): where texts with these hashes hold frequent keys."""
    at = texts.select(*_hashes(F.col("__ld_text"), "t"), F.posexplode(F.split(_lowered(F.col("__ld_text")), "\n", -1)).alias("place", "line"))
    at = at.withColumn("line", F.btrim("line", F.lit(WHITE))).where(F.length("line") >= min_chars).select("t1", "t2", "place", *_hashes(F.col("line"), "k"))
    if hot.count() <= broadcast_rows:
        hits = at.join(F.broadcast(hot), ["k1", "k2"])
    else:
        likely = maybe_in(at, F.col("k1"), hot, F.col("k1"), "__ld_maybe").where("__ld_maybe")
        other = hot.select(fresh(F.col("k1")).alias("h1"), fresh(F.col("k2")).alias("h2"))
        hits = likely.join(other, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")))
    return hits.groupBy(F.col("t1").alias("d1"), F.col("t2").alias("d2")).agg(F.collect_set("place").alias("places"))


def _kept(docs: DataFrame, text_col: str, min_docs: int, min_chars: int, broadcast_rows: int) -> DataFrame:
    """docs with __ld_n, __ld_dropped and __ld_kept."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__ld_text"))
    hot = cut(frequent_keys(texts, min_docs, min_chars))
    drops = cut(_dropped_places(texts, hot, min_chars, broadcast_rows))
    keyed = docs.withColumn("__ld_text", F.coalesce(F.col(text_col), F.lit("")))
    keyed = keyed.select("*", *_hashes(F.col("__ld_text"), "__ld_t"))
    keyed = maybe_in(keyed, F.col("__ld_t1"), drops, F.col("d1"), "__ld_hit")
    other = drops.select(fresh(F.col("d1")).alias("__ld_d1"), fresh(F.col("d2")).alias("__ld_d2"), F.col("places").alias("__ld_places"))
    found = keyed.where("__ld_hit").join(other, (F.col("__ld_t1") == F.col("__ld_d1")) & (F.col("__ld_t2") == F.col("__ld_d2")), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    lines = F.split("__ld_text", "\n", -1)
    same = keyed.where("not __ld_hit").select(*columns, F.size(lines).cast("long").alias("__ld_n"), F.lit(0).cast("long").alias("__ld_dropped"), F.col("__ld_text").alias("__ld_kept"))
    gone = F.coalesce("__ld_places", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), gone)
    cleaned = found.withColumn("__ld_lines", lines).select(
        *columns, F.size("__ld_lines").cast("long").alias("__ld_n"), F.size(gone).cast("long").alias("__ld_dropped"),
        F.array_join(F.transform(left, lambda i: F.get("__ld_lines", i)), "\n").alias("__ld_kept"))
    return same.unionByName(cleaned)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_docs: int = 10, min_chars: int = 1,
              broadcast_rows: int = 200_000) -> DataFrame:
    """One row per document: id, n_lines (before dropping), n_dropped, kept_text."""
    slim = docs.select(F.col(id_col).alias("__ld_id"), F.col(text_col).alias("__ld_in"))
    return _kept(slim, "__ld_in", min_docs, min_chars, broadcast_rows).select(
        F.col("__ld_id").alias(id_col), F.col("__ld_n").alias("n_lines"), F.col("__ld_dropped").alias("n_dropped"), F.col("__ld_kept").alias("kept_text"))


def filter_documents(docs: DataFrame, text_col: str = "text", *, min_docs: int = 10, min_chars: int = 1, broadcast_rows: int = 200_000) -> DataFrame:
    """docs with the frequent lines taken out of their texts; all other columns as they were."""
    kept = _kept(docs, text_col, min_docs, min_chars, broadcast_rows)
    return kept.select(*[F.col("__ld_kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
