"""Hybrid retrieval: a keyword branch and a vector branch, each over-fetched, merged by content and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring, text

OVER_FETCH = 3


def keyword_branch(docs: DataFrame, terms: list[str], limit: int) -> DataFrame:
    score = text.match_share(F.col("text"), terms)
    return docs.withColumn("keyword", score).where("keyword > 0").orderBy(F.desc("keyword"), "doc_id").limit(limit)


def vector_branch(docs: DataFrame, embeddings: DataFrame, query: list[float], limit: int, order: str = "distance") -> DataFrame:
    """The nearest by cosine; order="recency_first" takes the newest rows instead. Ids and scores are ranked before texts are joined."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = embeddings.select(F.col("vec_id"), scoring.cosine(F.col("embedding"), q).alias("vector"))
    known = scored.join(docs.select("doc_id"), F.col("vec_id") == F.col("doc_id")).select("doc_id", "vector")
    by = [F.desc("doc_id")] if order == "recency_first" else [F.desc(F.round("vector", 9)), F.col("doc_id")]
    best = known.orderBy(*by).limit(limit)
    return docs.join(F.broadcast(best), "doc_id")  # at most `limit` rows


def hybrid(docs: DataFrame, embeddings: DataFrame, terms: list[str], query: list[float], k: int, profile: str = "exploration") -> DataFrame:
    """docs(doc_id, source, text): the k best after merging equal texts, with diversity by source in arrival order."""
    slim = docs.select("doc_id", "source", "text")
    v = vector_branch(slim, embeddings, query, OVER_FETCH * k).withColumn("keyword", F.lit(0.0)).withColumn("mode", F.lit(0))
    w = keyword_branch(slim, terms, OVER_FETCH * k).withColumn("vector", F.lit(0.0)).withColumn("mode", F.lit(1))
    both = v.unionByName(w).withColumn("hash", F.sha2(text.normalize_chunk(F.col("text")), 256))
    own = F.when(F.col("mode") == 0, -F.round("vector", 9)).otherwise(-F.col("keyword"))
    seq = F.struct("mode", own.alias("own"), "doc_id")
    base = F.min(F.struct((-(F.col("vector") + F.col("keyword"))).alias("s"), seq.alias("seq"), "doc_id", "source"))
    merged = both.groupBy("hash").agg(base.alias("base"), F.min(seq).alias("seq"), F.max("vector").alias("vector"), F.max("keyword").alias("keyword"))
    rows = merged.select(F.col("base.doc_id").alias("doc_id"), F.col("base.source").alias("source"), "seq", "vector", "keyword")
    rows = rows.withColumn("diversity", F.lit(1.0) / F.row_number().over(Window.partitionBy("source").orderBy("seq")))
    zero = F.lit(0.0)
    score = scoring.weighted(profile, F.col("vector"), F.col("keyword"), zero, zero, zero, zero, zero, zero, F.col("diversity"))
    return rows.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "seq").limit(k).select("doc_id", "source", F.round("vector", 6).alias("vector"), "keyword", "diversity", "score")
