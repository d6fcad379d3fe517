"""Builds the chunk store of a document table: one document of each content, cut into overlapping chunks, with the backlog of chunks to embed.

Reads documents(doc_id, text, lang) and embeddings(vec_id, embedding); doc_id is the key of documents. Of documents whose
texts are equal after white space is collapsed and letters are lower-cased, the smallest id is cut and the others are
counted; contents are grouped by hash with slim rows that merge before the shuffle, and texts meet their owner by id, so a
content with very many copies is never gathered. Blank texts, null texts and rows without an id have no chunks; a null or
empty language is stored as `und`. A chunk below `min_tokens` is `skipped`, one of a document that has a vector is
`embedded`, any other is `pending`.

Writes Parquet, partitioned by lang: doc_id, chunk_index, total_chunks, token_count, documents (how many share the content),
content_hash, chunk_hash, status, text. A run replaces the whole store, so a rerun over the same input gives the same rows.

    python -m jobs.chunk_store --documents PATH --embeddings PATH --output PATH [--config jobs/chunk_store.json]
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring, text

LOG = logging.getLogger("jobs.chunk_store")
DEFAULTS = {"profile": "default", "min_tokens": 60, "max_records_per_file": 1_000_000}
PATHS = ["documents", "embeddings", "output"]


def chunks(documents: DataFrame, embeddings: DataFrame, config: dict) -> DataFrame:
    """The rows of the store."""
    d = documents.select("doc_id", "text", F.coalesce(F.nullif(F.col("lang").cast("string"), F.lit("")), F.lit("und")).alias("lang"), text.stable_hash(text.normalize_chunk(F.col("text"))).alias("content_hash"))
    d = d.where(F.col("doc_id").isNotNull() & (text.token_count(F.col("text")) > 0))
    owners = d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("documents"))
    embedded = embeddings.where("embedding is not null").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has_vector")).distinct()
    owned = d.join(owners, ["doc_id", "content_hash"]).join(embedded, "doc_id", "left")
    cut = owned.withColumn("chunks", text.word_windows(F.col("text"), *scoring.CHUNK_PROFILES[config["profile"]])).drop("text")
    each = cut.select("*", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "text")).drop("chunks")
    tokens = F.size(F.split("text", " "))  # windows are words joined by single spaces
    status = F.when(tokens < config["min_tokens"], "skipped").when(F.col("has_vector"), "embedded").otherwise("pending")
    return each.select("lang", "doc_id", "chunk_index", "total_chunks", tokens.alias("token_count"), "documents", "content_hash",
                       text.stable_hash(F.lower("text")).alias("chunk_hash"), status.alias("status"), "text")


def run(spark: SparkSession, documents: str, embeddings: str, output: str, config: dict = DEFAULTS) -> DataFrame:
    """Builds the store at `output` and returns it as it then stands."""
    docs, vectors = spark.read.parquet(documents), spark.read.parquet(embeddings)
    LOG.info("read %s: %d rows; read %s: %d rows", documents, docs.count(), embeddings, vectors.count())
    seen = Observation("chunks")
    rows = chunks(docs, vectors, config).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("status") == "pending", 1)).alias("pending"))
    rows.write.mode("overwrite").option("maxRecordsPerFile", config["max_records_per_file"]).partitionBy("lang").parquet(output)
    got = seen.get
    LOG.info("wrote %s: %d chunks of %d tokens, %d to embed", output, got["rows"], got["tokens"], got["pending"])
    return spark.read.schema(rows.schema).parquet(output).select(*rows.columns)


if __name__ == "__main__":
    from jobs.cli import main

    main(run, PATHS, DEFAULTS, __doc__)
