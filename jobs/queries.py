"""The jobs as queries: each runs twice over the whole tables into a new shared folder, which stays, and returns its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import activity_model, chunk_store
from tessera.plans.scalar_queries import COLLAPSED
from tessera.sources.sinks import shared_folder

LONGEST, STEP = 320, 280
WORDS = COLLAPSED.format("text")


def job1_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    for _ in range(2):
        store = chunk_store.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet", f"{folder}/chunks")
    return store


def job2_activity_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    for _ in range(2):
        model = activity_model.run(spark, f"{sf_dir}/events.parquet", f"{folder}/activity", f"{folder}/checkpoint")
    at = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_at", "last_at")}
    return model.withColumns({"amount": F.col("amount").cast("double"), **at})


QUERIES = {f.__name__: f for f in (job1_chunk_store, job2_activity_model)}

ORACLES = {
    "job1_chunk_store": f"""
    WITH d AS (SELECT doc_id, text, coalesce(nullif(lang, ''), 'und') AS lang, sha256(lower({WORDS})) AS content_hash FROM documents WHERE doc_id IS NOT NULL AND {WORDS} <> ''),
    o AS (SELECT content_hash, min(doc_id) AS doc_id, count(*) AS documents FROM d GROUP BY 1),
    w AS (SELECT d.doc_id, lang, documents, d.content_hash, list_filter(string_split({WORDS}, ' '), lambda x: x <> '') AS w FROM d JOIN o ON o.doc_id = d.doc_id AND o.content_hash = d.content_hash),
    n AS (SELECT *, greatest(0, ceil((len(w) - {LONGEST}) / {STEP}.0))::INT + 1 AS total_chunks FROM w),
    c AS (SELECT *, unnest(range(0, total_chunks))::INT AS chunk_index FROM n),
    t AS (SELECT *, w[chunk_index * {STEP} + 1:chunk_index * {STEP} + {LONGEST}] AS words FROM c)
    SELECT lang, doc_id, chunk_index, total_chunks, len(words)::INT AS token_count, documents, content_hash, sha256(lower(array_to_string(words, ' '))) AS chunk_hash,
           CASE WHEN len(words) < 60 THEN 'skipped' WHEN doc_id IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL) THEN 'embedded' ELSE 'pending' END AS status,
           array_to_string(words, ' ') AS text
    FROM t""",
    "job2_activity_model": """
    SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'unknown') AS day, CASE event_type WHEN 'error' THEN 'failed_retryable' WHEN 'signup' THEN 'cancelled' ELSE 'succeeded' END AS status,
           count(*) AS attempts, count(DISTINCT user_id) AS entries, coalesce(sum(value::DECIMAL(18, 4)), 0)::DOUBLE AS amount, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at
    FROM events GROUP BY 1, 2""",
}
