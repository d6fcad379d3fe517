"""The logical tables of the engine over the physical test tables, each with the columns its operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table scan with its column list; filters and columns reach the Parquet reader."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file stream over a Parquet folder or a single file (which a file stream takes as a glob only)."""
    path = path.rstrip("/")
    found = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(found)


def ts(name: str):
    """Parquet holds timestamps without zone; the engine works in UTC."""
    return F.col(name).cast("timestamp")


def frontier_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontier entries from orders: status O is scheduled, F succeeded, P leased."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    status = F.when(F.col("o_orderstatus") == "O", "scheduled").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("leased")
    return o.select(F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("topic_id"), status.alias("crawl_status"),
                    F.col("o_totalprice").alias("priority"), ts("o_orderdate").alias("next_crawl_at"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl attempts over time from events: the entry is the user, an error is a retryable failure."""
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    status = F.when(F.col("event_type") == "error", "failed_retryable").when(F.col("event_type") == "signup", "cancelled").otherwise("succeeded")
    return e.select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("entry_id"), ts("ts").alias("recorded_at"),
                    status.alias("status"), F.sha2("props", 256).alias("content_hash"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from lineitem: subject = part, predicate = return flag, value = line status, domain = supplier."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id"), F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("predicate"),
                     F.col("l_linestatus").alias("value"), F.col("l_suppkey").alias("domain"), F.col("l_orderkey").alias("chunk"),
                     (F.col("l_discount") * 10).alias("trust"), (F.col("l_tax") * 10).alias("evidence"))
