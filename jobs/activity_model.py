"""Keeps the operator's activity model up to date: per day and status, how many attempts, on how many entries, when, and what they cost.

Reads an append-only table of events(event_id, ts, user_id, event_type, value) as crawl attempts (an error failed and may
be retried, a signup was cancelled, all others succeeded) through a file stream with a checkpoint: a run takes what files
are new, then stops. Every batch is reduced to aggregates that can be merged: counts, exact sums (decimals), first and last
time, and a bitmap of entry ids for each range of 32,768 ids, from which distinct entries are counted without keeping rows.

    partials/day=.../batch=.../   the aggregates of each batch; a batch that runs again overwrites its own
    model/day=.../                the merged model; only days that the batch touched are merged and written again

Both are Parquet, written with dynamic partition overwrite, so a run that was cut off and starts again from the checkpoint
gives the same rows, and merging all batches gives what one run over all rows would give. Entry ids are taken as dense
(a sequence): then a bitmap is full. A null user counts as an attempt and not as an entry; a null time goes to day
`unknown`, a null value counts as 0.

    python -m jobs.activity_model --events PATH --output PATH --checkpoint PATH [--config jobs/activity_model.json]
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import stream

LOG = logging.getLogger("jobs.activity_model")
DEFAULTS = {"max_files_per_batch": 1000, "day_format": "yyyy-MM-dd"}
PATHS = ["events", "output", "checkpoint"]
PARTIAL = "status string, bucket bigint, attempts bigint, amount decimal(38,4), first_at timestamp_ntz, last_at timestamp_ntz, entries binary, day string, batch bigint"
MODEL = "status string, attempts bigint, entries bigint, amount decimal(38,4), first_at timestamp_ntz, last_at timestamp_ntz, day string"
MERGED = [F.sum, F.sum, F.min, F.max]  # of attempts, amount, first_at, last_at


def partials(events: DataFrame, day_format: str) -> DataFrame:
    """One row per day, status and range of entry ids; the rows of one batch or of all."""
    status = F.when(F.col("event_type") == "error", "failed_retryable").when(F.col("event_type") == "signup", "cancelled").otherwise("succeeded")
    at = F.col("ts").cast("timestamp_ntz")
    e = events.select(F.coalesce(F.date_format(at, day_format), F.lit("unknown")).alias("day"), status.alias("status"), at.alias("at"), F.col("value").cast("decimal(18,4)").alias("value"), "user_id",
                      F.bitmap_bucket_number("user_id").alias("bucket"))
    return e.groupBy("day", "status", "bucket").agg(
        F.count(F.lit(1)).alias("attempts"), F.coalesce(F.sum("value"), F.lit(0)).cast("decimal(38,4)").alias("amount"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("entries"))


def merge(parts: DataFrame) -> DataFrame:
    """The model from partial rows of any number of batches."""
    names = ["attempts", "amount", "first_at", "last_at"]
    both = [f(n).alias(n) for f, n in zip(MERGED, names, strict=True)]
    ranges = parts.groupBy("day", "status", "bucket").agg(*both, F.when(F.col("bucket").isNotNull(), F.bitmap_count(F.bitmap_or_agg("entries"))).otherwise(0).alias("entries"))
    return ranges.groupBy("day", "status").agg(*both, F.sum("entries").alias("entries")).select("status", "attempts", "entries", F.col("amount").cast("decimal(38,4)").alias("amount"), "first_at", "last_at", "day")


def update(batch: DataFrame, batch_id: int, output: str, config: dict) -> None:
    """Takes one batch into the partials and the model; the same batch again changes nothing."""
    spark = batch.sparkSession
    rows = partials(batch, config["day_format"]).withColumn("batch", F.lit(batch_id).cast("long"))
    days = sorted(r["day"] for r in rows.select("day").distinct().collect())  # a row per day
    if not days:
        return
    overwrite(rows, f"{output}/partials", "day", "batch")
    parts = spark.read.schema(PARTIAL).option("basePath", f"{output}/partials").parquet(*[f"{output}/partials/day={day}" for day in days])  # other days' folders are not even listed
    overwrite(merge(parts), f"{output}/model", "day")
    taken = parts.where(F.col("batch") == batch_id).agg(F.sum("attempts")).first()[0]
    LOG.info("batch %d: read %d attempts, wrote %d days", batch_id, taken, len(days))


def overwrite(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, events: str, output: str, checkpoint: str, config: dict = DEFAULTS) -> DataFrame:
    """Takes in what is new since the checkpoint and returns the whole model as it then stands."""
    new = stream(spark, events, maxFilesPerTrigger=config["max_files_per_batch"])
    query = (new.writeStream.foreachBatch(lambda batch, batch_id: update(batch, batch_id, output, config))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    model = spark.read.schema(MODEL).parquet(f"{output}/model")
    LOG.info("read %s: %d rows in new files; %s/model holds %d rows", events, sum(p["numInputRows"] for p in query.recentProgress), output, model.count())
    return model


if __name__ == "__main__":
    from jobs.cli import main

    main(run, PATHS, DEFAULTS, __doc__)
