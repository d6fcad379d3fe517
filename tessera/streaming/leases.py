"""Stateful streams: leases that return to the pool by timer, completions joined with their leases, work that is taken once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed processors need, while their streams start; the setting is restored."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def lease_pool(key_name: str, lease_ms: int) -> StatefulProcessor:
    """The processor of lease_stream. Its class is local, so that it travels by value: a stream's Python processes may not find this package."""
    made = Row(key_name, "id", "outcome", "at_ms")

    class LeasePool(StatefulProcessor):
        """One entry: who holds it and until when. A timer frees it when the watermark passes that time, without a further event."""

        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", "id long, until long")

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
            # each call of the state or of a timer crosses to the JVM and back: the lease is read once and written once, whatever the number of rows
            before = holder = self.held.get() if self.held.exists() else None
            for now, id_, kind in sorted((r["at_ms"], r["id"], r["kind"]) for r in rows):
                if holder and holder[1] <= now:
                    yield made(key[0], holder[0], "expired", holder[1])
                    holder = None
                if kind == "ack":
                    yield made(key[0], holder[0] if holder else id_, "completed" if holder else "late", now)
                    holder = None
                elif holder:
                    yield made(key[0], id_, "busy", now)
                else:
                    holder = (id_, now + lease_ms)
                    yield made(key[0], id_, "leased", now)
            if holder != before:
                if before:
                    self.handle.deleteTimer(before[1])
                if holder:
                    self.held.update(holder)
                    self.handle.registerTimer(holder[1])
                else:
                    self.held.clear()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
            if self.held.exists() and self.held.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
                holder = self.held.get()
                self.held.clear()
                yield made(key[0], holder[0], "expired", holder[1])

        def close(self) -> None:
            pass

    return LeasePool()


def lease_stream(events: DataFrame, key: str, *, lease_seconds: int, delay: str) -> DataFrame:
    """events(key, id, kind, at): requests and acks of entries -> what became of each: leased, busy, completed, late; and expired
    leases, at their end. Events later than `delay` are dropped. An entry's events of one micro-batch are ordered together, so
    the size of a batch bounds what a task holds; entries without a lease keep no state."""
    kind = events.schema[key].dataType.simpleString()
    slim = events.withWatermark("at", delay).select(key, "id", "kind", "at", F.unix_millis("at").alias("at_ms"))
    return slim.groupBy(key).transformWithState(lease_pool(key, lease_seconds * 1000), f"{key} {kind}, id long, outcome string, at_ms long", "append", "eventTime")


def completion_stream(leases: DataFrame, acks: DataFrame, *, grace: str, delay: str) -> DataFrame:
    """leases(lease_id, leased_at, expires_at) and acks(lease_id, acked_at), both streams -> lease_id, outcome.

    An ack up to the lease's end is on time, one within `grace` after it late, and a lease without either is missing, once the
    watermarks of both sides have passed the last moment at which an ack would count. State is kept that long and no longer.
    """
    left = leases.withWatermark("leased_at", delay)
    right = acks.withWatermark("acked_at", delay).withColumnRenamed("lease_id", "ack_of")
    longest = F.expr(f"acked_at >= leased_at AND acked_at <= leased_at + interval {grace}")
    joined = left.join(right, (F.col("lease_id") == F.col("ack_of")) & longest, "left_outer")
    outcome = F.when(F.col("acked_at").isNull(), "missing").when(F.col("acked_at") <= F.col("expires_at"), "on_time").otherwise("late")
    return joined.select("lease_id", outcome.alias("outcome"))


def append_epoch(path: str, work: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler that writes what `work` makes of a batch into the batch's own folder: the same batch again
    replaces its own rows and changes nothing else. The sink is never read."""
    def handle(batch: DataFrame, epoch: int) -> None:
        work(batch).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return handle


def once(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first delivery of each key; deliveries again within `delay` are dropped, and so are rows older than the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over what is there, batch by batch, and waits for its end."""
    with keyed_state(stream.sparkSession):
        query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
