"""Streams: queue consumers, ordered state machines and rate limits. Batch and stream use the same folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import scoring
from tessera.operators import scan
from tessera.sources.sinks import staged


def rate_limit_fold(at: list, state: tuple | None, limit: int, window_seconds: float) -> tuple[list[tuple[bool, int]], tuple | None]:
    """Fixed windows that start with a key's first event: (allowed, remaining) of each event in order, and the new state."""
    out = []
    for t in at:
        if state is None or (t - state[0]).total_seconds() >= window_seconds:
            state = (t, 0)
        ok = state[1] < limit
        state = (state[0], state[1] + ok)
        out.append((ok, limit - state[1]))
    return out, state


def rate_limit(events: DataFrame, key: str, at: str, id_col: str, *, limit: int, window_seconds: float, fan: int = scan.FAN) -> DataFrame:
    """Batch form of the same: id, key, allowed, remaining. Events without a time take no part.

    The windows of a key start at its first event and then at each first event that is a window's length after the last
    start. Every time gets its successor (the first time a window later, from one ordered scan over times and probes); the
    starts are found by doubling: in each round the known starts jump ahead, and the jumps become twice as long. So the
    number of rounds grows with the logarithm of a key's windows, and no key's history is ever held in one task.
    """
    e = scan.positions(events.where(F.col(at).isNotNull()).select(key, at, id_col, F.unix_micros(F.col(at).cast("timestamp")).alias("__t")), key, ["__t", id_col])
    times = staged(e.groupBy(key, "__t").agg(F.min("pos").alias("pos")))
    probe = F.col("__t") + int(window_seconds * 1e6)
    ahead = times.select(key, F.col("__t").alias("__v"), F.lit(1).alias("__node"), "__t").unionByName(times.select(key, probe.alias("__v"), F.lit(0).alias("__node"), "__t"))
    ahead = scan.positions(ahead, key, [F.desc("__v"), F.desc("__node")]).withColumn("__seen", F.when(F.col("__node") == 1, F.col("__t")))
    found = scan.exclusive_scan(ahead, key, "pos", "__seen", lambda a, b: b, fan=fan)
    jumps = staged(found.where("__node = 0 and before is not null").select(F.col(key).alias("__k"), F.col("__t").alias("__from"), F.col("before").alias("__to")))
    starts = staged(times.groupBy(key).agg(F.min("__t").alias("__t")))
    known, before = starts.count(), -1
    while known > before:
        further = starts.join(jumps, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__t") == F.col("__from"))).select(key, F.col("__to").alias("__t"))
        starts = staged(starts.unionByName(further).distinct())
        known, before = starts.count(), known
        a, b = jumps.alias("a"), jumps.alias("b")
        jumps = staged(a.join(b, F.col("a.__k").eqNullSafe(F.col("b.__k")) & (F.col("a.__to") == F.col("b.__from"))).select("a.__k", "a.__from", "b.__to"))
    opens = times.join(starts.select(F.col(key).alias("__k"), F.col("__t").alias("__s")), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__t") == F.col("__s"))).select(F.col("pos").alias("__p"))
    marked = e.join(opens, F.col("pos") == F.col("__p"), "left").withColumn("__n", F.struct(F.col("__p").isNotNull().alias("opens"), F.lit(1).cast("long").alias("n"))).drop("__p")
    since = lambda a, b: F.when(b["opens"], b).otherwise(F.struct(a["opens"].alias("opens"), (a["n"] + b["n"]).alias("n")))
    counted = scan.exclusive_scan(marked, key, "pos", "__n", since, fan=fan)
    nth = F.when(F.col("__n.opens"), F.lit(1).cast("long")).otherwise(F.col("before.n") + 1)
    return counted.select(key, id_col, (nth <= limit).alias("allowed"), F.greatest(limit - nth, F.lit(0)).cast("int").alias("remaining"))


def rate_limit_stream(events: DataFrame, key: str, at: str, id_col: str, *, limit: int, window_seconds: float) -> DataFrame:
    """Stream form: the window's start and count are kept per key; each batch is folded in time order."""
    kind = lambda c: events.schema[c].dataType.simpleString()

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values([at, id_col])
        before = state.get if state.exists else None
        got, after = rate_limit_fold(list(pdf[at]), None if before is None else (pd.Timestamp(before[0]), before[1]), limit, window_seconds)
        state.update((after[0].to_pydatetime(), int(after[1])))
        yield pd.DataFrame({key: pdf[key], id_col: pdf[id_col], "allowed": [a for a, _ in got], "remaining": [n for _, n in got]})

    return events.select(key, at, id_col).groupBy(key).applyInPandasWithState(
        run, f"{key} {kind(key)}, {id_col} {kind(id_col)}, allowed boolean, remaining int", "start timestamp, n int", "append", "NoTimeout")


# Which states a discovery run may go to.
RUN_TRANSITIONS = {
    "queued": {"leased", "cancelled"}, "leased": {"running", "queued", "cancelled", "failed"}, "running": {"checkpointed", "succeeded", "partial", "failed", "cancelled"},
    "checkpointed": {"running", "succeeded", "partial", "failed", "cancelled"}, "partial": {"queued"}, "failed": {"queued"}, "succeeded": set(), "cancelled": set(),
}


# Which states a topic may go to; activation, pause, resumption, archiving.
TOPIC_TRANSITIONS = {"draft": {"active", "archived"}, "active": {"paused", "archived"}, "paused": {"active", "archived"}, "archived": set()}


def run_machine(commands: DataFrame, key: str, order: str, to: str, start: str = "queued", transitions: dict[str, set[str]] = RUN_TRANSITIONS, *, fan: int = scan.FAN) -> DataFrame:
    """Transition commands per key, in order: applied or rejected, and the state after each; a state that nobody knows is rejected.

    A command maps each state to the next one. Such maps can be joined without knowing the state they start from, so the
    state before every command comes from one ordered scan, however long a key's history is.
    """
    names = list(transitions)
    whole = lambda rows: F.array(*[F.array(*[F.lit(x) for x in row]) for row in rows])
    maps = whole([range(len(names)), *[[k if wanted in transitions[s] else i for i, s in enumerate(names)] for k, wanted in enumerate(names)]])
    may = whole([[False] * len(names), *[[wanted in transitions[s] for s in names] for wanted in names]])
    at = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(to)), F.lit(0)).cast("int")
    rows = scan.positions(commands.select(key, order, at.alias("__to")), key, [order]).withColumn("__map", F.get(maps, F.col("__to")))
    first = names.index(start)
    known = scan.exclusive_scan(rows, key, "pos", "__map", lambda a, b: F.transform(a, lambda s: F.get(b, s)), fan=fan).withColumn("__now", F.coalesce(F.get("before", F.lit(first)), F.lit(first)))
    outcome = F.when(F.get(F.get(may, F.col("__to")), F.col("__now")), "applied").otherwise("rejected")
    return known.select(key, order, outcome.alias("outcome"), F.get(F.array(*[F.lit(n) for n in names]), F.get("__map", F.col("__now"))).alias("state"))


def retry_schedule(attempts: DataFrame, entry: str, at: str, id_col: str, status: str, *, most: int = 5, fan: int = scan.FAN) -> DataFrame:
    """attempts in the order of time and id -> id, entry, failures (retryable ones since the entry's last success), next_status, and
    next_at_ms, when a retry is due; the most-th failure in a row, or one that cannot be retried, is terminal. An ordered scan
    carries the counts, so that an entry with very many attempts is spread over tasks."""
    rows = scan.positions(attempts.select(entry, id_col, at, status), entry, [at, id_col])
    ok, failed = F.col(status) == "succeeded", F.col(status) == "failed_retryable"
    rows = rows.withColumn("__s", F.struct(ok.alias("ok"), F.when(failed, 1).otherwise(0).cast("long").alias("n")))
    since = lambda a, b: F.when(b["ok"], b).otherwise(F.struct(a["ok"].alias("ok"), (a["n"] + b["n"]).alias("n")))
    seen = scan.exclusive_scan(rows, entry, "pos", "__s", since, fan=fan)
    failures = F.when(ok, F.lit(0).cast("long")).otherwise(F.coalesce("before.n", F.lit(0)) + F.col("__s.n"))
    seen = seen.withColumn("failures", failures)
    following = F.when(ok, "succeeded").when(~failed | (F.col("failures") >= most), "failed_terminal").otherwise("failed_retryable")
    due = F.unix_millis(F.col(at).cast("timestamp")) + scoring.retry_delay_ms(F.col("failures"), F.lit("0"), jitter=0.0).cast("long")
    return seen.withColumn("next_status", following).select(id_col, entry, "failures", "next_status", F.when(F.col("next_status") == "failed_retryable", due).alias("next_at_ms"))


def consume(spark: SparkSession, inbox: str, schema: StructType, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """A queue consumer: reads what is new in an append-only Parquet inbox, hands it over in micro-batches, then stops."""
    stream = spark.readStream.schema(schema).parquet(inbox)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def late_completions(frontier: DataFrame, completions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completions of the active attempt within its lease, and the late rest, which is recorded without touching the frontier."""
    j = completions.join(frontier, "entry_id", "left")
    on_time = F.coalesce((F.col("attempt_id") == F.col("active_attempt_id")) & (F.col("completed_at") <= F.col("lease_expires_at")), F.lit(False))
    return j.where(on_time), j.where(~on_time)


def expired(cache: DataFrame, expires_at: str, now) -> DataFrame:
    """Entries of a TTL cache that are still alive."""
    return cache.where(F.col(expires_at) > F.lit(now))


def lease(frontier: DataFrame, now, n: int) -> DataFrame:
    """The next n entries to hand out: eligible, or with an expired lease. One writer runs this per micro-batch."""
    open_ = F.col("crawl_status").isin("idle", "scheduled", "succeeded", "failed_retryable") | (F.col("lease_expires_at") <= F.lit(now))
    return frontier.where(open_ & (F.col("next_crawl_at") <= F.lit(now))).orderBy("next_crawl_at", F.desc("priority"), F.col("last_crawled_at").asc_nulls_first(), "entry_id").limit(n)


def tick(control: DataFrame, plan: Callable[[], DataFrame]) -> DataFrame | None:
    """One scheduler tick: the plan if the newest control row says enabled; without a row the scheduler is disabled."""
    row = control.orderBy(F.desc("updated_at")).limit(1).collect()
    return plan() if row and row[0]["state"] == "enabled" else None
