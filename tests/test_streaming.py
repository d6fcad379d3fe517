"""Ordered scans, state machines, rate limits and stateful streams against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.streaming import leases, state


@pytest.mark.parametrize("fan", [4, 256])
def test_scan_of_a_key_with_half_of_all_rows(spark, fan):
    rng = random.Random(1)
    rows = [(1, i, rng.choice([None, "a", "b", "c"])) for i in range(300)] + [(None, i, "n") for i in range(3)] + [(k, i, "x") for k in range(2, 9) for i in range(30)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as on tables that fill their partitions
    try:
        df = scan.positions(spark.createDataFrame(rows, "k long, i long, v string"), "k", ["i"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert df.where("k = 1").select(F.expr("pos div 8589934592")).distinct().count() > 1  # ranges that hold the key
    got = scan.exclusive_scan(df, "k", "pos", "v", lambda a, b: F.concat(a, b), fan=fan)
    want, so_far = [], {}
    for k, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want.append((k, i, v, so_far.get(k) or None))
        so_far[k] = so_far.get(k, "") + (v or "")
    assert sorted(map(str, map(tuple, got.drop("pos").collect()))) == sorted(map(str, want))
    assert scan.exclusive_scan(df.limit(0), "k", "pos", "v", lambda a, b: F.concat(a, b), fan=fan).count() == 0


@pytest.mark.parametrize("fan", [4, 256])
def test_run_machine_equals_a_loop(spark, fan):
    rng, names = random.Random(2), [*state.RUN_TRANSITIONS, "?", None]
    rows = [(1, i, rng.choice(names)) for i in range(300)] + [(None, i, "leased") for i in range(3)] + [(k, i, rng.choice(names)) for k in range(2, 9) for i in range(40)]
    want, now = [], {}
    for k, i, to in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        ok = to in state.RUN_TRANSITIONS[now.get(k, "queued")]
        now[k] = to if ok else now.get(k, "queued")
        want.append((k, i, "applied" if ok else "rejected", now[k]))
    got = state.run_machine(spark.createDataFrame(rows, "k long, i long, to string"), "k", "i", "to", fan=fan).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and {r[2] for r in want} == {"applied", "rejected"}


@pytest.mark.parametrize("fan", [4, 256])
def test_rate_limit_equals_a_loop(spark, fan):
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(seconds=rng.randint(0, 4000)), i) for i in range(400)] + [(k, start + dt.timedelta(seconds=rng.randint(0, 9)), 2000 + 10 * k + j) for k in (5, 6, 7) for j in range(6)]
    rows += [(8, start + dt.timedelta(seconds=100 * i), 5000 + i) for i in range(5)]  # each at the end of a window
    want = []
    for k in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == k))
        got, _ = state.rate_limit_fold([t for t, _ in mine], None, 3, 100.0)
        want += [(k, i, *g) for (_, i), g in zip(mine, got, strict=True)]
    df = spark.createDataFrame([*rows, (1, None, -1)], "k long, at timestamp, id long")
    assert sorted(map(tuple, state.rate_limit(df, "k", "at", "id", limit=3, window_seconds=100.0, fan=fan).collect())) == sorted(want)
    assert state.rate_limit(df.limit(0), "k", "at", "id", limit=3, window_seconds=100.0).count() == 0


@pytest.mark.parametrize("fan", [4, 256])
def test_retry_schedule_equals_a_loop(spark, fan):
    rng = random.Random(6)
    rows = [(1, i, rng.choice(["failed_retryable"] * 6 + ["succeeded", "cancelled"])) for i in range(200)] + [(k, 1000 + 10 * k + i, "failed_retryable") for k in (2, 3) for i in range(7)]
    want, streak = [], {}
    for entry, i, status in sorted(rows):
        streak[entry] = 0 if status == "succeeded" else streak.get(entry, 0) + (status == "failed_retryable")
        over = "succeeded" if status == "succeeded" else "failed_terminal" if status != "failed_retryable" or streak[entry] >= 5 else "failed_retryable"
        want.append((i, entry, streak[entry], over, 1000 * i + min(21_600_000, 300_000 * 2 ** streak[entry]) if over == "failed_retryable" else None))
    df = spark.createDataFrame(rows, "entry long, id long, status string").withColumn("at", F.timestamp_seconds("id"))
    assert sorted(map(tuple, state.retry_schedule(df, "entry", "at", "id", "status", fan=fan).collect())) == sorted(want)


START = dt.datetime(2024, 1, 1)


def leases_by_hand(events, lease, watermark):
    """events(entry, id, kind, second) -> (entry, id, outcome, second)."""
    out, held = [], {}
    for entry, id_, kind, t in sorted(events, key=lambda e: (e[3], e[1])):
        if entry in held and held[entry][1] <= t:
            out.append((entry, held[entry][0], "expired", held.pop(entry)[1]))
        if kind == "ack":
            out.append((entry, held.pop(entry)[0], "completed", t) if entry in held else (entry, id_, "late", t))
        elif entry in held:
            out.append((entry, id_, "busy", t))
        else:
            held[entry] = (id_, t + lease)
            out.append((entry, id_, "leased", t))
    return sorted(out + [(e, i, "expired", end) for e, (i, end) in held.items() if end <= watermark])


def test_leases_return_by_timer_and_survive_a_restart(spark, tmp_path):
    rng, schema = random.Random(4), "entry long, id long, kind string, at timestamp"
    events = [(rng.randint(0, 9), i, rng.choice(["request", "request", "ack"]), 20 * i) for i in range(300)] + [(77, 900, "request", 5000)]
    batches = [[e for e in events if lo <= e[3] < lo + 2000] for lo in (0, 2000, 4000)]
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for batch in batches:  # the stream stops after each batch and starts again from its checkpoint
        spark.createDataFrame([(e, i, k, START + dt.timedelta(seconds=t)) for e, i, k, t in batch], schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = leases.lease_stream(spark.readStream.schema(schema).parquet(inbox), "entry", lease_seconds=150, delay="60 seconds")
        leases.drain(stream, checkpoint, leases.append_epoch(out))
    zero = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = sorted((r["entry"], r["id"], r["outcome"], (r["at_ms"] - zero) // 1000) for r in spark.read.parquet(out).collect())
    assert got == leases_by_hand(events, 150, max(e[3] for e in events) - 60)
    assert (77, 900, "expired", 5150) in got  # no event of this entry followed
    assert {r[2] for r in got} == {"leased", "busy", "completed", "late", "expired"}
    assert "RocksDB" not in spark.conf.get(leases.STORE, "")


def test_completions_on_time_late_and_missing(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    a, b = str(tmp_path / "leases"), str(tmp_path / "acks")
    rows = [(i, at(60 * i), at(60 * i + 100)) for i in range(30)] + [(-1, at(99_999), at(99_999))]
    acks = [(i, at(60 * i + {0: 50, 1: 130, 2: 400}[i % 4])) for i in range(30) if i % 4 < 3] + [(-1, at(99_998)), (500, at(10))]
    left, right = "lease_id long, leased_at timestamp, expires_at timestamp", "lease_id long, acked_at timestamp"
    spark.createDataFrame(rows, left).coalesce(1).write.parquet(a)
    spark.createDataFrame(acks, right).coalesce(1).write.parquet(b)
    for _ in range(2):
        s = leases.completion_stream(spark.readStream.schema(left).parquet(a), spark.readStream.schema(right).parquet(b), grace="300 seconds", delay="10 seconds")
        leases.drain(s, str(tmp_path / "c"), leases.append_epoch(str(tmp_path / "out")))
    got = {r["lease_id"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: ["on_time", "late", "missing", "missing"][i % 4] for i in range(30)}


def test_deliveries_and_epochs_again_change_nothing(spark, tmp_path):
    schema = "id long, at timestamp"
    rows = [(i, START + dt.timedelta(seconds=i)) for i in range(50)]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    handle = leases.append_epoch(out)
    for part in (rows[:30] + rows[:5], rows[20:], rows[45:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        leases.drain(leases.once(spark.readStream.schema(schema).parquet(inbox), ["id"], "at", "1 hour"), str(tmp_path / "c"), handle)
    read = lambda: sorted(r["id"] for r in spark.read.parquet(out).collect())
    assert read() == list(range(50))
    handle(spark.createDataFrame(rows[:30], schema), 0)  # a replayed epoch
    assert read() == list(range(50))
