"""The jobs: against their SQL, over growing input, run again, and from their command lines."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import activity_model, chunk_store, queries
from jobs.cli import read_config

ROOT = Path(__file__).resolve().parents[1]
DOCS, VECTORS, EVENTS = "doc_id long, text string, lang string", "vec_id long, embedding array<double>", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def rows_of(df):
    return sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_job_query_equals_sql(spark, sf, name):
    settings = rows_of(spark.sql("SET"))
    got, duck = queries.QUERIES[name](spark, sf), duckdb.connect()
    for table in ("documents", "embeddings", "events"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = duck.sql(queries.ORACLES[name])
    at = {c: k for k, c in enumerate(want.columns)}
    assert sorted(want.columns) == sorted(got.columns)
    assert rows_of(got) == sorted(str([r[at[c]] for c in sorted(want.columns)]) for r in want.fetchall())
    assert settings == rows_of(spark.sql("SET"))


def test_chunk_store_cases(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(700))
    rows = [(1, long, "en"), (2, long.upper().replace(" ", "\n"), "fr"), (3, "few words", None), (4, " \n", "en"), (5, None, "en"), (None, "no id", "en"), (6, "few  words", ""), (7, " ".join("x" * 60), "de")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(1, [1.0]), (7, None), (3, [0.5])], VECTORS).write.parquet(f"{tmp_path}/vectors")
    go = lambda: chunk_store.run(spark, f"{tmp_path}/documents", f"{tmp_path}/vectors", f"{tmp_path}/out")
    got = sorted((r["doc_id"], r["chunk_index"], r["total_chunks"], r["token_count"], r["documents"], r["lang"], r["status"]) for r in go().collect())
    assert got == [(1, 0, 3, 320, 2, "en", "embedded"), (1, 1, 3, 320, 2, "en", "embedded"), (1, 2, 3, 140, 2, "en", "embedded"), (3, 0, 1, 2, 2, "und", "skipped"), (7, 0, 1, 60, 1, "de", "pending")]
    assert {p for p in os.listdir(f"{tmp_path}/out") if "=" in p} == {"lang=en", "lang=und", "lang=de"}
    before = rows_of(spark.read.parquet(f"{tmp_path}/out"))
    assert rows_of(go().select(spark.read.parquet(f"{tmp_path}/out").columns)) == before
    spark.createDataFrame(rows[:1], DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents")
    assert {r["lang"] for r in go().collect()} == {"en"}  # nothing stale is left
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents")
    assert go().count() == 0


def test_chunk_store_never_gathers_copies(spark):
    docs = spark.createDataFrame([(i, "one text" if i % 3 else f"text {i}", "en") for i in range(300)], DOCS)
    rows = chunk_store.chunks(docs, spark.createDataFrame([], VECTORS), chunk_store.DEFAULTS)
    assert rows.count() == 101 and rows.agg(F.max("documents")).first()[0] == 200
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan


def model_by_hand(rows):
    out = {}
    for _, ts, user, kind, value in rows:
        status = {"error": "failed_retryable", "signup": "cancelled"}.get(kind, "succeeded")
        g = out.setdefault((str(ts)[:10] if ts else "unknown", status), [0, set(), 0, []])
        g[0] += 1
        g[1] |= {user} - {None}
        g[2] += round((value or 0) * 100)
        g[3] += [ts] if ts else []
    return sorted((*k, n, len(users), cents / 100, min(at, default=None), max(at, default=None)) for k, (n, users, cents, at) in out.items())


def test_activity_model_takes_only_what_is_new(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    odd = spark.createDataFrame([(-1, None, 3, "click", 1.5), (-2, None, None, "error", None), (-3, None, 40_000, "click", 2.0), (-4, None, 3, "click", 1.25)], EVENTS)
    parts = [events.where("event_id % 3 = 0"), events.where("event_id % 3 = 1").unionByName(odd), events.where("event_id % 3 = 2")]
    inbox, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    columns = ["day", "status", "attempts", "entries", "amount", "first_at", "last_at"]
    taken = []
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(inbox)
        taken += [tuple(r) for r in part.collect()]
        for _ in range(2):  # the second run finds nothing new
            model = activity_model.run(spark, inbox, out, checkpoint)
            got = sorted((*r[:4], float(r[4]), *r[5:]) for r in (tuple(x[c] for c in columns) for x in model.collect()))
            assert got == model_by_hand(taken)
            batches = spark.read.parquet(f"{out}/partials").select("batch").distinct().count()
            assert batches == k + 1
    before = rows_of(model)
    activity_model.update(parts[1], 1, out, activity_model.DEFAULTS)  # a batch that was cut off after its writes runs again
    assert rows_of(activity_model.run(spark, inbox, out, checkpoint)) == before
    whole = activity_model.merge(activity_model.partials(spark.read.parquet(inbox), "yyyy-MM-dd"))
    assert rows_of(whole) == before


def test_only_touched_days_are_written(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = str(tmp_path / "out")
    activity_model.update(events, 0, out, activity_model.DEFAULTS)
    stamp = lambda: {d: os.stat(f"{out}/model/{d}").st_mtime_ns for d in os.listdir(f"{out}/model") if "=" in d}
    before = stamp()
    activity_model.update(events.where("ts < '2024-01-02'"), 1, out, activity_model.DEFAULTS)
    assert [d for d, t in stamp().items() if before[d] != t] == ["day=2024-01-01"]
    plan = spark.read.schema(activity_model.PARTIAL).parquet(f"{out}/partials").where("batch = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"min_tokens": 5}')
    assert read_config(spark, str(tmp_path / "c.json"), chunk_store.DEFAULTS) == chunk_store.DEFAULTS | {"min_tokens": 5}
    (tmp_path / "c.json").write_text('{"min_token": 5}')
    with pytest.raises(ValueError, match="min_token"):
        read_config(spark, str(tmp_path / "c.json"), chunk_store.DEFAULTS)
    for job in (chunk_store, activity_model):
        assert json.loads(Path(job.__file__).with_suffix(".json").read_text()) == job.DEFAULTS


@pytest.mark.parametrize(("job", "paths"), [("chunk_store", ["documents", "embeddings", "output"]), ("activity_model", ["events", "output", "checkpoint"])])
def test_command_lines(spark, sf, tmp_path, job, paths):
    args = [x for p in paths for x in (f"--{p}", f"{tmp_path}/{p}" if p in ("output", "checkpoint") else f"{sf}/{p}.parquet")]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args], cwd=ROOT, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"jobs.{job} " in done.stderr and "read " in done.stderr and "rows" in done.stderr
    assert spark.read.parquet(f"{tmp_path}/output" + "/model" * (job == "activity_model")).count()
