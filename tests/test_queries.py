"""Every registered query of the engine against its SQL in DuckDB; goldens of single functions."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import scoring as s
from tessera.functions import text as t
from tessera.functions import web as w
from tessera.operators import chunker, relational
from tessera.plans import catalog
from tessera.streaming import leases, state

TABLES = "documents embeddings pages benchmark labels conversations region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return str(v) if isinstance(v, (datetime.datetime, datetime.date)) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name in catalog.ORACLES:
        o = duck.sql(catalog.ORACLES[name])
        assert sorted(o.columns) == columns
        want = sorted(str([plain(dict(zip(o.columns, r, strict=True))[c]) for c in columns]) for r in o.fetchall())
        assert got == want
    else:
        assert got


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


def test_priority_goldens(spark):
    c = F.lit
    assert one(spark, s.frontier_priority(c(0.75), c(4), c(2), c(0.5), c(25), c(10)), a=1) == 440
    assert one(spark, s.frontier_priority(c(5.0), c(99), c(0), c(9.0), c(900), c(9000)), a=1) == 1000
    assert one(spark, s.frontier_priority(c(None).cast("double"), c(1), c(0), c(1.0)), a=1) == 100 + 250 + 15


def test_trust_goldens(spark):
    assert one(spark, s.evidence_strength(F.lit(2), F.lit(2), F.lit(2), F.lit(0.7), F.lit(False)), a=1) > 0.6
    assert one(spark, s.source_type(F.lit("https://best-laser-clinics.example")), a=1) == "affiliate"
    assert one(spark, s.source_trust(F.lit("affiliate"), F.lit(True), F.lit(2)), a=1) == pytest.approx(0.38 - 0.06 - 0.08 - 0.12)


def test_text_edges(spark):
    assert one(spark, t.token_count(F.col("a")), a="  ") == 0
    assert one(spark, t.normalize_keyword(F.col("a")), a=" laser!") == "laser "
    assert one(spark, t.normalize_concept(F.col("a")), a=" What is X? ") == "what is x?"
    assert one(spark, t.title_case(F.col("a")), a="what IS x") == "What IS X"
    assert one(spark, t.collapse(F.col("a")), a="a  b ") == "a b"
    assert one(spark, t.ngrams(F.col("a"), 2), a="a b a") == ["a", "b", "a b", "b a"]
    assert one(spark, t.word_windows(F.col("a"), 3, 1), a="1 2 3 4 5 6") == ["1 2 3", "3 4 5", "5 6"]
    assert one(spark, t.geo_key(F.lit(" fr "), F.lit(""), F.lit("Paris")), a=1) == "FR:paris"
    assert one(spark, t.has_word(F.lit("éprice"), "price"), a=1) is True


def test_web_edges(spark):
    n = lambda u: one(spark, w.normalize_url(F.col("a")), a=u)
    assert n("HTTP://Ex.COM.:80") == "http://ex.com/" and n("https://a.b:8443/x?y#z") == "https://a.b:8443/x?y" and n("ftp://a") is None and n("nope") is None
    unsafe = lambda h: one(spark, w.is_unsafe_host(F.col("a")), a=h)
    assert [unsafe(h) for h in ("10.1.2.3", "172.20.0.1", "localhost", "::1", "fd00::1", "8.8.8.8", "example.com")] == [True] * 5 + [False] * 2
    assert one(spark, w.plain_text(F.col("a")), a="<p>a&amp;lt; <script>x</script>b</p>") == "a< b"
    assert one(spark, w.glob_to_regex and F.lit("/a.b/c").rlike(w.glob_to_regex("/a.b/*")), a=1) is True
    policy = lambda u: one(spark, w.crawl_policy(F.col("a"), ["*.x.com"], ["bad.x.com"], [], []), a=u)
    assert [policy(u) for u in ("http://x.com/", "http://a.x.com/", "http://bad.x.com/", "?")] == ["host_not_allowed", "allowed", "host_denied", "invalid_url"]


MARKDOWN = "# Guide\n\nIntro words here.\n\n## Costs\n\nOne two three.\n\nFour five.\n\n### Is it safe?\n\nYes it is.\n\n## End\n\n" + " ".join(f"w{i}" for i in range(25))


def test_chunker():
    got = chunker.chunks(MARKDOWN, 10, 2, "Title")
    assert [c[0] for c in got[:3]] == [("Guide",), ("Guide", "Costs"), ("Guide", "Costs", "Is it safe?")]
    assert got[1][2] == "One two three.\n\nFour five." and [len(c[2].split()) for c in got[3:]] == [10, 10, 9]
    assert chunker.chunks("# Only heading", 10, 2, "T") == [((), "T", "# Only heading")] and chunker.chunks(" ", 10, 2) == []
    assert chunker.chunks("# A\n### C\nx", 10, 2)[0][0] == ("A", None, "C")
    words = " ".join(str(i) for i in range(95))
    assert " ".join(c[2] for c in chunker.chunks(words, 10, 0)).split() == words.split()


def test_upsert_and_receipts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, created string")
    new = spark.createDataFrame([(2, "B", "new"), (3, "C", "new")], "k int, v string, created string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"], ["v"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", "new")]
    assert sorted(r["k"] for r in relational.insert_ignore(old, new.unionByName(new), ["k"]).collect()) == [1, 2, 3]
    assert relational.in_list(old, "k", []).count() == 0


def test_rate_limit_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).where("user_id < 40")
    inbox = str(tmp_path / "inbox")
    events.coalesce(1).write.parquet(inbox)
    batch = state.rate_limit(events, "user_id", "ts", "event_id", limit=3, window_seconds=86400.0)
    stream = spark.readStream.schema(events.schema).parquet(inbox)
    q = state.rate_limit_stream(stream, "user_id", "ts", "event_id", limit=3, window_seconds=86400.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, batch.collect()))


def test_consumer_is_idempotent(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    rows.write.parquet(inbox)
    handle = leases.append_epoch(out, lambda batch: batch.dropDuplicates(["k"]))
    for n in range(2):  # the second consumer has lost its checkpoint and takes all again
        state.consume(spark, inbox, rows.schema, str(tmp_path / f"checkpoint{n}"), handle)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b")]


def test_run_machine(spark):
    rows = [(1, i, to) for i, to in enumerate(["running", "leased", "running", "succeeded", "queued"])]
    got = state.run_machine(spark.createDataFrame(rows, "run long, seq long, to string"), "run", "seq", "to").orderBy("seq").collect()
    assert [r["outcome"] for r in got] == ["rejected", "applied", "applied", "applied", "rejected"] and got[-1]["state"] == "succeeded"
