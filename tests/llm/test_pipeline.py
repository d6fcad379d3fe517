"""The pipeline on small data: each stage against its operator's definition."""

import re

import corpus_pipeline
import __spark_entry__


def test_registered():
    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert {re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)} == {str(i) for i in range(1, 13)}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = docs.cache()
        assert 0 < docs.count() <= before, name
        before = docs.count()
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts))
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_messy_documents(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet")
    long_text = "Ein sehr langer Text mit Worten die wechseln " * 3000
    rows = [(None, None, None, None, None), (None, "a text without an id", "en", "s", 1), (900_001, None, "en", "s", None), (900_002, "", None, "s", 0), (900_003, "!!! ###", "en", "s", 7),
            (900_004, long_text, "de", "s", len(long_text)), (900_005, "the same words in this row", "en", "s", 1), (900_005, "the same words in this row", "en", "s", 1),
            (900_006, "The same words, in this row!", "en", "t", 1)]
    docs = base.unionByName(spark.createDataFrame(rows, base.schema))
    for name in ("keep_id", "kept", "class_id", "lang_pred", "score", "bad", "id", "text_sha256", "h"):
        docs = docs.selectExpr("*", f"'clash' AS {name}")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        got = docs.where("doc_id >= 900000 or doc_id is null").select("doc_id", "text", "score").collect()
        ids = [r["doc_id"] for r in got]
        assert all(r["score"] == "clash" for r in got), name
        if name == "language_id":
            assert not {900_001, 900_002, 900_003} & set(ids) and {900_004, 900_005, 900_006} <= set(ids)
        if name == "exact_dedup":
            assert ids.count(900_005) == 1 and ids.count(900_006) == 1
        if name == "near_dedup":
            assert ids.count(900_005) + ids.count(900_006) == 1 and 900_004 in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
