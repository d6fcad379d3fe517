"""Physical plans: pushed filters, pruned columns, no Python where built-in functions suffice, no cartesian products or nested loops."""

import re

import pytest

from tessera.plans import catalog

PYTHON = {"f15_nfkc", "f21_resolve_links", "d3_semantic_chunks", "d4_embedding_batches",
          "ud2_embedding_port", "ud3_fact_extraction_port", "ud9_dispatch"}


LITERALS = {"p12_robots_longest_prefix"}  # a join with a fixed list of literal rules


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(catalog.QUERIES["s1_table_scan"](spark, sf))
    assert "EqualTo(lang,fr)" in p and re.search(r"ReadSchema: struct<doc_id:bigint,lang:string,source:string>", p)
    p = plan(catalog.QUERIES["p1_conditional_filters"](spark, sf))
    assert "In(source, [src1,src2])" in p and "text" not in re.search(r"ReadSchema: struct<([^>]*)>", p)[1]
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(catalog.QUERIES["p8_path_glob"](spark, sf))


def test_topn_is_one_pass(spark, sf):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["o1_lease_topn"](spark, sf))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in PYTHON])
def test_no_python_and_no_cartesian_product(spark, sf, name):
    p = plan(catalog.QUERIES[name](spark, sf))
    assert not re.search("Python|Pandas|InArrow|CartesianProduct", p)
    assert name in LITERALS or "NestedLoopJoin" not in p
