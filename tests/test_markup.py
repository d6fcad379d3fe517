"""Goldens of the markup functions and of the functions that need Python, through their queries."""

import json
import unicodedata
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.plans import catalog
from tessera.sources.sinks import staged


def of(spark, column, html):
    return spark.createDataFrame([(html,)], "h string").select(column.alias("x")).first()["x"]


def test_headings(spark):
    html = "<H1 class='a'>One &amp;lt; <b>two</b></H1><h2>x</h3></h2><h7>no</h7><h3>\n</h3>"
    assert [tuple(h) for h in of(spark, markup.headings(F.col("h")), html)] == [(1, "One < two", 0), (2, "x", 1), (3, "", 2)]
    text = "intro\r\n## Two  words ##x \n#no\n###### Six&#39;s\n"
    assert [tuple(h) for h in of(spark, markup.headings(F.lit(html), F.col("h")), text)] == [(2, "Two words ##x", 1), (6, "Six's", 3)]
    assert len(of(spark, markup.headings(F.lit(html), F.col("h")), "no heading")) == 3 and of(spark, markup.headings(F.col("h")), None) == []


def test_maps_and_hints(spark):
    html = '<html class="x" LANG="fr-CA"><meta property="og:title" content="a"><META content="b" property="og:title"><meta name="og:x" content="n"><meta property="og:y" content=""><link rel="x alternate" hreflang="de" href="/d?a&amp;b">'
    assert of(spark, markup.meta_map(F.col("h"), "property", "og:"), html) == {"og:title": "b"} and of(spark, markup.hreflang_map(F.col("h")), html) == {"de": "/d?a&b"}
    headers = F.create_map(F.lit("Content-Language"), F.lit("en, fr"), F.lit("ETAG"), F.lit("1"), F.lit("etag"), F.lit("2"))
    assert [tuple(x) for x in of(spark, markup.language_hints(F.col("h"), headers), html)] == [("fr-CA", 0.9, "html_lang"), ("en", 0.7, "meta")]
    assert of(spark, markup.cache_headers(headers), html) == {"etag": "1"}
    assert of(spark, markup.meta_map(F.col("h"), "property", "og:"), None) == {} == of(spark, markup.hreflang_map(F.col("h")), "")


def test_structured_data(spark):
    html = ('<script type="application/ld+json">{bad</script><SCRIPT TYPE=\'application/ld+json\'> {"a": &quot;x&quot;} </script><script type="application/ld+json">null</script>'
            '<div itemscope itemtype="T"><b itemprop="name">N &amp; <i>n</i></b><b itemprop="name">M</b><meta itemprop="k" content="v"></div><p itemscope></p>')
    df = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    got = df.select(F.transform(markup.json_ld(F.col("h")), lambda x: F.struct(x["position"], F.to_json(x["data"]).alias("j"))).alias("j"), markup.microdata(F.col("h")).alias("m")).collect()
    assert [(x["position"], json.loads(x["j"])) for x in got[0]["j"]] == [(1, {"a": "x"}), (2, None)]
    assert [tuple(x) for x in got[0]["m"]] == [(0, "T", {"name": "M", "k": "v"}), (1, None, {})]
    assert got[1]["j"] == got[2]["j"] == got[1]["m"] == []


def test_breadcrumbs(spark):
    cases = [({"@type": "BreadcrumbList", "itemListElement": [{"position": 2, "name": "B"}, {"position": 1, "item": {"name": "A"}}, "s", 5, {"name": 5}, {"name": ""}]}, ["B", "A", "s"]),
             ([[{"x": {"@type": ["A", "BreadcrumbList"], "itemListElement": ["one"]}}], {"@type": "BreadcrumbList", "itemListElement": ["two"]}], ["one", "two"]),
             ({"@type": "BreadcrumbList", "itemListElement": "no"}, []), ({"a": 1}, None), ("BreadcrumbList", None), ({"a": [[[[[{"b": {"@type": "BreadcrumbList", "itemListElement": ["deep"]}}]]]]]}, ["deep"])]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "id int, j string").select("id", F.parse_json("j").alias("v"))
    got = {r["id"]: r["names"] for r in markup.breadcrumbs(df, ["id"], "v", staged).collect()}
    assert got == {i: n for i, (_, n) in enumerate(cases) if n is not None}
    with pytest.raises(ValueError, match="deeper"):
        markup.breadcrumbs(df, ["id"], "v", staged, most=3)


def test_python_functions_equal_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["x"] for r in catalog.QUERIES["f15_nfkc"](spark, sf).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFKC", t).lower() for i, t in texts.items()}
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import re

    want = sorted((i, urljoin(p["url"], h)) for i, p in pages.items() for h in re.findall(r'<a\s[^>]*href="([^"]*)"', p["html"]))
    assert sorted((r["page_id"], r["link"]) for r in catalog.QUERIES["f21_resolve_links"](spark, sf).collect()) == want


def test_header_bounds(spark):
    from tessera.functions.text import bounded_headers

    h = F.create_map(F.lit("A"), F.col("h"), F.lit("a"), F.lit("later"), F.lit("B"), F.lit("x" * 10), F.lit("C"), F.lit(""))
    assert of(spark, bounded_headers(h, 2, 4), "value") == {"a": "valu", "b": "xxxx"}
    assert of(spark, bounded_headers(F.create_map(F.lit("A"), F.col("h"), F.lit("B"), F.lit("b")), 1, 4), "v") == {"a": "v"}
