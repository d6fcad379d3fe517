"""What the content extractor reads out of a page's markup, as Column expressions: headings, meta maps, language and geo hints,
JSON-LD, microdata, breadcrumbs. Null markup counts as empty. Patterns, entities and their order are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import collapse
from tessera.functions.web import ENTITIES_EXTRACT, decode_entities

JSON_LD = "(?i)<script\\b[^>]*type=[\"']application/ld\\+json[\"'][^>]*>([\\s\\S]*?)</script>"
ITEM = "(?i)<([a-z0-9-]+)\\b[^>]*itemscope[^>]*>([\\s\\S]*?)</\\1>"
PROPERTY = "(?i)<([a-z0-9-]+)\\b[^>]*itemprop=[\"']([^\"']+)[\"'][^>]*>([\\s\\S]*?)</\\1>"
PROPERTY_TAG = "(?i)<[a-z0-9-]+\\b[^>]*itemprop=[\"'][^\"']+[\"'][^>]*>"
HEADING = "(?i)<h([1-6])\\b[^>]*>([\\s\\S]*?)</h\\1>"
MARKDOWN_HEADING = "^(#{1,6})\\s+(.+?)\\s*$"
PAIRS = "array<struct<key:string,value:string>>"


def decode(c: Column) -> Column:
    return decode_entities(c, ENTITIES_EXTRACT)


def clean(c: Column) -> Column:
    """Without tags, decoded, white space collapsed."""
    return collapse(decode(F.regexp_replace(c, "<[^>]+>", " ")))


def attribute(tag: Column, name: str) -> Column:
    """The first quoted value of an attribute whose name ends so, decoded; null for none or an empty one."""
    raw = F.regexp_extract(tag, f"(?i){name}\\s*=\\s*[\"']([^\"']+)[\"']", 1)
    return F.when(raw != "", decode(raw))


def _all(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(0))


def tags(html: Column, name: str) -> Column:
    return _all(html, f"(?i)<{name}\\b[^>]*>")


def last_wins(pairs: Column) -> Column:
    """array<struct<key, value>> -> map; of a repeated key the last value counts."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(pairs.cast(PAIRS), empty, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _given(pairs: Column) -> Column:
    return F.filter(pairs, lambda e: e["key"].isNotNull() & e["value"].isNotNull())


def meta_map(html: Column, attribute_name: str, prefix: str) -> Column:
    """Contents of the meta tags whose name or property starts so."""
    found = F.transform(tags(html, "meta"), lambda t: _pair(attribute(t, attribute_name), attribute(t, "content")))
    return last_wins(F.filter(_given(found), lambda e: F.lower(e["key"]).startswith(prefix)))


def hreflang_map(html: Column) -> Column:
    """Links of alternate languages."""
    found = F.transform(tags(html, "link"), lambda t: _pair(F.when(F.lower(attribute(t, "rel")).contains("alternate"), attribute(t, "hreflang")), attribute(t, "href")))
    return last_wins(_given(found))


def cache_headers(headers: Column) -> Column:
    """The caching headers of a map<string,string>, by lower-case name; the first of names that differ in case counts."""
    wanted = F.array(*[F.lit(k) for k in ("cache-control", "expires", "etag", "last-modified")])
    first = lambda k: F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == k)
    found = F.transform(wanted, lambda k: _pair(k, F.get(first(k), F.lit(0))["value"]))
    return last_wins(F.filter(_given(found), lambda e: e["value"] != ""))


def headings(html: Column, markdown: Column | None = None) -> Column:
    """array<struct<level, text, position>>: of the markdown by line number if it has any, else of the markup by order."""
    found = F.transform(_all(html, HEADING), lambda h, i: F.struct(F.regexp_extract(h, HEADING, 1).cast("int").alias("level"), clean(F.regexp_extract(h, HEADING, 2)).alias("text"), i.alias("position")))
    if markdown is None:
        return found
    lines = F.transform(F.split(F.coalesce(markdown, F.lit("")), "\\r?\\n"), lambda x, i: F.struct(
        F.length(F.regexp_extract(x, MARKDOWN_HEADING, 1)).alias("level"), collapse(decode(F.regexp_extract(x, MARKDOWN_HEADING, 2))).alias("text"), i.alias("position")))
    mine = F.filter(lines, lambda h: h["level"] > 0)
    return F.when(F.size(mine) > 0, mine).otherwise(found)


def language_hints(html: Column, headers: Column | None = None) -> Column:
    """array<struct<tag, confidence, source>>: the html element's, then the content-language header's first."""
    hint = lambda tag, sure, source: F.struct(tag.alias("tag"), F.lit(sure).alias("confidence"), F.lit(source).alias("source"))
    found = [hint(F.regexp_extract(F.coalesce(html, F.lit("")), "(?i)<html\\b[^>]*\\blang=[\"']([^\"']+)[\"'][^>]*>", 1), 0.9, "html_lang")]
    if headers is not None:
        content = F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == "content-language"), F.lit(0))["value"]
        found.append(hint(F.coalesce(F.trim(F.substring_index(content, ",", 1)), F.lit("")), 0.7, "meta"))
    return F.filter(F.array(*found), lambda h: h["tag"] != "")


def json_ld(html: Column) -> Column:
    """array<struct<position, data variant>>: blocks that parse; positions count all blocks."""
    body = lambda b: F.try_parse_json(decode(F.regexp_replace(F.regexp_extract(b, JSON_LD, 1), "^\\s+|\\s+$", "")))
    return F.filter(F.transform(_all(html, JSON_LD), lambda b, i: F.struct(i.alias("position"), body(b).alias("data"))), lambda x: x["data"].isNotNull())


def microdata(html: Column) -> Column:
    """array<struct<position, item_type, properties map>>: an item reaches to the first closing tag of its name; a content
    attribute overrides a property's text, later ones override earlier ones."""
    def properties(inner: Column) -> Column:
        texts = F.transform(_all(inner, PROPERTY), lambda p: _pair(F.regexp_extract(p, PROPERTY, 2), clean(F.regexp_extract(p, PROPERTY, 3))))
        contents = _given(F.transform(_all(inner, PROPERTY_TAG), lambda t: _pair(attribute(t, "itemprop"), attribute(t, "content"))))
        return last_wins(F.concat(texts, contents))

    return F.transform(_all(html, ITEM), lambda m, i: F.struct(i.alias("position"), attribute(m, "itemtype").alias("item_type"), properties(F.regexp_extract(m, ITEM, 2)).alias("properties")))


def _text_of(value: Column) -> Column:
    """A variant's string if it is one and not empty."""
    x = F.try_variant_get(value, "$", "string")
    return F.when((F.schema_of_variant(value) == "STRING") & (x != ""), x)


def breadcrumbs(blocks: DataFrame, by: list[str], data: str, staged, most: int = 64) -> DataFrame:
    """blocks(*by, data variant) -> *by, names: of every breadcrumb list anywhere in the data, one after the other.

    The data are opened level by level, for all rows at once, as long as there is something inside; lists are not opened
    further. Members of an object are taken by name. JSON deeper than `most` levels is an error.
    """
    spark = blocks.sparkSession
    level, found = blocks.select(*by, F.col(data).alias("v"), F.array().cast("array<string>").alias("at")), None
    for _ in range(most):
        kind = F.try_variant_get("v", "$['@type']", "array<string>")
        level = staged(level.withColumn("is_list", F.coalesce(F.try_variant_get("v", "$['@type']", "string") == "BreadcrumbList", F.lit(False)) | F.coalesce(F.array_contains(kind, "BreadcrumbList"), F.lit(False))))
        items = F.coalesce(F.try_variant_get("v", "$.itemListElement", "array<variant>"), F.array().cast("array<variant>"))
        name = lambda x: F.coalesce(_text_of(x), _text_of(F.try_variant_get(x, "$.name", "variant")), _text_of(F.try_variant_get(x, "$.item.name", "variant")))
        here = level.where("is_list").select(*by, "at", F.filter(F.transform(items, name), lambda n: n.isNotNull()).alias("names"))
        found = here if found is None else found.unionByName(here)
        inside = level.where("not is_list").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).alias("e"))
        level = inside.select(*by, F.col("e.value").alias("v"), F.concat("at", F.array(F.lpad(F.col("e.pos").cast("string"), 10, "0"))).alias("at"))
        if not level.limit(1).count():
            return found.groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "names"))), lambda x: x["names"])).alias("names"))
    raise ValueError(f"JSON deeper than {most} levels")
