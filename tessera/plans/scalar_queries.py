"""Functions and predicates over the test tables: every entry has a Column and the SQL that must give the same values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring as s
from tessera.functions import text as t
from tessera.functions import web as w
from tessera.sources.tables import read

C, L = F.col, F.lit  # called inside lambdas only: Columns need a session
D, P, E, O, LI, LB, N = ("documents", "doc_id"), ("pages", "page_id"), ("events", "event_id"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey, l_linenumber"), ("labels", "doc_id"), ("nation", "n_nationkey")
LOW_WORD = "(?<![A-Za-z0-9_])"
CMP = "\\b(?:vs|versus|compare|comparison|alternative)\\b"
COLLAPSED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
GRAMS = f"string_split(lower({COLLAPSED.format('text')}), ' ')"
PRIO = "greatest(-1000, least(1000, floor(least(1, greatest(0, coalesce(l_discount * 10, 0.25))) * 400 + 0.5) + floor(least(1, greatest(0, l_tax * 10)) * 250 + 0.5) + floor(least(l_quantity, 10) / 10 * 150 + 0.5) - least(l_linenumber, 5) * 40 + greatest(-100, least(100, floor(l_quantity - 25 + 0.5)))))::INT"
R4 = "floor(({}) * 1e4 + 0.5) / 1e4"
CL4 = "greatest(0.0, least(1.0, floor(({}) * 1e4 + 0.5) / 1e4))"
HOST_SQL = "nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '')"
PATH_SQL = "coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
STRIP_SQL = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '\\s+', ' ', 'g'))"
TITLE_SQL = "nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '\\s+', ' ', 'g')), '')"
TRUST_SQL = "CASE k WHEN 'government' THEN 0.95 WHEN 'official_documentation' THEN 0.9 WHEN 'wiki_reference' THEN 0.62 WHEN 'forum_community' THEN 0.42 WHEN 'marketplace' THEN 0.58 WHEN 'news' THEN 0.65 WHEN 'affiliate' THEN 0.38 ELSE 0.45 END"
KIND = lambda: F.when(C("event_id") % 7 == 0, "news").when(C("event_id") % 7 == 1, "forum_community").when(C("event_id") % 7 == 2, "affiliate").when(C("event_id") % 7 == 3, "government").otherwise("other")
KIND_SQL = "CASE event_id % 7 WHEN 0 THEN 'news' WHEN 1 THEN 'forum_community' WHEN 2 THEN 'affiliate' WHEN 3 THEN 'government' ELSE 'other' END"
SOURCE_TEXT = lambda: F.concat_ws(" ", C("url"), w.page_title(C("html")))
SOURCE_SQL = f"lower(url || coalesce(' ' || {TITLE_SQL}, ''))"
SOURCE_CASE = ("CASE WHEN regexp_matches(x, '\\.gov\\b|\\bgov\\.') THEN 'government' WHEN regexp_matches(x, '\\bdocs?\\.|/docs?/|\\bofficial\\b') THEN 'official_documentation' "
               "WHEN regexp_matches(x, '\\bwikipedia\\.|\\bwiki\\b') THEN 'wiki_reference' WHEN regexp_matches(x, '\\bforum\\b|\\breddit\\.|\\bcommunity\\b') THEN 'forum_community' "
               "WHEN regexp_matches(x, '\\bshop\\b|\\bmarketplace\\b|\\bproduct\\b') THEN 'marketplace' WHEN regexp_matches(x, '\\bnews\\b|\\barticle\\b|\\bpress\\b') THEN 'news' "
               "WHEN regexp_matches(x, '\\baffiliate\\b|\\bbest\\b|\\breview\\b') THEN 'affiliate' ELSE 'unknown' END")
NOW = lambda: F.lit("2024-02-01 00:00:00").cast("timestamp")
NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"
AGE_SQL = f"(epoch_us({NOW_SQL}) - epoch_us(ts))"
TS = lambda: C("ts").cast("timestamp")


def freshness() -> Column:
    return s.freshness_reasons(s.ttl_expired(TS(), NOW(), 24.0 * 20), C("event_id") % 5 == 0, C("event_type") == "purchase", C("event_id") % 11 == 0, L(False), C("user_id") % 13 == 0)


FRESH_SQL = (f"list_filter([CASE WHEN {AGE_SQL} / 3.6e9 >= 480 THEN 'ttl_expired' END, CASE WHEN event_id % 5 = 0 THEN 'serp_changed' END, CASE WHEN event_type = 'purchase' THEN 'content_changed' END, "
             "CASE WHEN event_id % 11 = 0 THEN 'entity_missing' END, CASE WHEN user_id % 13 = 0 THEN 'policy_changed' END], lambda x: x IS NOT NULL)")

def decode_sql(x: str, table: list[tuple[str, str]]) -> str:
    for a, b in table:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


# name, (table, id columns), {column: Column}, {column: SQL}
ENTRIES: list[tuple[str, tuple[str, str], Callable[[], dict[str, Column]], dict[str, str]]] = [
    ("f1_token_count", D, lambda: {"n": t.token_count(C("text"))}, {"n": f"CASE WHEN {COLLAPSED.format('text')} = '' THEN 0 ELSE len(string_split({COLLAPSED.format('text')}, ' ')) END::INT"}),
    ("f2_normalize_chunk_text", D, lambda: {"x": t.stable_hash(t.normalize_chunk(C("text")))}, {"x": f"sha256(lower({COLLAPSED.format('text')}))"}),
    ("f3_stable_hash", P, lambda: {"x": t.content_hash(C("html"), C("url"))}, {"x": "sha256(coalesce(html, url))"}),
    ("f4_normalize_entity_text", D, lambda: {"x": t.normalize_entity(C("text"))}, {"x": f"trim(regexp_replace(regexp_replace(lower({COLLAPSED.format("text")}), '[._/]+', ' ', 'g'), '\\s+', ' ', 'g'))"}),
    ("f5_normalize_keyword", D, lambda: {"x": t.normalize_keyword(C("text"))}, {"x": f"regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+', ' ', 'g')"}),
    ("f6_normalize_concept", D, lambda: {"x": t.normalize_concept(C("text"))}, {"x": f"trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s?]', ' ', 'g'), '\\s+', ' ', 'g'))"}),
    ("f7_normalize_predicate", E, lambda: {"x": t.normalize_predicate(F.concat(C("event_type"), L("_By-User")))}, {"x": "lower(regexp_replace(trim(event_type || '_By-User'), '[_-]+', ' ', 'g'))"}),
    ("f8_stable_key", N, lambda: {"x": t.stable_key("geo", C("n_name"))}, {"x": "'geo:' || regexp_replace(trim(regexp_replace(regexp_replace(lower(n_name), '[^\\p{L}\\p{N}\\s?]', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+', '-', 'g')"}),
    ("f9_slug", D, lambda: {"x": t.slug(C("text"))}, {"x": f"regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"}),
    ("f10_title_case", D, lambda: {"x": t.title_case(C("text"))}, {"x": f"array_to_string(list_transform(string_split({COLLAPSED.format('text')}, ' '), lambda w: CASE WHEN w[1] = 'ß' THEN 'SS' ELSE upper(w[1]) END || w[2:]), ' ')"}),
    ("f11_query_normalize", D, lambda: {"x": t.collapse(C("text"))}, {"x": COLLAPSED.format("text")}),
    ("f12_query_terms", D, lambda: {"n": F.size(t.query_terms(C("text"))), "x": F.array_join(t.query_terms(C("text")), "|")}, {"n": f"len(list_filter(string_split(lower({COLLAPSED.format("text")}), ' '), lambda x: x <> ''))::INT", "x": f"array_to_string(list_filter(string_split(lower({COLLAPSED.format("text")}), ' '), lambda x: x <> ''), '|')"}),
    ("f13_keyword_score", D, lambda: {"x": t.match_share(C("text"), ["the", "tion", "ing"])}, {"x": "(contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'ing')::INT) / 3.0::DOUBLE"}),
    ("f14_like_escape", P, lambda: {"x": t.escape_like(F.concat(C("url"), L("%_\\")))}, {"x": "replace(replace(replace(url || '%_\\', '\\', '\\\\'), '%', '\\%'), '_', '\\_')"}),
    ("f16_comparison_detector", D, lambda: {"x": t.is_comparison(F.lower(C("text")))}, {"x": f"regexp_matches(lower(text), '{CMP}')"}),
    ("f17_ngrams", ("benchmark", "item_id"), lambda: {"n": F.size(t.ngrams(C("text")))},
     {"n": f"len(list_distinct(flatten(list_transform(range(1, 7), lambda n: list_transform(range(1, greatest(1, len({GRAMS}) - n + 2)), lambda i: array_to_string(({GRAMS})[i:i + n - 1], ' '))))))::INT"}),
    ("f18_geo_key", N, lambda: {"x": t.geo_key(C("n_name"), C("n_regionkey").cast("string"), L(" Paris "))}, {"x": "upper(n_name) || ':' || n_regionkey || ':paris'"}),
    ("f19_normalize_url", P, lambda: {"x": w.normalize_url(F.concat(C("url"), L("#frag")))}, {"x": "regexp_extract(lower(url), '^(https?://[^/?#]+)', 1) || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"}),
    ("f20_host_and_domain", P, lambda: {"host": w.host_of(C("url")), "domain": w.domain_of(C("url"))}, {"host": HOST_SQL, "domain": f"regexp_replace({HOST_SQL}, '^www\\.', '')"}),
    ("f22_title_meta", P, lambda: {"title": w.page_title(C("html")), "lang": w.html_lang(C("html"))}, {"title": TITLE_SQL, "lang": "nullif(regexp_extract(html, '(?is)<html[^>]*\\slang=\"([^\"]*)\"', 1), '')"}),
    ("f23_plain_text", P, lambda: {"x": t.stable_hash(w.plain_text(C("html"))), "n": F.length(w.plain_text(C("html")))}, {"x": f"sha256({STRIP_SQL})", "n": f"length({STRIP_SQL})::INT"}),
    ("f29_language_hints", P, lambda: {"tag": w.html_lang(C("html")), "confidence": F.when(w.html_lang(C("html")).isNotNull(), 0.9)}, {"tag": "nullif(regexp_extract(html, '(?is)<html[^>]*\\slang=\"([^\"]*)\"', 1), '')", "confidence": "CASE WHEN regexp_matches(html, '(?is)<html[^>]*\\slang=\"[^\"]+\"') THEN 0.9::DOUBLE END"}),
    ("f30_geo_hints", P, lambda: {"tld": F.upper(F.regexp_extract(w.host_of(C("url")), "\\.([a-z]{2})$", 1))}, {"tld": f"upper(regexp_extract({HOST_SQL}, '\\.([a-z]{{2}})$', 1))"}),
    ("f31_word_char_count", D, lambda: {"words": F.nullif(t.token_count(C("text")), L(0)), "chars": w.utf16_length(C("text"))}, {"words": f"CASE WHEN {COLLAPSED.format('text')} <> '' THEN len(string_split({COLLAPSED.format('text')}, ' ')) END::INT", "chars": "(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::INT"}),
    ("f32_entity_decode", P, lambda: {"a": F.sha2(w.decode_entities(F.concat("html", L("&amp;lt; &nbsp;&#39;"))), 256), "b": F.sha2(w.decode_entities(F.concat("html", L("&amp;lt; &nbsp;&#39;")), w.ENTITIES_EXTRACT), 256)},
     {"a": "sha256(" + decode_sql("html || '&amp;lt; &nbsp;&#39;'", w.ENTITIES_PLAIN) + ")", "b": "sha256(" + decode_sql("html || '&amp;lt; &nbsp;&#39;'", w.ENTITIES_EXTRACT) + ")"}),
    ("f34_chunk_profile", D, lambda: {"x": s.chunk_profile(C("text"), t.token_count(C("text")))},
     {"x": f"CASE WHEN regexp_matches(lower(text), '\\b(review|rating|pros|cons)\\b') THEN 'review' WHEN regexp_matches(lower(text), '\\b(forum|thread|comments|discussion)\\b') THEN 'forum' WHEN len(string_split({COLLAPSED.format('text')}, ' ')) > 2500 THEN 'long_guide' WHEN len(string_split({COLLAPSED.format('text')}, ' ')) < 900 THEN 'short_seo_page' ELSE 'default' END"}),
    ("f35_chunk_type", D, lambda: {"x": s.chunk_type(C("text"), F.when(C("doc_id") % 3 > 0, C("source")), C("doc_id") % 4, L(4))},
     {"x": "CASE WHEN contains(text, '?') OR regexp_matches(lower(coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, '') || ' ' || text), '\\b(faq|questions|q&a)\\b') THEN 'faq' WHEN regexp_matches(text, '(?m)^\\s*\\|.+\\|\\s*$') THEN 'table' WHEN regexp_matches(text, '(?m)^\\s*([-*]|[0-9]+\\.)\\s+') THEN 'list' "
           "WHEN regexp_matches(lower(text), '\\b(compare|comparison|versus)\\b| vs\\.? ') THEN 'comparison' WHEN regexp_matches(lower(text), '\\b(review|rating|pros|cons)\\b') THEN 'review' WHEN doc_id % 4 = 0 THEN 'intro' "
           "WHEN doc_id % 4 = 3 AND regexp_matches(lower(text), '\\b(conclusion|summary|final thoughts)\\b') THEN 'conclusion' WHEN regexp_matches(lower(text), '\\b(city|near me|local|address|location)\\b') THEN 'local_section' WHEN doc_id % 3 > 0 THEN 'section' ELSE 'unknown' END"}),
    ("f36_source_type", P, lambda: {"x": s.source_type(SOURCE_TEXT())}, {"x": SOURCE_CASE.replace("(x,", f"({SOURCE_SQL},")}),
    ("f37_clamp_round", LI, lambda: {"a": s.clamp01(C("l_discount") * 12), "b": s.clamp(s.js_round(C("l_quantity") - 25.5), -10, 10).cast("int"), "c": s.clamp4(C("l_extendedprice") / 1e5)}, {"a": "least(1.0, greatest(0.0, l_discount * 12))", "b": "greatest(-10, least(10, floor(l_quantity - 25.5 + 0.5)))::INT", "c": CL4.format("l_extendedprice / 1e5")}),
    ("f38_frontier_priority", LI, lambda: {"x": s.frontier_priority(C("l_discount") * 10, C("l_quantity"), C("l_linenumber"), C("l_tax") * 10, C("l_quantity") - 25)}, {"x": PRIO}),
    ("f41_source_trust", E, lambda: {"x": s.source_trust(KIND(), C("event_id") % 2 == 0, (C("event_id") % 5).cast("int"))},
     {"x": CL4.format("b - CASE WHEN event_id % 2 = 0 THEN 0.06 ELSE 0.0 END - least(event_id % 5, 3) * 0.04 - CASE WHEN event_id % 7 = 1 THEN 0.08 ELSE 0.0 END - CASE WHEN event_id % 7 = 2 THEN 0.12 ELSE 0.0 END").replace("(b -", "(" + TRUST_SQL.replace("CASE k", f"CASE {KIND_SQL}") + "::DOUBLE -")}),
    ("f42_fact_confidence", LI, lambda: {"x": s.fact_confidence(C("l_discount") * 10, F.when(C("l_linenumber") > 1, C("l_tax") * 10), C("l_quantity") / 50, F.when(C("l_linenumber") > 2, L(0.7)))}, {"x": CL4.format("l_discount * 10 * 0.3 + coalesce(CASE WHEN l_linenumber > 1 THEN l_tax * 10 END, l_discount * 10) * 0.25 + l_quantity / 50 * 0.3 + CASE WHEN l_linenumber > 2 THEN 0.7 ELSE 0.45 END::DOUBLE * 0.15")}),
    ("f43_support_score", LI, lambda: {"x": s.support_score(C("l_linenumber"), C("l_linenumber") - 1, C("l_discount") * 10, L(None).cast("double")), "level": s.consensus_level(C("l_linenumber"), C("l_linenumber") - 1, C("l_discount") * 10)},
     {"x": CL4.format("least(0.35::DOUBLE, l_linenumber * 0.1::DOUBLE) + least(0.25::DOUBLE, (l_linenumber - 1) * 0.1::DOUBLE) + l_discount * 10 * 0.2 + 0.45::DOUBLE * 0.2"), "level": "CASE WHEN l_linenumber >= 3 AND l_linenumber - 1 >= 2 AND l_discount * 10 >= 0.65 THEN 'strong' WHEN l_linenumber >= 2 AND l_discount * 10 >= 0.5 THEN 'moderate' ELSE 'weak' END"}),
    ("f44_retry_delay", E, lambda: {"x": s.retry_delay_ms((C("event_id") % 8).cast("int"), C("user_id").cast("string"), jitter=0.0)}, {"x": "least(21600000.0, floor(300000.0 * pow(2.0, event_id % 8) + 0.5))"}),
    ("f45_stable_jitter", E, lambda: {"x": s.round4(s.stable_jitter(C("user_id").cast("string")))}, {"x": R4.format("list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(user_id::VARCHAR, ''), lambda c: ascii(c)::HUGEINT)), lambda h, x: (h * 31 + x) % 4294967296) / 4294967295.0::DOUBLE")}),
    ("f46_recrawl_delay", O, lambda: {"x": s.recrawl_hours(C("o_totalprice") / 500, F.when(C("o_orderstatus") == "F", "changed").when(C("o_orderstatus") == "O", "unchanged"))}, {"x": "greatest(24.0, least(720.0, o_totalprice / 500 * CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 1.5 ELSE 1.0 END::DOUBLE))"}),
    ("f47_intent_depth", LI, lambda: {"x": s.intent_depth(C("l_linenumber") - 1, (C("l_quantity") / 15).cast("int"))}, {"x": "CASE WHEN l_linenumber = 1 AND trunc(l_quantity / 15) = 0 THEN 'unknown' WHEN l_linenumber >= 4 OR trunc(l_quantity / 15) >= 3 THEN 'deep' WHEN l_linenumber >= 3 OR trunc(l_quantity / 15) >= 2 THEN 'moderate' ELSE 'shallow' END"}),
    ("f48_expansion_confidence", LI, lambda: {"x": s.signal_confidence(C("l_linenumber"), C("l_quantity"), L("low"))}, {"x": "CASE WHEN l_linenumber >= 2 AND l_quantity >= 2 THEN 'high' WHEN l_linenumber >= 2 OR l_quantity >= 2 THEN 'medium' ELSE 'low' END"}),
    ("f49_alert_severity", LI, lambda: {"x": s.alert_severity(C("l_quantity"), L(20))}, {"x": "CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 20 THEN 'warning' END"}),
    ("f50_confidence_rank", O, lambda: {"x": s.confidence_rank(F.when(C("o_orderstatus") == "F", "high").when(C("o_orderstatus") == "O", "low").otherwise("none"))}, {"x": "CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 END::INT"}),
    ("f51_lease_deadline", E, lambda: {"x": F.date_format(F.least(F.date_trunc("day", TS()) + F.expr("interval 1 day"), TS() + F.expr("interval 2 hours")), "yyyy-MM-dd HH:mm")}, {"x": "strftime(least(date_trunc('day', ts) + INTERVAL 1 DAY, ts + INTERVAL 2 HOUR), '%Y-%m-%d %H:%M')"}),
    ("f52_age_minutes", E, lambda: {"x": s.age_minutes(TS(), NOW()).cast("long")}, {"x": f"greatest(0, floor({AGE_SQL} / 6e7))::BIGINT"}),
    ("f53_ttl_expiry", E, lambda: {"a": s.ttl_expired(TS(), NOW(), 480.0), "b": s.ttl_expired(TS(), NOW(), 480.0, inclusive=False)}, {"a": f"{AGE_SQL} / 3.6e9 >= 480", "b": f"{AGE_SQL} / 3.6e9 > 480"}),
    ("f54_iso_format", E, lambda: {"x": F.date_format(TS(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")}, {"x": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"}),
    ("f57_composite_hash", P, lambda: {"x": t.natural_id(C("page_id"), C("url"), L(None))}, {"x": "sha256(page_id::VARCHAR || chr(0) || url || chr(0))"}),
    ("f61_missing_metrics", E, lambda: {"x": F.array_join(s.missing_names({"value": F.when(C("value") > 20, C("value")), "props": F.when(C("event_id") % 2 == 0, C("props"))}), ",")}, {"x": "array_to_string(list_filter([CASE WHEN NOT coalesce(value > 20, false) THEN 'value' END, CASE WHEN event_id % 2 <> 0 OR props IS NULL THEN 'props' END], lambda x: x IS NOT NULL), ',')"}),
    ("f62_geo_match", N, lambda: {"x": F.exists(F.array(F.struct(C("n_name").alias("country"), C("n_regionkey").alias("region"))), lambda g: (g["country"] == "FRANCE") | (g["region"] == 2))}, {"x": "n_name = 'FRANCE' OR n_regionkey = 2"}),
    ("s4_http_outcome", LI, lambda: {"x": w.http_outcome((C("l_linenumber") * 100 + C("l_quantity") % 30).cast("int"))}, {"x": "CASE WHEN (l_linenumber * 100 + l_quantity % 30)::INT BETWEEN 200 AND 299 THEN 'succeeded' WHEN (l_linenumber * 100 + l_quantity % 30)::INT BETWEEN 300 AND 399 THEN 'redirected' WHEN (l_linenumber * 100 + l_quantity % 30)::INT = 429 OR (l_linenumber * 100 + l_quantity % 30)::INT >= 500 THEN 'failed_retryable' ELSE 'failed_terminal' END"}),
    ("s5_safe_address", LI, lambda: {"x": w.is_unsafe_host(F.concat_ws(".", (C("l_linenumber") * 43 % 230).cast("string"), C("l_quantity").cast("int").cast("string"), L("1"), L("9")))},
     {"x": "(l_linenumber * 43 % 230) IN (0, 10, 127) OR (l_linenumber * 43 % 230 = 172 AND l_quantity BETWEEN 16 AND 31) OR l_linenumber * 43 % 230 >= 224"}),
    ("p3_keyword_prefilter", D, lambda: {"x": t.any_contains([C("text"), C("source")], ["100%", "stupid", "src1"])}, {"x": "contains(lower(text), '100%') OR contains(lower(text), 'stupid') OR contains(lower(text), 'src1') OR contains(lower(source), '100%') OR contains(lower(source), 'stupid') OR contains(lower(source), 'src1')"}),
    ("p6_host_policy_wildcard", P, lambda: {"x": w.crawl_policy(C("url"), ["*.example.com", "*.example.org"], ["*.spam-farm.example.org"], [], ["/de/*"])},
     {"x": f"CASE WHEN {HOST_SQL} LIKE '%.spam-farm.example.org' THEN 'host_denied' WHEN NOT ({HOST_SQL} LIKE '%.example.com' OR {HOST_SQL} LIKE '%.example.org') THEN 'host_not_allowed' WHEN {PATH_SQL} LIKE '/de/%' THEN 'path_excluded' ELSE 'allowed' END"}),
    ("p7_host_policy_exact", P, lambda: {"x": w.crawl_policy(C("url"), ["therha.example.net", "ththin.example.com"], [], ["/en/*"], [], wildcard=False)},
     {"x": f"CASE WHEN {HOST_SQL} NOT IN ('therha.example.net', 'ththin.example.com') THEN 'host_not_allowed' WHEN NOT {PATH_SQL} LIKE '/en/%' THEN 'path_not_included' ELSE 'allowed' END"}),
    ("p8_path_glob", P, lambda: {"x": w.path_matches(w.path_of(C("url")), ["/en/*.html", "/f*/1*"])}, {"x": f"regexp_matches({PATH_SQL}, '^/en/.*\\.html$') OR regexp_matches({PATH_SQL}, '^/f.*/1.*$')"}),
    ("p13_embeddable_partition", D, lambda: {"x": F.when((F.trim(C("text")) != "") & (t.token_count(C("text")) >= 60), "embeddable").otherwise("skipped")}, {"x": f"CASE WHEN trim(text) <> '' AND len(string_split({COLLAPSED.format('text')}, ' ')) >= 60 THEN 'embeddable' ELSE 'skipped' END"}),
    ("p14_fact_candidates", D, lambda: {"x": s.fact_candidate_priority(C("text"), t.token_count(C("text")), F.when(C("doc_id") % 3 == 0, "faq").otherwise("unknown"), L(""), C("source"))},
     {"x": f"CASE WHEN trim(text) <> '' AND len(string_split({COLLAPSED.format('text')}, ' ')) >= 8 AND (doc_id % 3 = 0 OR regexp_matches(lower(text), '\\b({s.FACTUAL})\\b')) THEN (CASE WHEN doc_id % 3 = 0 THEN 50 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '\\b({s.FACTUAL})\\b') THEN 20 ELSE 0 END)::INT END"}),
    ("p16_canonical_gate", LI, lambda: {"x": (C("l_returnflag") != "N") & (C("l_discount") * 10 >= 0.6)}, {"x": "l_returnflag <> 'N' AND l_discount * 10 >= 0.6"}),
    ("p20_intent_gap", LI, lambda: {"x": s.intent_gap(C("l_linenumber"), (C("l_quantity") / 15).cast("int"), F.when(C("l_tax") > 0.04, "high").otherwise("low"), F.array(F.when(C("l_returnflag") == "A", "entity").otherwise("heading")), F.array(F.when(C("l_linestatus") == "F", "missing_opportunity").otherwise("faq")), C("l_discount") > 0.05)},
     {"x": "CASE WHEN l_returnflag <> 'A' AND trunc(l_quantity / 15) >= 2 AND l_linenumber >= 2 AND l_tax > 0.04 THEN CASE WHEN l_discount > 0.05 THEN 'recommended' ELSE 'must_cover' END WHEN l_linestatus = 'F' THEN 'opportunity' WHEN l_linenumber >= 3 OR trunc(l_quantity / 15) >= 3 THEN 'monitor' WHEN l_linenumber >= 2 OR trunc(l_quantity / 15) >= 2 THEN 'recommended' ELSE 'opportunity' END"}),
    ("p21_page_type", D, lambda: {"x": s.page_type(F.when(C("doc_id") % 9 == 0, "entity_page"), (C("doc_id") * 7 % 100), F.concat(C("lang"), F.when(C("doc_id") % 2 == 0, " vs x").otherwise("")), C("lang") == "de")}, {"x": "CASE WHEN doc_id % 9 = 0 THEN 'entity_page' WHEN doc_id * 7 % 100 >= 60 THEN 'faq_page' WHEN doc_id % 2 = 0 THEN 'comparison_page' WHEN lang = 'de' THEN 'local_page' ELSE 'supporting_page' END"}),
    ("p22_metric_visibility", E, lambda: {"x": s.metric_visibility(F.when(C("event_type") == "view", "unknown").otherwise("measured"), F.array_compact(F.array(F.when(C("value") < 5, L("cpc")))), TS(), NOW(), 300.0)},
     {"x": f"CASE WHEN event_type = 'view' OR value < 5 THEN 'unknown_metrics' WHEN {AGE_SQL} / 3.6e9 > 300 THEN 'stale_metrics' ELSE 'fresh_metrics' END"}),
    ("p23_freshness_decision", E, lambda: {"reasons": F.array_join(freshness(), ","), "status": s.freshness_status(freshness(), (C("event_type") == "purchase") | (C("event_id") % 11 == 0) | (C("user_id") % 13 == 0))},
     {"reasons": f"array_to_string({FRESH_SQL}, ',')", "status": f"CASE WHEN len({FRESH_SQL}) = 0 THEN 'reuse' WHEN event_type = 'purchase' OR event_id % 11 = 0 OR user_id % 13 = 0 THEN 'force_refresh' ELSE 'refresh' END"}),
    ("p24_media_policy", E, lambda: {"x": s.media_decision(F.when(C("event_id") % 4 == 0, "video").otherwise("image"), F.when(C("user_id") % 3 == 0, "selected").when(C("user_id") % 3 == 1, "full_archive").otherwise("metadata_only"), C("value") / 100, C("event_id") % 10 == 0, ["image"])},
     {"x": "CASE WHEN event_id % 4 = 0 THEN 'metadata_only' WHEN user_id % 3 = 1 THEN 'archive_allowed' WHEN user_id % 3 = 0 AND (event_id % 10 = 0 OR coalesce(value / 100, 0) >= 0.7) THEN 'selected_for_download' ELSE 'metadata_only' END"}),
]


def _query(tab: str, ids: str, columns: Callable[[], dict[str, Column]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: read(spark, sf_dir, tab).select(*[C(i.strip()) for i in ids.split(",")], *[c.alias(n) for n, c in columns().items()])


QUERIES = {name: _query(*tab, columns) for name, tab, columns, _ in ENTRIES}
ORACLES = {name: f"SELECT {tab[1]}, " + ", ".join(f"{sql} AS {c}" for c, sql in sqls.items()) + f" FROM {tab[0]}" for name, tab, _, sqls in ENTRIES}
