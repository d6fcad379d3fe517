"""Packs over the test tables: what retrieval finds for each language, arranged as context and knowledge packs; with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions import web as w
from tessera.operators import packs
from tessera.plans.scalar_queries import HOST_SQL
from tessera.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TERMS = ["the", "que", "und", "tion", "ing"]
PER_PACK = 20


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# A pack for each language: its 20 best documents by matched terms; a document's page gives the url, its source the heading.
SHARE_SQL = "(" + " + ".join(f"contains(lower(coalesce(text, '')), '{x}')::INT" for x in TERMS) + f") / {float(len(TERMS))}::DOUBLE"
RESULTS_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY pack ORDER BY doc_id % 7, doc_id) AS seq FROM
    (SELECT lang AS pack, doc_id, 'https://docs.example/' || (doc_id // 2) AS source_url, CASE WHEN doc_id % 3 > 0 THEN url END AS canonical_url, CASE WHEN doc_id % 3 > 0 THEN {HOST_SQL} ELSE 'docs.example' END AS domain,
            CASE WHEN doc_id % 11 > 0 THEN lang END AS language, doc_id % 13 > 0 AS has_geo, source AS heading, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'What now?' ELSE 'Part' END END AS title, score
     FROM (SELECT *, {SHARE_SQL} AS score FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {SHARE_SQL} DESC, doc_id) <= {PER_PACK}) LEFT JOIN pages ON page_id = doc_id))"""
SOURCES_SQL = """(SELECT pack, url, domain, language, has_geo, row_number() OVER (PARTITION BY pack ORDER BY seq) AS n FROM
    (SELECT *, coalesce(canonical_url, source_url) AS url FROM results QUALIFY row_number() OVER (PARTITION BY pack, coalesce(canonical_url, source_url) ORDER BY seq) = 1))"""
BASE_SQL = f"""
    WITH results AS {RESULTS_SQL}, sources AS {SOURCES_SQL}, r AS (SELECT results.*, 'source-' || n AS source_id FROM results JOIN sources ON sources.pack = results.pack AND url = coalesce(canonical_url, source_url)),
    s AS (SELECT pack, heading, title, max(score) AS score, list(doc_id ORDER BY score DESC, seq) AS chunks, list(source_id ORDER BY score DESC, seq) AS ids, min((-score, seq)) AS best FROM r GROUP BY ALL),
    sections AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY best) AS n FROM s),
    distinct_ids AS (SELECT pack, n, string_agg(id, ',' ORDER BY i) AS source_ids FROM (SELECT * FROM (SELECT pack, n, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM sections) QUALIFY row_number() OVER (PARTITION BY pack, n, id ORDER BY i) = 1) GROUP BY 1, 2)"""


def results(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents", "doc_id", "lang", "source", "text").where("lang is not null")
    best = docs.select("doc_id", "lang", "source", t.match_share(F.col("text"), TERMS).alias("score"))
    best = best.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))).where(F.col("k") <= PER_PACK)  # each task keeps 20 a language
    id_, own = F.col("doc_id"), F.col("doc_id") % 3 > 0
    pages = read(spark, d, "pages", "page_id", "url")
    r = pages.join(F.broadcast(best), F.col("page_id") == id_, "right").select(  # 20 rows for each language
        F.col("lang").alias("pack"), id_.alias("chunk_id"), F.concat(F.lit("https://docs.example/"), F.expr("doc_id div 2")).alias("source_url"), F.when(own, F.col("url")).alias("canonical_url"),
        F.when(own, w.host_of(F.col("url"))).otherwise("docs.example").alias("domain"), F.when(id_ % 11 > 0, F.col("lang")).alias("language"),
        F.when(id_ % 13 > 0, F.array(F.upper("lang"))).otherwise(F.array().cast("array<string>")).alias("geo"), F.array("source").alias("heading_path"),
        F.when(id_ % 4 == 0, "What now?").when(id_ % 2 == 0, "Part").alias("section_title"), F.concat(F.lit("text "), id_).alias("text"), "score")
    return r.withColumn("seq", F.row_number().over(Window.partitionBy("pack").orderBy(F.col("chunk_id") % 7, "chunk_id")))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """A pack for each language of the documents, and one that finds nothing; English is retrieved in degraded mode."""
    langs = read(spark, d, "documents", "lang").where("lang is not null").distinct().select(F.col("lang").alias("pack"))
    every = langs.unionByName(langs.agg(F.lit("none").alias("pack")))
    return every.select("pack", (F.col("pack") == "en").alias("degraded"), (F.col("pack") == "fr").alias("asset_filter"), (F.col("pack") == "de").alias("knowledge_missing"), F.lit(None).cast("string").alias("language"))


@query(f"""{BASE_SQL}
    SELECT s.pack, s.n, heading, title, array_to_string(chunks, ',') AS chunk_ids, source_ids, score, 'text ' || chunks[1] AS first_text FROM sections s JOIN distinct_ids d ON d.pack = s.pack AND d.n = s.n""")
def d11_context_sections(spark, d):
    found = packs.context_pack(requests(spark, d), results(spark, d)).select("pack", F.explode("sections").alias("s"))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("pack", "s.n", F.col("s.heading_path")[0].alias("heading"), F.col("s.section_title").alias("title"), ids("s.chunk_ids").alias("chunk_ids"), ids("s.source_ids").alias("source_ids"),
                        "s.score", F.col("s.texts")[0].alias("first_text"))


@query(f"""{BASE_SQL},
    g AS (SELECT pack, count(*) AS n, count(DISTINCT coalesce(domain, '')) AS domains, bool_or(language IS NULL) AS no_language, bool_or(NOT has_geo) AS no_geo, string_agg(url, ' ' ORDER BY n) AS urls FROM sources GROUP BY 1),
    q AS (SELECT s.pack, string_agg(coalesce(title, heading) || '@' || chunks[1], ';' ORDER BY n) AS faq FROM sections s WHERE title LIKE '%?%' OR heading LIKE '%?%' GROUP BY 1),
    p AS (SELECT DISTINCT lang AS pack FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'none')
    SELECT p.pack, coalesce(g.n, 0)::INT AS sources, coalesce(urls, '') AS urls, coalesce(faq, '') AS faq,
           array_to_string(list_filter([CASE WHEN p.pack = 'de' THEN 'knowledge_pack_unavailable' END, CASE WHEN p.pack = 'fr' THEN 'research_asset_filter_deferred' END, CASE WHEN p.pack = 'en' THEN 'degraded_retrieval' END,
                CASE WHEN coalesce(g.n, 0) < 2 THEN 'few_sources' END, CASE WHEN coalesce(domains, 0) <= 1 THEN 'single_domain' END, CASE WHEN no_language THEN 'missing_language' END,
                CASE WHEN no_geo THEN 'missing_geo' END], lambda x: x IS NOT NULL), ',') AS gaps
    FROM p LEFT JOIN g ON g.pack = p.pack LEFT JOIN q ON q.pack = p.pack""")
def d11_context_gaps(spark, d):
    found = packs.context_pack(requests(spark, d), results(spark, d))
    asked = F.array_join(F.transform("faq", lambda x: F.concat(x["question"], F.lit("@"), x["chunk_id"].cast("string"))), ";")
    return found.select("pack", F.coalesce(F.size("sources"), F.lit(0)).alias("sources"), F.coalesce(F.array_join(F.transform("sources", lambda s: s["url"]), " "), F.lit("")).alias("urls"),
                        F.coalesce(asked, F.lit("")).alias("faq"), F.array_join("gaps", ",").alias("gaps"))


# Facts of a chunk are the lines of the order with its number; lines of every third order have a trust record, groups of flag N a conflict.
FACTS_SQL = """(SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS fact_id, l_orderkey AS chunk_id, l_suppkey % 10 AS subject, l_returnflag AS predicate, l_linestatus AS attributes, (40 + (l_partkey * 7 + l_linenumber) % 60) / 100.0::DOUBLE AS confidence FROM lineitem)"""
PACKED_SQL = f"""{BASE_SQL}, facts AS {FACTS_SQL}, mine AS (SELECT pack, source_id, facts.* FROM r JOIN facts ON chunk_id = doc_id),
    f AS (SELECT pack, subject, predicate, attributes, list(fact_id ORDER BY confidence DESC, fact_id) AS ids, list(chunk_id ORDER BY confidence DESC, fact_id) AS chunks, avg(confidence) AS confidence FROM mine GROUP BY 1, 2, 3, 4),
    known AS (SELECT pack, ids[1] AS fact_id, subject, predicate, attributes, round(confidence, 9) AS confidence, len(list_distinct(chunks)) AS support,
                     CASE WHEN split_part(ids[1], '-', 1)::BIGINT % 3 = 0 THEN round(confidence, 4) END AS trust,
                     CASE WHEN predicate = 'N' THEN 'weak' WHEN predicate = 'A' THEN 'strong' END AS level, predicate = 'N' AND split_part(ids[1], '-', 1)::BIGINT % 3 = 0 AS conflict FROM f)"""


def knowledge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = results(spark, d)
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    facts = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact_id"), F.col("l_orderkey").alias("chunk_id"), (F.col("l_suppkey") % 10).alias("subject"), F.lit(None).cast("string").alias("object"),
                      F.col("l_returnflag").alias("predicate"), F.col("l_linestatus").alias("attributes"), ((F.lit(40) + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 60) / 100.0).alias("confidence"))
    conflict = F.col("l_returnflag") == "N"
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact_id")
    trust = li.where("l_orderkey % 3 = 0").select(key, F.lit(True).alias("trusted"), F.when(conflict, F.array(F.lit("possible_conflict_unresolved"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    consensus = li.where("l_returnflag in ('N', 'A')").select(key, F.when(conflict, "weak").otherwise("strong").alias("level"))
    return found, packs.knowledge_facts(found, facts, trust, consensus)


@query(f"""{PACKED_SQL}
    SELECT pack, row_number() OVER (PARTITION BY pack ORDER BY confidence DESC, fact_id)::INT AS n, fact_id, subject, predicate, attributes, confidence, support::INT AS support, trust, level FROM known""")
def d12_knowledge_facts(spark, d):
    _, rows = knowledge(spark, d)
    sure = F.round("confidence", 9)
    n = F.row_number().over(Window.partitionBy("pack").orderBy(F.desc(sure), "fact_id"))  # rounded, so that both engines break ties alike
    return rows.select("pack", n.alias("n"), "fact_id", "subject", "predicate", "attributes", sure.alias("confidence"), F.size("chunk_ids").alias("support"), F.when(F.col("trusted"), F.round("confidence", 4)).alias("trust"), "level")


@query(f"""{PACKED_SQL},
    k AS (SELECT pack, count(*) AS facts, avg(confidence) AS average, bool_or(support < 2) AS weak, bool_or(conflict) AS open, count(DISTINCT subject) FILTER (WHERE subject < 3) AS aliases, count(*) FILTER (WHERE predicate = 'R') AS ontology FROM known GROUP BY 1),
    g AS (SELECT pack, count(*) AS n, count(DISTINCT coalesce(domain, '')) AS domains FROM sources GROUP BY 1),
    p AS (SELECT DISTINCT lang AS pack FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'none')
    SELECT p.pack, CASE WHEN average IS NULL THEN 'unknown' WHEN average >= 0.8 AND g.n >= 2 THEN 'high' WHEN average >= 0.6 THEN 'medium' ELSE 'low' END AS level, coalesce(facts, 0) AS fact_count, coalesce(g.n, 0) AS source_count,
           round(average, 6) AS average, coalesce(aliases, 0) AS alias_count,
           array_to_string(list_filter([CASE WHEN facts IS NULL THEN 'no_canonical_facts' END, CASE WHEN weak THEN 'weak_fact_support' END, CASE WHEN domains <= 1 THEN 'single_source_support' END,
                CASE WHEN facts > 0 AND aliases = 0 THEN 'missing_entity_aliases' END, CASE WHEN facts > 0 AND ontology = 0 THEN 'missing_ontology_reference' END, CASE WHEN p.pack = 'en' THEN 'retrieval_degraded' END,
                CASE WHEN open THEN 'possible_conflict_unresolved' END], lambda x: x IS NOT NULL), ',') AS gaps
    FROM p LEFT JOIN k ON k.pack = p.pack LEFT JOIN g ON g.pack = p.pack""")
def d12_knowledge_summary(spark, d):
    found, rows = knowledge(spark, d)
    suppliers = read(spark, d, "supplier", "s_suppkey").select((F.col("s_suppkey") % 10).alias("subject")).distinct().where("subject < 3").withColumn("language", F.lit(None).cast("string"))
    ontology = read(spark, d, "lineitem", "l_returnflag").select(F.col("l_returnflag").alias("predicate")).where("predicate = 'R'").distinct()
    return packs.knowledge_summary(requests(spark, d), found, rows, suppliers, ontology).select(
        "pack", "level", "fact_count", "source_count", (F.floor(F.col("average") * 1e6 + 0.5) / 1e6).alias("average"), "alias_count", F.array_join("gaps", ",").alias("gaps"))
