"""Planning over the test tables: demand from parts, intents by brand, dispatch plans and page packs for customers; with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import planning as p
from tessera.sources.tables import read, ts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# Observed demand: a part's name, every seventh one compared with its type; a quarter from an advertising provider, a quarter own data.
DEMAND_SQL = """
    WITH o AS (SELECT p_type AS topic, p_partkey AS seq, CASE WHEN p_partkey % 7 = 0 THEN ' ' || p_name || ' VS ' || p_type || '!' ELSE upper(p_name) END AS observed, CASE p_partkey % 8 WHEN 0 THEN 'ads' WHEN 1 THEN 'own' ELSE 'manual' END AS provider,
                      p_brand AS evidence, CASE p_partkey % 8 WHEN 0 THEN 'provider_backed' WHEN 1 THEN 'owned_data_backed' ELSE 'fallback_only' END AS status, p_size AS volume, CASE WHEN p_partkey % 3 > 0 THEN p_size % 100 END AS difficulty,
                      p_retailprice AS cpc, CASE WHEN p_partkey % 5 > 0 THEN p_partkey END AS traffic, TIMESTAMP '2024-01-01' + to_days((p_partkey % 60)::INT) AS collected_at FROM part),
    k AS (SELECT *, regexp_replace(regexp_replace(lower(trim(observed)), '[^\\p{L}\\p{N}\\s-]', ' ', 'g'), '\\s+', ' ', 'g') AS keyword FROM o),
    g AS (SELECT topic, keyword, min(seq) FILTER (WHERE status = 'provider_backed') AS p, min(seq) FILTER (WHERE status = 'owned_data_backed') AS own, min(seq) AS first, count(DISTINCT evidence) AS evidence_count,
                 bool_and(provider = 'manual') AS only_fallback FROM k WHERE keyword <> '' GROUP BY 1, 2),
    m AS (SELECT g.*, coalesce(p, own) AS at, CASE WHEN p IS NOT NULL THEN 'provider_backed' WHEN own IS NOT NULL THEN 'owned_data_backed' ELSE 'fallback_only' END AS metric_status FROM g),
    c AS (SELECT m.topic, m.keyword, metric_status, coalesce(b.provider, f.provider) AS provider, b.volume, b.difficulty, b.cpc, b.traffic, b.collected_at, evidence_count, only_fallback,
                 CASE WHEN metric_status <> 'fallback_only' THEN 'high' WHEN evidence_count >= 3 THEN 'medium' ELSE 'low' END AS confidence
          FROM m LEFT JOIN o b ON b.seq = m.at JOIN o f ON f.seq = m.first),
    cand AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, evidence_count DESC, keyword) AS rank FROM c QUALIFY rank <= 40),
    miss AS (SELECT *, list_filter([CASE WHEN volume IS NULL THEN 'searchVolume' END, CASE WHEN difficulty IS NULL THEN 'keywordDifficulty' END, CASE WHEN cpc IS NULL THEN 'cpc' END, CASE WHEN traffic IS NULL THEN 'trafficPotential' END],
                    lambda x: x IS NOT NULL) AS missing FROM cand)"""


def demand(spark: SparkSession, d: str) -> DataFrame:
    k, kind = F.col("p_partkey"), F.col("p_partkey") % 8
    observed = F.when(k % 7 == 0, F.concat(F.lit(" "), "p_name", F.lit(" VS "), "p_type", F.lit("!"))).otherwise(F.upper("p_name"))
    o = read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice").select(
        F.col("p_type").alias("topic"), k.alias("seq"), observed.alias("observed_text"), F.when(kind == 0, "ads").when(kind == 1, "own").otherwise("manual").alias("provider"),
        F.when(kind > 1, "fallback").otherwise("metrics").alias("tier"), F.col("p_brand").alias("evidence"), F.when(kind == 0, "provider_backed").when(kind == 1, "owned_data_backed").otherwise("fallback_only").alias("metric_status"),
        F.col("p_size").alias("volume"), F.when(k % 3 > 0, F.col("p_size") % 100).alias("difficulty"), F.col("p_retailprice").alias("cpc"), F.when(k % 5 > 0, k).alias("traffic"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((k % 60).cast("int"))).alias("collected_at"))
    return p.keyword_candidates(o, limit=40)


@query(f"{DEMAND_SQL} SELECT topic, rank::INT AS rank, keyword, confidence, metric_status, provider, volume, evidence_count::INT AS evidence_count, only_fallback FROM cand")
def d17_keyword_candidates(spark, d):
    return demand(spark, d).select("topic", "rank", "keyword", "confidence", "metric_status", "provider", "volume", "evidence_count", "only_fallback")


@query(f"""{DEMAND_SQL} SELECT topic, keyword, '/' || regexp_replace(keyword, '\\s+', '-', 'g') || '/' AS slug, CASE WHEN contains(keyword, ' vs ') THEN 'comparison' ELSE 'guide' END AS page_type, array_to_string(missing, ',') AS missing
           FROM miss WHERE metric_status <> 'fallback_only' OR evidence_count >= 2""")
def d17_candidate_pages(spark, d):
    return p.candidate_pages(demand(spark, d)).withColumn("missing", F.array_join("missing", ","))


@query(f"""{DEMAND_SQL} SELECT topic, CASE WHEN metric_status = 'fallback_only' OR len(missing) > 0 THEN 'unknown_metrics' WHEN TIMESTAMP '2024-02-15' - collected_at > INTERVAL 720 HOUR THEN 'stale_metrics' ELSE 'fresh_metrics' END AS visibility, count(*) AS n
           FROM miss GROUP BY 1, 2""")
def d17_metric_visibility(spark, d):
    return p.visibility(demand(spark, d), F.lit("2024-02-15").cast("timestamp")).groupBy("topic", "visibility").agg(F.count(F.lit(1)).alias("n"))


# Intents of a brand: words of its parts' names are headings, types entities, and words of small parts missing opportunities.
INTENT_SQL = """
    WITH packs AS (SELECT DISTINCT p_brand AS pack, p_brand LIKE '%1' AS degraded, CASE WHEN p_brand LIKE '%2' THEN 'unknown' ELSE 'commercial' END AS angle FROM part UNION ALL SELECT 'Brand#0', false, 'unknown'),
    e AS (SELECT p_brand AS pack, split_part(p_name, ' ', 1) AS label, 'heading' AS kind, count(*) AS frequency, count(DISTINCT p_size) AS diversity FROM part GROUP BY 1, 2
          UNION ALL SELECT p_brand, p_type, 'entity', count(*), count(DISTINCT p_size) FROM part GROUP BY 1, 2),
    w AS (SELECT p_brand AS pack, upper(split_part(p_name, ' ', 1)) || '!' AS label, 'faq' AS kind, count(*) AS frequency, 1 AS diversity FROM part WHERE p_size < 10 GROUP BY 1, 2
          UNION ALL SELECT p_brand, split_part(p_name, ' ', 2), 'faq', 1, count(DISTINCT p_type) FROM part WHERE p_size < 10 GROUP BY 1, 2),
    a AS (SELECT pack, label, kind, frequency, diversity, 0 AS part, 'serp_expectation' AS evidence FROM e UNION ALL SELECT pack, label, kind, frequency, diversity, 1, 'missing_opportunity' FROM w
          UNION ALL SELECT pack, angle || ' content angle', 'angle', 1, 1, 2, 'content_angle' FROM packs WHERE angle <> 'unknown'),
    g AS (SELECT pack, trim(regexp_replace(regexp_replace(lower(label), '[^\\p{L}\\p{N}\\s?]', ' ', 'g'), '\\s+', ' ', 'g')) AS key, arg_min(label, (part, label)) AS label, max(frequency)::BIGINT AS f, max(diversity)::BIGINT AS v,
                 list_sort(list(DISTINCT kind)) AS kinds, list_sort(list(DISTINCT evidence)) AS evidence FROM a GROUP BY 1, 2),
    c AS (SELECT g.*, degraded, CASE WHEN f >= 3 AND v >= 3 THEN 'high' WHEN f >= 2 AND v >= 2 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN f >= 3 OR v >= 3 THEN 'deep' WHEN f >= 2 OR v >= 2 THEN 'moderate' ELSE 'shallow' END AS depth
          FROM g JOIN packs ON packs.pack = g.pack WHERE key <> ''),
    i AS (SELECT *, CASE WHEN kinds <> ['entity'] AND f >= 2 AND v >= 2 THEN CASE WHEN degraded THEN 'recommended' ELSE 'must_cover' END WHEN list_contains(evidence, 'missing_opportunity') THEN 'opportunity'
                         WHEN depth = 'moderate' THEN 'recommended' WHEN depth = 'shallow' THEN 'opportunity' ELSE 'monitor' END AS gap, row_number() OVER (PARTITION BY pack ORDER BY v DESC, f DESC, key) AS n FROM c)"""


def intents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, d, "part", "p_brand", "p_name", "p_type", "p_size").withColumnRenamed("p_brand", "pack")
    brands = part.select("pack").distinct()
    packs = brands.select("pack", F.col("pack").endswith("1").alias("degraded"), F.when(F.col("pack").endswith("2"), "unknown").otherwise("commercial").alias("angle")).unionByName(
        brands.agg(F.lit("Brand#0").alias("pack"), F.lit(False).alias("degraded"), F.lit("unknown").alias("angle")))
    word = lambda n: F.split("p_name", " ")[n]
    n, sizes = F.count(F.lit(1)).alias("frequency"), F.count_distinct("p_size").alias("diversity")
    kind = lambda df, name: df.withColumn("kind", F.lit(name)).withColumn("result", F.lit(None).cast("string"))
    expected = kind(part.groupBy("pack", word(0).alias("label")).agg(n, sizes), "heading").unionByName(kind(part.groupBy("pack", F.col("p_type").alias("label")).agg(n, sizes), "entity"))
    small = part.where("p_size < 10")
    missing = kind(small.groupBy("pack", F.concat(F.upper(word(0)), F.lit("!")).alias("label")).agg(n, F.lit(1).cast("long").alias("diversity")), "faq").unionByName(
        kind(small.groupBy("pack", word(1).alias("label")).agg(F.lit(1).cast("long").alias("frequency"), F.count_distinct("p_type").alias("diversity")), "faq"))
    return packs, p.intents(packs, expected, missing)


@query(f"{INTENT_SQL} SELECT pack, n::INT AS n, key, label, f AS frequency, v AS diversity, array_to_string(kinds, ',') AS kinds, array_to_string(evidence, ',') AS evidence, confidence, depth, gap FROM i")
def d19_intents(spark, d):
    _, found = intents(spark, d)
    return found.select("pack", "n", "key", "label", "frequency", "diversity", F.array_join("kinds", ",").alias("kinds"), F.array_join("evidence", ",").alias("evidence"), "confidence", "depth", "gap")


@query(f"""{INTENT_SQL} SELECT packs.pack, packs.degraded, {", ".join(f"coalesce(string_agg(label, ',' ORDER BY n) FILTER (WHERE gap = '{g}'), '') AS {g}" for g in ("must_cover", "recommended", "opportunity", "monitor"))},
           CASE WHEN count(i.pack) = 0 THEN 'SERP Intent Pack built without intent candidates' ELSE '' END AS warnings FROM packs LEFT JOIN i ON i.pack = packs.pack GROUP BY 1, 2""")
def d19_intent_gaps(spark, d):
    packs, found = intents(spark, d)
    lists = [F.coalesce(F.array_join(g, ","), F.lit("")).alias(g) for g in ("must_cover", "recommended", "opportunity", "monitor", "warnings")]
    return p.intent_pack(packs, found).select("pack", "degraded", *lists)


# Jobs of customers; their orders are the assets whose freshness is judged.
MODES, GOALS = ["focused", "manual", "background"], [*p.DISCOVERY, "refresh_demand_metrics", "refresh_planning_packs", "refresh_seo_pack", "refresh_serp"]
TRIGGERS = [*p.TRIGGER_PRIORITY, "no_such_trigger"]
PLAN_SQL = f"""
    WITH a AS (SELECT o_custkey AS job, o_orderkey AS asset, o_orderdate IS NULL OR epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate) >= 365 * 86400000000 AS ttl, o_orderkey % 6 = 0 AS nosnap, o_orderkey % 7 = 0 AS content, o_orderkey % 11 = 0 AS entity,
                      o_orderkey % 13 = 0 AS ontology, o_orderkey % 17 = 0 AS policy FROM orders),
    f AS (SELECT job, asset, CASE WHEN policy OR ontology OR entity OR content THEN 'force_refresh' WHEN ttl OR nosnap THEN 'refresh' ELSE 'reuse' END AS status, ttl OR content OR policy AS crawl, content OR ontology OR entity AS process, nosnap AS serp,
                 array_to_string(list_filter([CASE WHEN ttl THEN 'ttl_expired' END, CASE WHEN nosnap THEN 'serp_changed' END, CASE WHEN content THEN 'content_changed' END, CASE WHEN entity THEN 'entity_missing' END,
                     CASE WHEN ontology THEN 'ontology_updated' END, CASE WHEN policy THEN 'policy_changed' END], lambda x: x IS NOT NULL), ',') AS reasons FROM a)"""


def assets(spark: SparkSession, d: str) -> DataFrame:
    o, k = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate"), F.col("o_orderkey")
    at = F.lit("2002-01-01").cast("timestamp")
    return p.freshness(o.select(F.col("o_custkey").alias("job"), k.alias("asset"), ts("o_orderdate").alias("seen_at"), F.when(k % 6 != 0, at).alias("snapshot_at"), (k % 7 == 0).alias("content"), (k % 11 == 0).alias("entity"),
                                (k % 13 == 0).alias("ontology"), (k % 17 == 0).alias("policy")), at, 365 * 24.0)


@query(f"{PLAN_SQL} SELECT job, asset, reasons, status, crawl, process, serp FROM f")
def d25_freshness_decisions(spark, d):
    return assets(spark, d).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""{PLAN_SQL},
    j AS (SELECT c_custkey AS job, {MODES}[c_custkey % 3 + 1] AS mode, {TRIGGERS}[c_custkey % {len(TRIGGERS)} + 1] AS trigger, {GOALS}[c_custkey % {len(GOALS)} + 1] AS objective FROM customer),
    d AS (SELECT job, bool_or(serp) AS serp, bool_or(crawl) AS crawl, bool_or(process) AS process FROM f GROUP BY 1),
    t AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in p.TRIGGER_PRIORITY.items())}) t(trigger, known)),
    q AS (SELECT j.*, CASE WHEN mode = 'background' AND known IN ('highest', 'high') THEN 'medium' ELSE known END AS priority, coalesce(serp, false) AS serp, coalesce(crawl, false) AS crawl, coalesce(process, false) AS process
          FROM j JOIN t ON t.trigger = j.trigger LEFT JOIN d ON d.job = j.job),
    l AS (SELECT *, list_filter([CASE WHEN list_contains({p.DISCOVERY}, objective) THEN 'discovery_sources' END, CASE WHEN objective = 'refresh_demand_metrics' THEN 'demand_engine' END,
                CASE WHEN objective IN ('refresh_planning_packs', 'refresh_seo_pack') THEN 'seo_pack' END, CASE WHEN serp THEN 'serp_intelligence' END, CASE WHEN crawl THEN 'url_frontier' END, CASE WHEN process THEN 'content_processing' END,
                CASE WHEN process THEN 'knowledge_pipeline' END, CASE WHEN mode = 'focused' AND objective NOT IN ('refresh_planning_packs', 'refresh_seo_pack') THEN 'seo_pack' END], lambda x: x IS NOT NULL) AS targets FROM q)
    SELECT job, objective, priority, trigger = 'manual_research' AS force, unnest(targets) AS target, generate_subscripts(targets, 1)::INT - 1 AS n FROM l""")
def d25_dispatch_plan(spark, d):
    pick = lambda of, k: F.get(F.array(*[F.lit(x) for x in of]), (F.col("c_custkey") % k).cast("int"))
    jobs = read(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("job"), F.lit("t").alias("topic"), pick(MODES, 3).alias("mode"), pick(TRIGGERS, len(TRIGGERS)).alias("trigger"), pick(GOALS, len(GOALS)).alias("objective"))
    return p.dispatch_plan(jobs, assets(spark, d)).drop("topic")


# Page packs of customers: the nation is an entity, orders are facts, order priorities intents, the market segment a heading.
PAGE_SQL = """
    WITH r AS (SELECT c_custkey AS request, 'c' || c_custkey AS candidate_key, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS candidate_label, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'local_page' END, CASE WHEN c_custkey % 3 = 1 THEN 'faq_page' END, 'guide') AS page_type,
                      CASE WHEN c_custkey % 5 > 0 THEN lower(c_mktsegment) || ' plan' END AS keyword, c_custkey % 2 = 0 AS placed, c_custkey % 7 = 0 AS lacks, c_mktsegment, c_nationkey FROM customer),
    f AS (SELECT o_custkey AS request, lpad(o_orderkey::VARCHAR, 9, '0') AS fact_id, 'order ' || o_orderkey AS statement, CASE left(o_orderpriority, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'low' WHEN '4' THEN 'unknown' ELSE 'medium' END AS confidence,
                 o_orderkey % 9 = 0 AS conflict, ['s' || (o_orderkey % 5), 't' || o_orderkey] AS refs FROM orders),
    x AS (SELECT *, conflict OR confidence IN ('low', 'unknown') AS weak FROM f),
    i AS (SELECT o_custkey AS request, left(o_orderpriority, 1)::INT AS seq, left(o_orderpriority, 1) AS intent_id, lower(substr(o_orderpriority, 3)) AS label, CASE WHEN count(*) >= 3 THEN 'mandatory' WHEN count(*) = 2 THEN 'recommended' ELSE 'opportunity' END AS priority,
                 CASE WHEN count(*) >= 3 THEN 'high' END AS confidence, CASE WHEN left(o_orderpriority, 1) IN ('4', '5') THEN 'How ' || lower(substr(o_orderpriority, 3)) || '?' END AS question FROM orders GROUP BY o_custkey, o_orderpriority),
    ev AS (SELECT request, list(fact_id ORDER BY fact_id) AS facts, list(fact_id ORDER BY fact_id) FILTER (WHERE confidence <> 'unknown') AS known, flatten(list(refs ORDER BY fact_id)) AS refs, list(statement ORDER BY fact_id) FILTER (WHERE weak) AS weak,
                  list(statement ORDER BY fact_id) FILTER (WHERE conflict) AS conflicts FROM x GROUP BY 1),"""


def page_pack(spark: SparkSession, d: str) -> p.PagePack:
    k, key = F.col("c_custkey"), F.col("c_custkey").alias("request")
    c = read(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    o = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority").withColumnRenamed("o_custkey", "request")
    requests = c.select(key, F.lit("t").alias("topic"), F.concat(F.lit("c"), k).alias("candidate_key"), F.when(k % 4 > 0, F.col("c_name")).alias("candidate_label"), F.when(k % 3 < 2, F.when(k % 3 == 0, "guide").otherwise("faq_page")).alias("recommended_type"),
                        F.when(k % 3 == 0, "local_page").alias("profile"), F.when(k % 5 > 0, F.concat(F.lower("c_mktsegment"), F.lit(" plan"))).alias("keyword"), F.when(k % 2 == 0, "en").alias("language"), F.lit("").alias("geo"),
                        F.lit(False).alias("degraded"), F.when(k % 7 == 0, F.array(F.lit("SERP Pack"))).otherwise(F.array().cast("array<string>")).alias("lacks"))
    first, label, n = F.substring("o_orderpriority", 1, 1), F.lower(F.substr("o_orderpriority", F.lit(3))), F.count(F.lit(1))
    facts = o.select("request", F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("fact_id"), F.concat(F.lit("order "), "o_orderkey").alias("statement"),
                     F.when(first == "1", "high").when(first == "3", "low").when(first == "4", "unknown").otherwise("medium").alias("confidence"), (F.col("o_orderkey") % 9 == 0).alias("conflict"),
                     F.array(F.concat(F.lit("s"), F.col("o_orderkey") % 5), F.concat(F.lit("t"), "o_orderkey")).alias("source_ids"))
    intents = o.groupBy("request", "o_orderpriority").agg(n.alias("n")).select(
        "request", first.cast("int").alias("seq"), first.alias("intent_id"), label.alias("label"), F.when(F.col("n") >= 3, "mandatory").when(F.col("n") == 2, "recommended").otherwise("opportunity").alias("priority"),
        F.when(F.col("n") >= 3, "high").alias("confidence"), F.when(first.isin("4", "5"), F.concat(F.lit("How "), label, F.lit("?"))).alias("question"))
    entities = c.join(read(spark, d, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select(key, F.col("n_name").alias("label"), F.concat(F.lit("n"), "n_nationkey").alias("entity_id"))
    heads = c.select(key, F.posexplode(F.array(F.col("c_mktsegment"), F.concat(F.lower("c_mktsegment"), F.lit("!")), F.lit("all segments"))).alias("seq", "heading")).withColumn("frequency", F.col("seq"))
    asked = c.select(key, F.lit(0).alias("seq"), F.lit("How low?").alias("question"), F.lit(None).cast("string").alias("confidence"))
    tail = c.select(key, F.posexplode(F.array(F.lit("How low?"), F.concat(F.lit("Why "), F.lower("c_mktsegment"), F.lit("?")))).alias("seq", "question"))
    labels = c.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda x: F.concat("c_mktsegment", F.lit(" "), x))).alias("seq", "label"))
    return p.PagePack(requests, entities, facts, intents, heads, asked, tail, labels)


TITLE = "array_to_string(list_transform(string_split({}, ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ')"


@query(f"""{PAGE_SQL}
    m AS (SELECT request, string_agg(intent_id, ',' ORDER BY seq) FILTER (WHERE priority IN ('mandatory', 'recommended')) AS ids FROM i GROUP BY 1),
    s AS (SELECT r.request, 0 AS part, 0 AS seq, 'overview' AS key, {TITLE.format('coalesce(keyword, candidate_key)')} AS heading, coalesce(ids, '') AS intent_ids, coalesce(array_to_string(facts[1:5], ','), '') AS fact_ids,
                 coalesce(array_to_string(refs[1:5], ','), '') AS refs, CASE WHEN facts IS NULL THEN 'low' ELSE 'medium' END AS confidence FROM r LEFT JOIN ev ON ev.request = r.request LEFT JOIN m ON m.request = r.request
          UNION ALL SELECT i.request, 1, seq, 'intent:' || intent_id, {TITLE.format('label')}, intent_id, coalesce(array_to_string(known[1:3], ','), ''), '', coalesce(confidence, 'unknown') FROM i JOIN ev ON ev.request = i.request WHERE priority IN ('mandatory', 'opportunity')
          UNION ALL SELECT request, 2, 0, 'serp-heading:' || lower(c_mktsegment), c_mktsegment, '', '', '', 'low' FROM r
          UNION ALL SELECT request, 2, 2, 'serp-heading:all-segments', 'All Segments', '', '', '', 'medium' FROM r)
    SELECT request, row_number() OVER (PARTITION BY request ORDER BY part, seq)::INT AS n, key, heading, intent_ids, fact_ids, refs, confidence FROM s""")
def d23_outline(spark, d):
    joined = [F.array_join(c, ",").alias(c) for c in ("intent_ids", "fact_ids", "refs")]
    return page_pack(spark, d).outline().select("request", "n", "key", "heading", *joined, "confidence")


@query(f"""{PAGE_SQL}
    q AS (SELECT request, 0 AS part, 0 AS seq, 'How low?' AS question, NULL AS intent_id, 'recommended' AS priority, 'unknown' AS confidence, true AS cites FROM r
          UNION ALL SELECT request, 1, seq, question, intent_id, priority, coalesce(confidence, 'unknown'), true FROM i WHERE question IS NOT NULL AND question <> 'How low?'
          UNION ALL SELECT request, 2, 1, 'Why ' || lower(c_mktsegment) || '?', NULL, 'opportunity', 'low', false FROM r)
    SELECT q.request, row_number() OVER (PARTITION BY q.request ORDER BY part, seq)::INT AS n, question, intent_id, priority, confidence, CASE WHEN cites THEN coalesce(array_to_string(facts[1:3], ','), '') ELSE '' END AS fact_ids FROM q LEFT JOIN ev ON ev.request = q.request""")
def d23_faq(spark, d):
    return page_pack(spark, d).faq().select("request", "n", "question", "intent_id", "priority", "confidence", F.array_join("fact_ids", ",").alias("fact_ids"))


@query(f"""{PAGE_SQL}
    c AS (SELECT request, 0 AS part, fact_id AS seq, CASE WHEN conflict THEN 'resolve_conflict_before_claim' WHEN weak THEN 'do_not_assert_weak_fact' ELSE 'cite_required_fact' END AS code,
                 CASE WHEN conflict THEN 'Resolve conflict before asserting: ' WHEN weak THEN 'Do not assert weak fact without more evidence: ' ELSE 'Cite required fact: ' END || statement AS detail, conflict AS blocking FROM x
          UNION ALL SELECT request, 1, intent_id, CASE priority WHEN 'mandatory' THEN 'cover_required_intent' ELSE 'consider_opportunity_intent' END, CASE priority WHEN 'mandatory' THEN 'Cover required intent: ' ELSE 'Consider opportunity intent: ' END || label, false
          FROM i WHERE priority <> 'recommended'
          UNION ALL SELECT request, 2, '', 'respect_language_geo', 'Respect requested language and geographic context.', false FROM r WHERE placed)
    SELECT request, row_number() OVER (PARTITION BY request ORDER BY part, seq)::INT AS n, code, detail, blocking FROM c""")
def d23_constraints(spark, d):
    return page_pack(spark, d).constraints().select("request", "n", "code", "detail", "blocking")


@query(f"""{PAGE_SQL}
    m AS (SELECT request, arg_min(intent_id, k) AS id, arg_min(label, k) AS label FROM (SELECT *, (CASE priority WHEN 'mandatory' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END, seq) AS k FROM i) GROUP BY 1),
    o AS (SELECT i.request, string_agg(i.label, ',' ORDER BY seq) AS secondary FROM i JOIN m ON m.request = i.request WHERE intent_id <> id GROUP BY 1)
    SELECT r.request, 't:' || candidate_key || ':' || page_type AS pack_key, coalesce(candidate_label, keyword, candidate_key) AS title, CASE WHEN page_type = 'local_page' THEN 'Local searchers' END AS audience, m.label AS primary_intent,
           coalesce(secondary, '') AS secondary_intents, array_to_string(list_transform(range(1, 9), lambda x: lower(c_mktsegment) || ' ' || x), ',') AS links, coalesce(array_to_string(weak, ','), '') AS weak, coalesce(array_to_string(conflicts, ','), '') AS conflicts,
           CASE WHEN lacks THEN 'SEO Pack built without SERP Pack' ELSE '' END AS warnings, lacks OR coalesce(len(weak), 0) > 0 OR facts IS NULL AS degraded
    FROM r LEFT JOIN ev ON ev.request = r.request LEFT JOIN m ON m.request = r.request LEFT JOIN o ON o.request = r.request""")
def d23_page_packs(spark, d):
    lists = [F.array_join(c, ",").alias(c) for c in ("secondary_intents", "links", "weak", "conflicts", "warnings")]
    return page_pack(spark, d).header().select("request", "pack_key", "title", "audience", "primary_intent", *lists, "degraded")
