"""Reevaluation, extraction outcomes, generation contexts and reviews over the test tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ports
from tessera.functions import web as w
from tessera.operators import workflow as x
from tessera.plans.scalar_queries import HOST_SQL, PATH_SQL, TITLE_SQL
from tessera.sources.shared import staged
from tessera.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# A page is an observation for one of five topics. Each of four configurations allows the hosts of pages whose number ends in a digit that it takes.
CONFIGS = {  # topic: digits, denied digit, included, excluded, excluded terms, required groups, weights, adjustment, least, exploratory
    0: ("01234567", 3, [], [], ["und"], [["the", "que"]], {"ing": 0.2, "tion": 0.1, "zz": -0.9}, -0.1, 0.55, False), 1: ("0123456789", 9, ["/en/*", "/fr/*"], ["/en/1*"], [], [], {"com": 0.3, "org": -0.4}, 0.2, 0.5, False),
    2: ("02468", 8, [], ["*/2*"], ["%%%"], [["the"], ["and", "net"]], {"example": 0.05}, 0.0, 0.5, True), 3: ("13579", 1, ["*"], [], ["nothing"], [["es", "de"]], {"page": -0.6, "en": 0.01}, 0.4, 0.3, True)}


def _list(values, one=lambda v: f"'{v}'") -> str:
    return "[" + ", ".join(one(v) for v in values) + "]" + ("::VARCHAR[]" if not values else "")


CONFIG_SQL = "(VALUES " + ", ".join(
    f"({topic}, '{digits}', {denied}, {_list([p.replace('.', chr(92) + '.').replace('*', '.*') for p in inc])}, {_list([p.replace('.', chr(92) + '.').replace('*', '.*') for p in exc])}, {_list(terms)}, {'[' + ', '.join(_list(g) for g in req) + ']' + ('::VARCHAR[][]' if not req else '')}, "
    f"[{', '.join(f'{{term: {chr(39)}{k}{chr(39)}, weight: {v}::DOUBLE}}' for k, v in weights.items())}], {adjust}::DOUBLE, {least}::DOUBLE, {str(explore).lower()})"
    for topic, (digits, denied, inc, exc, terms, req, weights, adjust, least, explore) in CONFIGS.items()) + ") c(topic, digits, denied_digit, inc, exc, terms, req, weights, adjust, least, explore)"
REEVALUATED_SQL = f"""
    WITH o AS (SELECT page_id AS id, page_id % 5 AS topic, url, {HOST_SQL} AS host, {PATH_SQL} AS path, lower(url || coalesce(' ' || {TITLE_SQL}, '')) AS said FROM pages),
    h AS (SELECT topic, host, bool_or(contains(digits, (page_id % 10)::VARCHAR)) AS allowed, bool_or(page_id % 10 = denied_digit) AS denied, bool_or(page_id % 10 = 0) AS adjusted
          FROM (SELECT page_id, {HOST_SQL} AS host FROM pages), {CONFIG_SQL} GROUP BY 1, 2),
    j AS (SELECT o.*, c.*, h.allowed, h.denied, round(greatest(0.0, least(1.0, 0.5 + coalesce(list_sum(list_transform(weights, lambda z: CASE WHEN contains(said, z.term) THEN z.weight ELSE 0.0 END)), 0) + CASE WHEN adjusted THEN adjust ELSE 0.0 END)), 9) AS sc
          FROM o LEFT JOIN {CONFIG_SQL} ON c.topic = o.topic LEFT JOIN h ON h.topic = o.topic AND h.host = o.host),
    r AS (SELECT *, CASE WHEN digits IS NULL THEN 'missing_snapshot' WHEN denied THEN 'denied_host' WHEN NOT allowed THEN 'host_not_allowed'
              WHEN len(inc) > 0 AND NOT list_bool_or(list_transform(inc, lambda p: regexp_full_match(path, p))) THEN 'path_not_included' WHEN list_bool_or(list_transform(exc, lambda p: regexp_full_match(path, p))) THEN 'path_excluded'
              WHEN list_bool_or(list_transform(terms, lambda p: contains(said, p))) THEN 'excluded_term' WHEN list_bool_or(list_transform(req, lambda g: NOT list_bool_or(list_transform(g, lambda p: contains(said, p))))) THEN 'missing_required_pre_crawl_evidence'
              WHEN sc < least THEN 'below_minimum_score' ELSE 'pre_crawl_evidence_matched' END AS reason FROM j),
    d AS (SELECT id, r.id % 5 AS topic, url, reason, sc, CASE WHEN reason = 'missing_snapshot' THEN reason WHEN reason = 'pre_crawl_evidence_matched' THEN 'accepted' WHEN reason = 'missing_required_pre_crawl_evidence' AND explore THEN 'insufficient_evidence' ELSE 'rejected' END AS decision FROM r),
    e AS (SELECT id, topic, url, decision, reason, CASE WHEN reason IN ('pre_crawl_evidence_matched', 'below_minimum_score') THEN sc WHEN decision IN ('insufficient_evidence', 'missing_snapshot') THEN NULL ELSE 0.0 END AS score FROM d),
    f AS (SELECT *, CASE decision WHEN 'accepted' THEN (floor(score * 400 + 0.5) + 265)::INT WHEN 'insufficient_evidence' THEN 365 WHEN 'rejected' THEN 0 END AS priority FROM e)"""


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages", "page_id", "url", "html")
    digit = (F.col("page_id") % 10).cast("string")
    hosts = pages.select(w.host_of(F.col("url")).alias("host"), digit.alias("digit")).where("host is not null")
    configs = spark.createDataFrame(
        [(topic, 1, digits, str(denied), inc, exc, terms, req, [(k, v) for k, v in weights.items()], adjust, least, explore) for topic, (digits, denied, inc, exc, terms, req, weights, adjust, least, explore) in CONFIGS.items()],
        "topic long, version int, digits string, denied_digit string, included array<string>, excluded array<string>, excluded_terms array<string>, required array<array<string>>, weighted array<struct<term:string,weight:double>>, adjust double, least double, exploratory boolean")
    of = lambda cond: F.collect_set(F.when(cond, F.col("host")))
    per = hosts.withColumn("topic", F.explode(F.array(*[F.lit(k).cast("long") for k in CONFIGS]))).join(F.broadcast(configs.select("topic", "digits", "denied_digit")), "topic")  # four rows
    per = per.groupBy("topic").agg(of(F.contains(F.col("digits"), F.col("digit"))).alias("allowed"), of(F.col("digit") == F.col("denied_digit")).alias("denied"), of(F.col("digit") == "0").alias("adjusted"))
    snapshots = configs.join(per, "topic").withColumn("adjustments", F.transform("adjusted", lambda h: F.struct(h.alias("host"), F.col("adjust").alias("value")))).drop("adjusted", "adjust", "digits", "denied_digit")
    observations = pages.select(F.col("page_id").alias("id"), (F.col("page_id") % 5).alias("topic"), F.lit(1).alias("version"), "url", w.page_title(F.col("html")).alias("title"), F.lit("").alias("snippet"), F.lit(None).cast("string").alias("anchor"))
    return x.reevaluate(observations, snapshots)


@query(f"{REEVALUATED_SQL} SELECT * FROM f")
def d13_reevaluation(spark, d):
    return evaluated(spark, d)


@query(f"{REEVALUATED_SQL} SELECT topic, sha256(topic || chr(0) || url) AS url_hash, arg_max(decision, id) AS decision, arg_max(coalesce(score, -1), id) AS score, arg_max(priority, id) AS priority FROM f WHERE decision <> 'missing_snapshot' GROUP BY topic, url")
def d13_entry_seeds(spark, d):
    return x.entries_of(evaluated(spark, d)).select("topic", "url_hash", "decision", F.coalesce("score", F.lit(-1.0)).alias("score"), "priority")


# The lines of an order are what a provider finds in the chunk of that number; documents are the chunks.
ALIASES = sorted((a, p) for a, p in ports.PREDICATE_ALIASES) + [("costs", "predicate-has-price"), ("Costs", "predicate-mentions")]
ATTEMPTS_SQL = f"""
    WITH a AS (SELECT alias, count(DISTINCT id) AS n, min(id) AS id FROM (SELECT lower(alias) AS alias, id FROM (VALUES {", ".join(f"('{a}', '{p}')" for a, p in ALIASES)}) v(alias, id)) GROUP BY 1),
    c AS (SELECT l_orderkey AS chunk_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS n, CASE WHEN l_suppkey % 11 > 0 THEN 's' END AS subject, ['price', ' Available_in ', 'unheard of', '  ', 'COSTS', 'applies-to'][l_partkey % 6 + 1] AS predicate,
                 CASE WHEN l_linenumber % 7 > 0 THEN l_linestatus END AS object, CASE l_partkey % 5 WHEN 0 THEN '[1]' WHEN 1 THEN 'x' ELSE '{{"a":1}}' END AS attributes, l_discount * 13 AS confidence FROM lineitem),
    k AS (SELECT *, CASE WHEN subject IS NULL THEN 'Raw fact candidate is missing a known subject entity' WHEN trim(predicate) = '' THEN 'Raw fact candidate is missing a predicate candidate' WHEN object IS NULL THEN 'Raw fact candidate is missing an object candidate'
                 WHEN attributes NOT LIKE '{{%' THEN 'Raw fact candidate attributes must be a JSON object' WHEN confidence > 1 THEN 'Raw fact candidate confidence must be between 0 and 1' WHEN confidence < 0.4 THEN 'Raw fact candidate confidence is below the profile threshold' END AS failed,
                 lower(regexp_replace(regexp_replace(trim(predicate), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM c),
    s AS (SELECT k.*, a.id, CASE WHEN failed IS NOT NULL THEN 'pending_review' WHEN a.n = 1 THEN 'resolved' WHEN a.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM k LEFT JOIN a ON a.alias = name),
    t AS (SELECT chunk_id, n, status, CASE WHEN status = 'resolved' THEN id END AS predicate_id, failed IS NULL AS raw, failed IS NULL AND status = 'resolved' AND confidence >= 0.6 AS canonical, failed FROM s)"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    li, k = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_discount"), F.col("l_partkey")
    predicates = F.array(*[F.lit(p) for p in ("price", " Available_in ", "unheard of", "  ", "COSTS", "applies-to")])
    candidates = li.select(F.col("l_orderkey").alias("chunk_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("n"), F.when(F.col("l_suppkey") % 11 > 0, "s").alias("subject"), F.get(predicates, (k % 6).cast("int")).alias("predicate"),
                           F.when(F.col("l_linenumber") % 7 > 0, F.col("l_linestatus")).alias("object"), F.when(k % 5 == 0, "[1]").when(k % 5 == 1, "x").otherwise('{"a":1}').alias("attributes"), (F.col("l_discount") * 13).alias("confidence"))
    return x.normalization_attempts(candidates, spark.createDataFrame(ALIASES, "alias string, predicate_id string"))


@query(f"{ATTEMPTS_SQL} SELECT chunk_id, n, status, predicate_id, raw, canonical, coalesce(failed, CASE WHEN canonical THEN NULL WHEN status = 'resolved' THEN 'below_canonical_confidence' ELSE 'predicate_' || status END) AS reason FROM t")
def d7_normalization_attempts(spark, d):
    return attempts(spark, d)


@query(f"""{ATTEMPTS_SQL}, g AS (SELECT chunk_id, count(*) FILTER (WHERE raw) AS raw, count(*) FILTER (WHERE canonical) AS canonical, count(*) FILTER (WHERE NOT canonical) AS rejected FROM t GROUP BY 1),
    o AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'already_processed' WHEN coalesce(n_chars, 0) < 500 THEN 'skipped' WHEN doc_id % 9 = 0 THEN 'provider_unavailable' WHEN doc_id % 10 = 1 THEN 'failed' ELSE 'completed' END AS status FROM documents)
    SELECT doc_id AS chunk_id, status, {", ".join(f"CASE WHEN status = 'completed' THEN coalesce({c}, 0) ELSE 0 END::BIGINT AS {c}" for c in ("raw", "canonical", "rejected"))} FROM o LEFT JOIN g ON g.chunk_id = doc_id""")
def d7_extraction_outcomes(spark, d):
    done = read(spark, d, "labels", "doc_id").distinct().withColumn("done", F.lit(True))
    k = F.col("doc_id")
    chunks = read(spark, d, "documents", "doc_id", "n_chars").join(done, "doc_id", "left").select(
        k.alias("chunk_id"), F.coalesce("done", F.lit(False)).alias("done"), (F.coalesce("n_chars", F.lit(0)) >= 500).alias("selected"), F.when(k % 9 == 0, "unavailable").when(k % 10 == 1, "error").otherwise("ok").alias("provider"))
    return x.extraction_outcomes(chunks, attempts(spark, d))


@query("""
    WITH r AS (SELECT c_custkey AS request, c_custkey % 5 > 0 AS pack, c_custkey % 2 = 0 AS fallback, c_custkey % 3 = 0 AS context, c_custkey % 4 < 3 AS planned, c_custkey % 8 = 0 AS thin, c_custkey % 7 = 0 AS asked, c_custkey % 25 = 1 AS stopped, c_custkey % 6 = 0 AS weak, c_name FROM customer),
    g AS (SELECT *, CASE WHEN pack THEN 'structured_context_available' WHEN fallback THEN 'supplemental_context_only' ELSE 'blocked_raw_retrieval_only' END AS safeguard,
                 list_filter([CASE WHEN planned THEN CASE WHEN thin THEN 'plan is thin' END ELSE 'Focused Research must be requested before SEO generation.' END,
                     CASE WHEN NOT pack THEN CASE WHEN fallback THEN 'SEO Pack is unavailable; structured fallback context is degraded.' WHEN context THEN 'Context Pack cannot be the only SEO generation context when structured SEO packs are missing.'
                          ELSE 'No structured SEO context is available for generation.' END END, CASE WHEN pack THEN CASE WHEN weak THEN 'SEO Pack built without SERP Pack' END ELSE 'SEO Pack is unavailable' END], lambda w: w IS NOT NULL) AS warnings FROM r),
    s AS (SELECT *, CASE WHEN stopped OR safeguard = 'blocked_raw_retrieval_only' THEN 'blocked' WHEN len(warnings) > 0 OR (pack AND weak) THEN 'degraded' ELSE 'complete' END AS state FROM g)
    SELECT request, 't:guide:' || CASE WHEN request % 3 > 0 THEN 'c' || request ELSE c_name END AS key, CASE WHEN planned THEN CASE WHEN thin THEN 'degraded' ELSE 'satisfied' END WHEN asked THEN 'requested' ELSE 'required' END AS research, safeguard, state,
           state = 'blocked' AS is_blocked, array_to_string(warnings, '|') AS warnings,
           '## Generation Request' || chr(10) || '- Query: ' || c_name || chr(10) || '- Fallback state: ' || state || chr(10) || chr(10) || '## Warnings' || chr(10) || CASE WHEN len(warnings) > 0 THEN array_to_string(list_transform(warnings, lambda w: '- ' || w), chr(10)) ELSE '- none' END AS prompt
    FROM s""")
def d24_generation_gate(spark, d):
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    requests = read(spark, d, "customer", "c_custkey", "c_name").select(
        k.alias("request"), F.lit("t").alias("topic"), F.lit("guide").alias("objective"), F.col("c_name").alias("query"), F.when(k % 3 > 0, F.concat(F.lit("c"), k)).alias("candidate_key"), (k % 5 > 0).alias("has_pack"), (k % 6 == 0).alias("pack_degraded"),
        F.when(k % 6 == 0, F.array(F.lit("SEO Pack built without SERP Pack"))).otherwise(none).alias("pack_warnings"), (k % 2 == 0).alias("has_fallback"), (k % 3 == 0).alias("has_context"), F.when(k % 4 < 3, "job").alias("plan_key"), (k % 8 == 0).alias("plan_degraded"),
        F.when(k % 8 == 0, F.array(F.lit("plan is thin"))).otherwise(none).alias("plan_warnings"), (k % 7 == 0).alias("force_research"), (k % 25 == 1).alias("blocked"))
    found = x.generation_contexts(requests).join(requests.select("request", "query"), "request")
    message = x.prompt({"Generation Request": F.array(F.concat(F.lit("Query: "), "query"), F.concat(F.lit("Fallback state: "), "state")), "Warnings": F.col("warnings")})
    return found.select("request", "key", "research", "safeguard", "state", "is_blocked", F.array_join("warnings", "|").alias("warnings"), message.alias("prompt"))


@query("""
    WITH c AS (SELECT user_id AS attempt, event_id AS seq, event_type AS provider, 'n' || (event_id % 20) AS name, CASE WHEN event_id % 3 = 0 THEN 'x' || (event_id % 30) END AS external_id FROM events),
    r AS (SELECT event_id AS id, CASE WHEN event_id % 49 = 0 THEN -1 ELSE user_id END AS attempt, event_id % 2 = 0 AS by_id, CASE WHEN event_id % 77 = 0 THEN ' ' ELSE event_type END AS provider, 'n' || (event_id % 23) AS name, CASE WHEN event_id % 5 > 0 THEN 'x' || (event_id % 28) END AS external_id FROM events WHERE event_id % 7 = 0),
    p AS (SELECT *, CASE WHEN trim(provider) = '' THEN 'provider is required' WHEN by_id AND external_id IS NULL THEN 'external_id is required' END AS problem FROM r),
    e AS (SELECT p.id, min(seq) AS evidence_seq FROM p JOIN c ON c.attempt = p.attempt AND c.provider = p.provider AND CASE WHEN by_id THEN c.external_id = p.external_id ELSE c.name = p.name AND (p.external_id IS NULL OR c.external_id = p.external_id) END WHERE problem IS NULL GROUP BY 1)
    SELECT p.id, CASE WHEN problem IS NOT NULL THEN problem WHEN p.attempt = -1 THEN 'attempt not found' WHEN evidence_seq IS NULL THEN 'evidence not found' ELSE 'approved' END AS outcome, evidence_seq FROM p LEFT JOIN e ON e.id = p.id""")
def d26_reviews(spark, d):
    e, k = read(spark, d, "events", "event_id", "user_id", "event_type"), F.col("event_id")
    x_of = lambda n: F.concat(F.lit("x"), k % n)
    candidates = e.select(F.col("user_id").alias("attempt"), k.alias("seq"), F.col("event_type").alias("provider"), F.concat(F.lit("n"), k % 20).alias("name"), F.when(k % 3 == 0, x_of(30)).alias("external_id"), F.when(k % 3 == 0, "wiki").alias("external_id_type"))
    reviews = e.where(k % 7 == 0).select(k.alias("id"), F.when(k % 49 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")).alias("attempt"), F.when(k % 2 == 0, "external_id").otherwise("candidate").alias("subject_type"),
                                         F.when(k % 77 == 0, " ").otherwise(F.col("event_type")).alias("provider"), F.concat(F.lit("n"), k % 23).alias("name"), F.when(k % 5 > 0, x_of(28)).alias("external_id"), F.lit("wiki").alias("external_id_type"),
                                         F.lit("approved").alias("decision"), F.lit("someone").alias("reviewer"))
    return x.reviewed(reviews, candidates)


# Topics are suppliers' nations: each has the names of its customers as queries, its suppliers as sitemaps, its nearest numbers as seeds.
@query("""
    WITH t AS (SELECT n_nationkey AS topic, n_regionkey AS version, n_nationkey % 2 = 0 AS search, n_nationkey % 3 > 0 AS sitemap, n_nationkey % 5 > 0 AS seed, 10 + n_nationkey AS max_results FROM nation),
    u AS (SELECT n_nationkey AS topic, ['https://seed.example/' || n_name, 'https://seed.example/' || n_regionkey] AS urls FROM nation),
    r AS (SELECT c_nationkey AS topic, 'search' AS source_type, 'default-search' AS provider, sha256('search' || chr(0) || 'default-search' || chr(0) || c_mktsegment || ' ' || c_custkey % 7 || chr(0) || 'en' || chr(0) || '' || chr(0) || (10 + c_nationkey)) AS source_key, '' AS urls
          FROM (SELECT DISTINCT c_nationkey, c_mktsegment, c_custkey % 7 AS c_custkey FROM customer)
          UNION ALL SELECT s_nationkey, 'sitemap', 'sitemap', sha256('sitemap' || chr(0) || 'sitemap' || chr(0) || 'https://x.example/' || s_suppkey), 'https://x.example/' || s_suppkey FROM supplier
          UNION ALL SELECT topic, 'seed', 'seed', sha256('seed' || chr(0) || 'seed' || chr(0) || array_to_string(urls, chr(0))), array_to_string(urls, ' ') FROM u)
    SELECT r.topic, t.version, source_type, provider, source_key, sha256(r.topic || chr(0) || t.version || chr(0) || source_type || chr(0) || source_key || chr(0) || '1') AS planning_key, urls FROM r JOIN t ON t.topic = r.topic
    WHERE CASE source_type WHEN 'search' THEN search WHEN 'sitemap' THEN sitemap ELSE seed END""")
def d16_discovery_runs(spark, d):
    n, k = read(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), F.col("n_nationkey")
    topics = n.select(k.alias("topic"), F.col("n_regionkey").alias("version"), (k % 2 == 0).alias("search"), (k % 3 > 0).alias("sitemap"), (k % 5 > 0).alias("seed"), (k + 10).alias("max_results"))
    queries = read(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select(F.col("c_nationkey").alias("topic"), F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey") % 7).alias("text"), F.lit("en").alias("language"), F.lit("").alias("geo")).distinct()
    sitemaps = read(spark, d, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_nationkey").alias("topic"), F.concat(F.lit("https://x.example/"), "s_suppkey").alias("url"))
    seeds = n.select(k.alias("topic"), F.posexplode(F.array(F.concat(F.lit("https://seed.example/"), "n_name"), F.concat(F.lit("https://seed.example/"), "n_regionkey"))).alias("rank", "url"))
    return x.discovery_plans(topics, queries, sitemaps, seeds).withColumn("urls", F.array_join("urls", " "))


@query("""
    WITH m AS (SELECT 'user ' || user_id AS keyword, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS impressions FROM events GROUP BY user_id),
    w AS (SELECT keyword, 'analytics' AS provider, clicks::DOUBLE AS traffic_potential, impressions::DOUBLE AS search_volume, CASE WHEN impressions > 0 THEN clicks / impressions::DOUBLE END AS trend FROM m
          UNION ALL SELECT DISTINCT p_name, 'fallback', NULL, NULL, NULL FROM part)
    SELECT keyword, provider, unnest(['traffic_potential', 'search_volume', 'trend']) AS metric, unnest([traffic_potential, search_volume, trend]) AS value FROM w""")
def s9_metric_observations(spark, d):
    e = read(spark, d, "events", "user_id", "event_type").groupBy(F.concat(F.lit("user "), "user_id").alias("keyword")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("impressions"))
    wanted = e.select("keyword").unionByName(read(spark, d, "part", "p_name").select(F.col("p_name").alias("keyword")))
    return x.metric_observations(e.withColumn("provider", F.lit("analytics")), wanted)


def _normal_sql(url: str) -> str:
    return (f"(regexp_extract(lower({url}), '^(https?://[^/?#]+)', 1) || coalesce(nullif(regexp_extract({url}, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') || regexp_extract({url}, '^[^?#]*(\\?[^#]*)', 1))")


# Every page names a canonical url: its own, no url, that of the page before the last of its topic, a denied one, one of a host that is not allowed, a missing one, that of a page of the other topic.
@query(f"""
    WITH e AS (SELECT page_id AS entry, page_id % 2 AS topic, {_normal_sql('url')} AS url, {HOST_SQL} AS host FROM pages), h AS (SELECT DISTINCT topic, host FROM e WHERE host IS NOT NULL UNION SELECT 0, 'spam.example'),
    t AS (SELECT topic, url, min(entry) AS target FROM e GROUP BY 1, 2),
    c AS (SELECT p.page_id AS id, CASE WHEN p.page_id % 50 = 49 THEN -1 ELSE p.page_id END AS source, CASE p.page_id % 7 WHEN 0 THEN p.url WHEN 1 THEN NULL WHEN 2 THEN b.url WHEN 3 THEN 'https://spam.example/' WHEN 4 THEN 'https://other.example/'
                 WHEN 5 THEN 'https://' || {HOST_SQL.replace('url', 'p.url')} || '/no/such/page' ELSE a.url END AS raw FROM pages p LEFT JOIN pages a ON a.page_id = p.page_id - 1 LEFT JOIN pages b ON b.page_id = p.page_id - 2),
    n AS (SELECT *, CASE WHEN raw IS NOT NULL THEN {_normal_sql('raw')} END AS url, {HOST_SQL.replace('url', 'raw')} AS host FROM c),
    r AS (SELECT n.id, n.source, target, CASE WHEN e.entry IS NULL THEN 'source_entry_missing' WHEN n.url IS NULL THEN 'malformed_target_url' WHEN n.url = e.url THEN 'self' WHEN n.host = 'spam.example' THEN 'target_denied_host' WHEN h.host IS NULL THEN 'target_host_not_allowed'
                 WHEN n.host <> e.host AND e.topic = 1 THEN 'cross_host_canonical_not_allowed' WHEN target IS NULL THEN 'target_entry_missing' END AS reason
          FROM n LEFT JOIN e ON e.entry = n.source LEFT JOIN h ON h.topic = e.topic AND h.host = n.host LEFT JOIN t ON t.topic = e.topic AND t.url = n.url),
    s AS (SELECT *, CASE WHEN reason IS NULL THEN 'consolidated' WHEN reason = 'self' THEN 'self_canonical' WHEN reason = 'target_entry_missing' THEN 'recorded_unresolved' ELSE 'rejected' END AS status FROM r)
    SELECT id, status, CASE WHEN reason <> 'self' THEN reason END AS reason, CASE status WHEN 'self_canonical' THEN source WHEN 'consolidated' THEN target END AS target_entry, status <> 'self_canonical' AND coalesce(reason, '') <> 'source_entry_missing' AS relation,
           CASE WHEN status = 'consolidated' THEN source END AS suppressed FROM s""")
def d15_consolidation(spark, d):
    pages, k = read(spark, d, "pages", "page_id", "url"), F.col("page_id")
    entries = pages.select(k.alias("entry"), (k % 2).alias("topic"), w.normalize_url(F.col("url")).alias("url"))
    policies = entries.groupBy("topic").agg(F.collect_set(w.host_of(F.col("url"))).alias("allowed")).withColumn("denied", F.array(F.lit("spam.example"))).withColumn("cross_host", F.when(F.col("topic") == 1, "same-host").otherwise("observe"))
    earlier = lambda n: pages.select((k + n).alias("page_id"), F.col("url").alias(f"url_{n}"))
    j = pages.join(earlier(1), "page_id", "left").join(earlier(2), "page_id", "left")
    named = (F.when(k % 7 == 0, F.col("url")).when(k % 7 == 1, None).when(k % 7 == 2, F.col("url_2")).when(k % 7 == 3, "https://spam.example/").when(k % 7 == 4, "https://other.example/")
             .when(k % 7 == 5, F.concat(F.lit("https://"), w.host_of(F.col("url")), F.lit("/no/such/page"))).otherwise(F.col("url_1")))
    return x.consolidate(j.select(k.alias("id"), F.when(k % 50 == 49, F.lit(-1).cast("long")).otherwise(k).alias("source"), named.alias("target_url")), entries, policies)


# Recorded responses of the pages: redirects to the next or the last page or to themselves, errors, a text, a page that is too large.
@query(f"""
    WITH RECURSIVE u AS (SELECT page_id, url, lead(url) OVER (ORDER BY page_id) AS following, lag(url) OVER (ORDER BY page_id) AS before, length(html) AS bytes FROM pages),
    a AS (SELECT url, [301, 200, 404, 302, 200, 503, 307, 429, 200][page_id % 9 + 1] AS code, CASE page_id % 9 WHEN 0 THEN following WHEN 3 THEN before WHEN 6 THEN '/loop' END AS location, CASE WHEN page_id % 9 = 4 THEN 'text/plain' ELSE 'text/HTML; charset=utf-8' END AS kind,
                 CASE WHEN page_id % 9 = 8 THEN 9000000 ELSE bytes END AS bytes FROM u QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
    q AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT -page_id - 1, 'http://10.0.0.' || page_id % 250 || '/' FROM pages WHERE page_id % 10 = 0),
    g AS (SELECT id, url, 0 AS hop, [] ::VARCHAR[] AS chain FROM q
          UNION ALL SELECT id, CASE WHEN location LIKE '/%' THEN regexp_extract(lower(g.url), '^[a-z]+://[^/?#]+') || location ELSE location END, hop + 1, list_append(chain, g.url) FROM g JOIN a ON a.url = g.url WHERE code IN (301, 302, 307) AND location IS NOT NULL AND hop < 2),
    l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY hop DESC) = 1),
    c AS (SELECT id, l.url AS final_url, code AS http_status, chain, CASE WHEN l.url LIKE 'http://10.%' THEN 'unsafe_target' WHEN code IS NULL THEN 'connection_failure' WHEN code IN (301, 302, 307) THEN 'policy_redirect_blocked' WHEN a.bytes > 5000000 THEN 'content_too_large'
                 WHEN kind = 'text/plain' THEN 'unsupported_content_type' WHEN code = 429 THEN 'http_429' WHEN code >= 500 THEN 'http_5xx' WHEN code >= 400 THEN 'adapter_error' END AS category FROM l LEFT JOIN a ON a.url = l.url)
    SELECT id, CASE WHEN category = 'unsafe_target' THEN 'blocked_by_policy' WHEN category IN ('connection_failure', 'http_429', 'http_5xx') THEN 'failed_retryable' WHEN category IS NOT NULL THEN 'failed_terminal' ELSE 'succeeded' END AS status, category, final_url, http_status,
           array_to_string(chain, ' ') AS chain FROM c""")
def s4_fetch_outcomes(spark, d):
    pages, k = read(spark, d, "pages", "page_id", "url", "html"), F.col("page_id")
    near = lambda n, name: pages.select((k + n).alias("page_id"), F.col("url").alias(name))
    j = pages.select("page_id", "url", F.length("html").alias("size")).join(near(-1, "following"), "page_id", "left").join(near(1, "before"), "page_id", "left")
    codes = F.array(*[F.lit(c) for c in (301, 200, 404, 302, 200, 503, 307, 429, 200)])
    rows = j.select("page_id", "url", F.get(codes, (k % 9).cast("int")).alias("status"), F.when(k % 9 == 4, "text/plain").otherwise("text/HTML; charset=utf-8").alias("content_type"),
                    F.when(k % 9 == 0, F.col("following")).when(k % 9 == 3, F.col("before")).when(k % 9 == 6, "/loop").alias("location"), F.when(k % 9 == 8, 9_000_000).otherwise(F.col("size")).alias("bytes"))
    first = rows.groupBy("url").agg(F.min(F.struct("page_id", "status", "content_type", "location", "bytes")).alias("r")).select("url", "r.*")
    asked = pages.select(k.alias("id"), "url").unionByName(pages.where(k % 10 == 0).select((-k - 1).alias("id"), F.concat(F.lit("http://10.0.0."), k % 250, F.lit("/")).alias("url")))
    return x.fetch_outcomes(asked, first, staged, max_redirects=2, max_bytes=5_000_000).withColumn("chain", F.array_join("chain", " "))
