"""Composite plans of the engine: page signals, chunks, retrieval, packs, frontier, planning; with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import markup, ports
from tessera.functions import scoring as s
from tessera.functions import text as t
from tessera.functions import web as w
from tessera.operators import chunker, retrieval, robots, udfs
from tessera.operators import relational as r
from tessera.plans import relational_queries as rq
from tessera.plans.scalar_queries import COLLAPSED, HOST_SQL, PATH_SQL, STRIP_SQL, TITLE_SQL, decode_sql
from tessera.sources import sinks
from tessera.sources.tables import attempts, facts, frontier_entries, read, stream, ts
from tessera.streaming import leases, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TERMS = ["the", "tion", "ing"]
K = 20


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


KEYWORD_SQL = "(" + " + ".join(f"contains(lower(text), '{x}')::INT" for x in TERMS) + ") / 3.0::DOUBLE"
COSINE_SQL = "list_inner_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.v, q.v)))"
Q_SQL = "(SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) q"
VECTOR_SQL = f"SELECT d.doc_id, d.source, d.text, {COSINE_SQL} AS vector, 0.0::DOUBLE AS keyword, 0 AS mode FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, {Q_SQL} ORDER BY round(vector, 9) DESC, doc_id LIMIT {3 * K}"
WORDS_SQL = f"SELECT doc_id, source, text, 0.0::DOUBLE AS vector, {KEYWORD_SQL} AS keyword, 1 AS mode FROM documents WHERE {KEYWORD_SQL} > 0 ORDER BY keyword DESC, doc_id LIMIT {3 * K}"


def query_vector(spark, d) -> list[float]:
    return [float(x) for x in read(spark, d, "embeddings", "vec_id", "embedding").where("vec_id = 0").first()["embedding"]]


@query(f"SELECT doc_id, round(keyword, 6) AS keyword FROM ({WORDS_SQL})")
def o3_keyword_search_topk(spark, d):
    docs = read(spark, d, "documents", "doc_id", "source", "text")
    return retrieval.keyword_branch(docs, TERMS, 3 * K).select("doc_id", F.round("keyword", 6).alias("keyword"))


@query(f"SELECT doc_id, round(vector, 6) AS vector FROM ({VECTOR_SQL})")
def o4_vector_knn(spark, d):
    docs = read(spark, d, "documents", "doc_id", "source", "text")
    return retrieval.vector_branch(docs, read(spark, d, "embeddings", "vec_id", "embedding"), query_vector(spark, d), 3 * K).select("doc_id", F.round("vector", 6).alias("vector"))


@query(f"SELECT vec_id, round({COSINE_SQL}, 6) AS x FROM embeddings e, {Q_SQL}")
def f40_cosine(spark, d):
    q = F.array(*[F.lit(x) for x in query_vector(spark, d)])
    return read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.round(s.cosine(F.col("embedding"), q), 6).alias("x"))


HYBRID_SQL = f"""
    WITH b AS (SELECT *, sha256(lower({COLLAPSED.format('text')})) AS h, (mode, CASE mode WHEN 0 THEN -round(vector, 9) ELSE -keyword END, doc_id) AS seq FROM (({VECTOR_SQL}) UNION ALL ({WORDS_SQL}))),
    m AS (SELECT h, arg_min(doc_id, (-(vector + keyword), seq)) AS doc_id, arg_min(source, (-(vector + keyword), seq)) AS source, min(seq) AS seq, max(vector) AS vector, max(keyword) AS keyword FROM b GROUP BY h),
    v AS (SELECT *, 1.0::DOUBLE / row_number() OVER (PARTITION BY source ORDER BY seq) AS diversity FROM m)
    SELECT doc_id, source, round(vector, 6) AS vector, keyword, diversity, round(0.25 * vector + 0.2 * keyword + 0.15 * diversity, 6) AS score FROM v ORDER BY score DESC, seq LIMIT {K}"""


@query(HYBRID_SQL)
def d10_hybrid_retrieval(spark, d):
    return retrieval.hybrid(read(spark, d, "documents", "doc_id", "source", "text"), read(spark, d, "embeddings", "vec_id", "embedding"), TERMS, query_vector(spark, d), K)


@query(f"SELECT source, count(*) AS chunks, max(score) AS best, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM ({HYBRID_SQL}) GROUP BY 1")
def d11_context_pack(spark, d):
    return d10_hybrid_retrieval(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.max("score").alias("best"), F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("doc_ids"))


@query(f"SELECT h.doc_id, h.score, f.facts, f.confidence FROM ({HYBRID_SQL}) h LEFT JOIN (SELECT l_partkey, count(*) AS facts, round(avg(l_discount * 10), 6) AS confidence FROM lineitem GROUP BY 1) f ON f.l_partkey = h.doc_id")
def d12_knowledge_pack(spark, d):
    f = facts(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("facts"), F.round(F.avg("trust"), 6).alias("confidence"))
    h = d10_hybrid_retrieval(spark, d).select("doc_id", "score")
    return f.join(F.broadcast(h), F.col("subject") == F.col("doc_id"), "right").select("doc_id", "score", "facts", "confidence")  # h has K rows


@query(f"SELECT page_id, {TITLE_SQL} AS title, {HOST_SQL} AS host, nullif(regexp_extract(html, '(?is)<html[^>]*\\slang=\"([^\"]*)\"', 1), '') AS lang, len(string_split({STRIP_SQL}, ' '))::INT AS words, len(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>'))::INT AS links, sha256(html) AS content_hash FROM pages")
def d1_page_signals(spark, d):
    html = F.col("html")
    return read(spark, d, "pages", "page_id", "url", "html").select(
        "page_id", w.page_title(html).alias("title"), w.host_of(F.col("url")).alias("host"), w.html_lang(html).alias("lang"), t.token_count(w.plain_text(html)).alias("words"),
        F.size(w.anchors(html)).alias("links"), F.sha2(html, 256).alias("content_hash"))


@query("SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1)::INT - 1 AS position FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>', 1) AS l FROM pages)")
def f24_outgoing_links(spark, d):
    return read(spark, d, "pages", "page_id", "html").select("page_id", F.posexplode(w.anchors(F.col("html"))).alias("position", "a")).select("page_id", F.col("a.href").alias("href"), "position")


def _clean_sql(x: str) -> str:
    return f"trim(regexp_replace({decode_sql(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')", w.ENTITIES_EXTRACT)}, '\\s+', ' ', 'g'))"


MARKED_SQL = "(SELECT page_id, url, html || '<h2 id=x>Page &quot;' || page_id || '&quot;</h2><H3><b>' || url || '</b></h3>' AS html FROM pages)"


@query(" UNION ALL ".join(f"SELECT page_id, {k} AS level, {_clean_sql('raw')} AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<h{k}\\b[^>]*>([\\s\\S]*?)</h{k}>', 1)) AS raw FROM {MARKED_SQL})" for k in range(1, 7)))
def f25_headings(spark, d):
    """All levels; two headings are added to each page, since the test pages have one."""
    more = F.concat("html", F.lit("<h2 id=x>Page &quot;"), "page_id", F.lit("&quot;</h2><H3><b>"), "url", F.lit("</b></h3>"))
    return read(spark, d, "pages", "page_id", "url", "html").select("page_id", F.explode(markup.headings(more)).alias("h")).select("page_id", "h.level", "h.text")


@query("SELECT doc_id, lower(nfc_normalize(text)) AS x FROM documents")  # no text of the test tables holds a character that only NFKC changes
def f15_nfkc(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", udfs.nfkc_lower(F.col("text")).alias("x"))


@query("SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') || href AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>', 1)) AS href FROM pages)")  # all links of the test pages are absolute paths
def f21_resolve_links(spark, d):
    p = read(spark, d, "pages", "page_id", "url", "html").select("page_id", "url", F.explode(w.anchors(F.col("html"))).alias("a"))
    return p.select("page_id", udfs.resolve_url("url", F.col("a.href")).alias("link"))


# The test pages carry no embedded metadata: each query adds some, made of the page's own id and url.


@query("SELECT page_id, unnest(['og:url', 'OG:title', 'twitter:card', 'fr-CA', 'etag']) AS key, unnest([url, 'second', page_id || ' & more', '/fr/' || page_id, 'W/' || page_id]) AS value FROM pages")
def f26_meta_maps(spark, d):
    head = F.concat("html", F.lit('<meta property="og:url" content="'), "url", F.lit('"><meta property="OG:title" content="first"><meta content="second" property="OG:title"><meta name="og:x" content="no"><meta name="twitter:card" content="'),
                    "page_id", F.lit(' &amp; more"><meta property="og:none" content=""><link rel="Alternate" hreflang="fr-CA" href="/fr/'), "page_id", F.lit('"><link rel="next" hreflang="de" href="/de">'))
    headers = F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), "page_id"), F.lit("Server"), F.lit("x"), F.lit("Expires"), F.lit(""))
    maps = F.map_concat(markup.meta_map(head, "property", "og:"), markup.meta_map(head, "name", "twitter:"), markup.hreflang_map(head), markup.cache_headers(headers))
    return read(spark, d, "pages", "page_id", "url", "html").select("page_id", F.explode(maps).alias("key", "value"))


@query("SELECT page_id, 1 AS position, 'WebPage' AS type, page_id * 2.5::DOUBLE AS size, url FROM pages UNION ALL SELECT page_id, 2, NULL, NULL, url FROM pages")
def f27_json_ld(spark, d):
    """Typed values of the blocks that parse; the first of three does not."""
    block = lambda *parts: F.concat(F.lit("<script type='application/ld+json'>"), *parts, F.lit("</script>"))
    html = F.concat("html", block(F.lit("{bad")), block(F.lit(' {"@type": "WebPage", "size": '), (F.col("page_id") * 2.5).cast("string"), F.lit(', "about": [{"url": &quot;'), "url", F.lit('&quot;}]} ')),
                    block(F.lit('{"about":[{"url":"'), "url", F.lit('"}]}')))
    rows = read(spark, d, "pages", "page_id", "url", "html").select("page_id", F.explode(markup.json_ld(html)).alias("x"))
    get = lambda path, kind: F.try_variant_get("x.data", path, kind)
    return rows.select("page_id", "x.position", get("$['@type']", "string").alias("type"), get("$.size", "double").alias("size"), get("$.about[0].url", "string").alias("url"))


@query("SELECT page_id, unnest([0, 0, 1]) AS position, unnest(['https://schema.org/Article', 'https://schema.org/Article', NULL]) AS item_type, unnest(['name', 'url', 'name']) AS property, unnest(['N ' || page_id, url, 'own']) AS value FROM pages")
def f28_microdata(spark, d):
    html = F.concat("html", F.lit('<div itemscope itemtype="https://schema.org/Article"><b itemprop="name">N\n <i>'), "page_id", F.lit('</i></b><a itemprop="url">text</a><meta itemprop="url" content="'), "url",
                    F.lit('"></div><section itemscope><p itemprop="name">first</p><p itemprop="name">own</p></section>'))
    items = read(spark, d, "pages", "page_id", "url", "html").select("page_id", F.explode(markup.microdata(html)).alias("i"))
    return items.select("page_id", "i.position", "i.item_type", F.explode("i.properties").alias("property", "value"))


@query("SELECT page_id, 'Home > ' || url || ' > last > again' AS x FROM pages")
def f33_breadcrumbs(spark, d):
    block = F.concat(F.lit('{"@graph":[{"x":1},{"@type":["Thing","BreadcrumbList"],"itemListElement":["Home",{"position":9,"item":{"name":"'), "url",
                     F.lit('"}},{"name":""},{"name":7},{"name":"last","item":{"name":"no"}}]}],"z":{"@type":"BreadcrumbList","itemListElement":[{"name":"again"}],"deep":{"@type":"BreadcrumbList","itemListElement":["never"]}}}'))
    html = F.concat("html", F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))
    blocks = read(spark, d, "pages", "page_id", "url", "html").select("page_id", F.explode(markup.json_ld(html)).alias("b")).select("page_id", "b.position", F.col("b.data").alias("data"))
    return markup.breadcrumbs(blocks, ["page_id", "position"], "data", sinks.staged).select("page_id", F.array_join("names", " > ").alias("x"))


@query("SELECT doc_id, floor((0.35 * nc + 0.25 * k + 0.03 * ct) * 1e4 + 0.5) / 1e4 AS x FROM (SELECT doc_id, n_chars / 100000.0::DOUBLE AS nc, " + KEYWORD_SQL + " AS k, (lang = 'en')::INT AS ct FROM documents)")
def f39_weighted_score(spark, d):
    z = F.lit(0.0)
    x = s.weighted("balanced", F.col("n_chars") / 100000.0, t.match_share(F.col("text"), TERMS), z, z, z, z, z, (F.col("lang") == "en").cast("int"), z)
    return read(spark, d, "documents", "doc_id", "n_chars", "text", "lang").select("doc_id", s.round4(x).alias("x"))


@query("SELECT event_id, canonical, sha256(canonical) AS fingerprint FROM (SELECT event_id, '{\"a\":[1,{\"y\":null,\"z\":\"' || event_type || '\"}],\"b\":' || json(props)::VARCHAR || '}' AS canonical FROM events)")
def f55_canonical_json(spark, d):
    """Keys sorted at every level, no white space; the object around the test column has them in another order."""
    raw = F.concat(F.lit('{ "b": '), "props", F.lit(', "a": [1, {"z": "'), "event_type", F.lit('", "y": null}] }'))
    canonical = F.try_parse_json(raw).cast("string")
    return read(spark, d, "events", "event_id", "event_type", "props").select("event_id", canonical.alias("canonical"), F.sha2(canonical, 256).alias("fingerprint"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN 'deferred' WHEN value = trunc(value) THEN 'value:number:' || value::BIGINT ELSE 'value:number:x' END AS x FROM events")
def f56_comparable_value(spark, d):
    whole = F.col("value") == F.floor("value")
    return read(spark, d, "events", "event_id", "value").select("event_id", F.when(F.col("value").isNull(), "deferred").when(whole, F.concat(F.lit("value:number:"), F.col("value").cast("long"))).otherwise("value:number:x").alias("x"))


@query("SELECT event_id, sha256('enrich' || chr(0) || event_type || chr(0) || user_id) AS x FROM events")
def f58_cache_key(spark, d):
    return read(spark, d, "events", "event_id", "event_type", "user_id").select("event_id", t.natural_id(F.lit("enrich"), F.col("event_type"), F.col("user_id")).alias("x"))


@query("SELECT user_id, min(event_id) AS event_id, event_type FROM events GROUP BY user_id, event_type")
def f59_unique_by_key(spark, d):
    return r.first_wins(read(spark, d, "events", "user_id", "event_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4)::INT AS batch FROM events")
def f60_fixed_batches(spark, d):
    return r.batches(read(spark, d, "events", "event_id", "user_id"), ["event_id"], 4, ["user_id"]).select("event_id", "batch")


@query("SELECT doc_id, i AS chunk_index, array_to_string(w[i * 280 + 1:i * 280 + 320], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 320) / 280.0))::INT + 1)) AS i FROM "
       f"(SELECT doc_id, list_filter(string_split({COLLAPSED.format('text')}, ' '), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)")
def d3_chunk_words(spark, d):
    docs = read(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(t.word_windows(F.col("text"), *s.CHUNK_PROFILES["default"])).alias("chunk_index", "text"))


@query()
def d3_semantic_chunks(spark, d):
    return chunker.chunk_documents(read(spark, d, "documents", "doc_id", "text"))


@query(rq.ORACLES["w6_version_chain"])
def d2_document_versions(spark, d):
    return rq.w6_version_chain(spark, d)


@query("SELECT doc_id, CASE WHEN n < 60 THEN 'skipped' WHEN doc_id % 7 = 3 THEN 'provider_unavailable' WHEN doc_id % 7 = 5 THEN 'failed' ELSE 'embedded' END AS status, CASE WHEN n < 60 OR doc_id % 7 IN (3, 5) THEN 0 ELSE 32 END AS dims "
       "FROM (SELECT doc_id, len(string_split(" + COLLAPSED.format("text") + ", ' ')) AS n FROM documents)")
def d4_embedding_batches(spark, d):
    docs = read(spark, d, "documents", "doc_id", "text").withColumn("ok", t.token_count(F.col("text")) >= 60)
    flaky = udfs.embedding_outcomes(32, refuses=lambda k: k % 7 == 3, breaks=lambda k: k % 7 == 5)  # stands for a remote provider
    got = docs.withColumn("e", F.when(F.col("ok"), flaky("doc_id", "text")))
    out = got.select("doc_id", F.coalesce("e.status", F.lit("skipped")).alias("status"), F.coalesce(F.size("e.vector"), F.lit(0)).alias("d")).select("doc_id", "status", F.greatest("d", F.lit(0)).alias("dims"))
    with sinks.arrow_batches(spark, 256):  # whole texts: what Python holds at once is a few hundred of them, whatever the table
        return sinks.staged(out)


@query(rq.ORACLES["j12_ngram_mentions"])
def d5_mentions(spark, d):
    return rq.j12_ngram_mentions(spark, d)


@query(rq.ORACLES["j18_predicate_resolution"])
def d6_predicates(spark, d):
    return rq.j18_predicate_resolution(spark, d)


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CASE WHEN value >= 20 THEN 'canonical' ELSE 'below_confidence' END ELSE 'unresolved' END AS outcome FROM events")
def d7_fact_outcomes(spark, d):
    e = read(spark, d, "events", "event_id", "event_type", "value")
    known = spark.createDataFrame([("click",), ("view",), ("purchase",)], "event_type string").withColumn("hit", F.lit(True))
    return e.join(F.broadcast(known), "event_type", "left").select("event_id", F.when(F.col("hit"), F.when(F.col("value") >= 20, "canonical").otherwise("below_confidence")).otherwise("unresolved").alias("outcome"))


@query(rq.ORACLES["a10_evidence_strength"])
def d8_trust_scores(spark, d):
    return rq.a10_evidence_strength(spark, d)


@query(f"SELECT subject, predicate, level, coalesce(severity, 'none') AS severity, CASE WHEN severity = 'high' THEN 'compare_values' WHEN severity IS NULL THEN 'state' WHEN level = 'weak' THEN 'avoid_claim' ELSE 'phrase_cautiously' END AS handling FROM ({rq.ORACLES['a7_consensus_groups']}) LEFT JOIN ({rq.ORACLES['a9_conflict_sets']}) USING (subject, predicate)")
def d9_consensus_and_conflict(spark, d):
    j = rq.consensus(spark, d)
    handling =F.when(F.col("severity") == "high", "compare_values").when(F.col("severity").isNull(), "state").when(F.col("level") == "weak", "avoid_claim").otherwise("phrase_cautiously")
    return j.select("subject", "predicate", "level", F.coalesce("severity", F.lit("none")).alias("severity"), handling.alias("handling"))


@query(f"SELECT doc_id, decision, CASE WHEN decision = 'rejected' THEN 0 ELSE (floor(score * 400 + 0.5) + 250 + 15)::INT END AS priority FROM ({rq.ORACLES['p9_relevance']})")
def d13_frontier_reevaluation(spark, d):
    p = s.frontier_priority(F.col("score"), F.lit(1), F.lit(0), F.lit(1.0))
    return rq.p9_relevance(spark, d).select("doc_id", "decision", F.when(F.col("decision") == "rejected", 0).otherwise(p).alias("priority"))


@query("SELECT attempt_id, next_status, CASE WHEN next_status = 'failed_retryable' THEN least(21600000.0, floor(300000.0 * pow(2.0, failures) + 0.5)) END AS delay_ms FROM (" + rq.ORACLES["w3_retry_streaks"] + ")")
def d14_completion(spark, d):
    delay = s.retry_delay_ms(F.col("failures"), F.lit("0"), jitter=0.0)
    return rq.w3_retry_streaks(spark, d).select("attempt_id", "next_status", F.when(F.col("next_status") == "failed_retryable", delay).cast("double").alias("delay_ms"))


@query(rq.ORACLES["p10_canonical_decision"])
def d15_canonical_consolidation(spark, d):
    return rq.p10_canonical_decision(spark, d)


@query("SELECT n_regionkey, n_name, sha256(n_regionkey || chr(0) || 'seed' || chr(0) || n_name) AS run_key FROM nation")
def d16_discovery_plan(spark, d):
    cfg = read(spark, d, "nation", "n_regionkey", "n_name").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("seeds"))
    return cfg.select("n_regionkey", F.explode("seeds").alias("n_name")).select("n_regionkey", "n_name", t.natural_id(F.col("n_regionkey"), F.lit("seed"), F.col("n_name")).alias("run_key"))


@query("SELECT keyword, observations, CASE WHEN observations >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM (" + rq.ORACLES["a17_keyword_candidates"] + ")")
def d17_demand_discovery(spark, d):
    return rq.a17_keyword_candidates(spark, d).select("keyword", "observations", F.when(F.col("observations") >= 3, "medium").otherwise("low").alias("confidence"))


@query(f"""
    SELECT 'heading' AS kind, text, diversity AS score, k FROM (SELECT *, row_number() OVER (ORDER BY diversity DESC, frequency DESC, text) AS k FROM ({rq.ORACLES['a12_heading_patterns']}) WHERE diversity >= 2) WHERE k <= 10
    UNION ALL SELECT 'faq', question, frequency, k FROM (SELECT *, row_number() OVER (ORDER BY frequency DESC, question) AS k FROM ({rq.ORACLES['a13_faq_patterns']})) WHERE k <= 10
    UNION ALL SELECT 'entity', p_type || '/' || name, frequency, k FROM (SELECT *, row_number() OVER (ORDER BY frequency DESC, p_type || '/' || name) AS k FROM ({rq.ORACLES['a14_entity_patterns']})) WHERE k <= 10
    UNION ALL SELECT 'depth', 'words', (list_sort(list(words))[(count(*) // 2) + 1])::BIGINT, 1 FROM ({ORACLES['d1_page_signals']})
    UNION ALL SELECT 'angle', CASE WHEN count(*) > 1 THEN 'mixed' ELSE min(angle) END, max(score), 1 FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS r FROM ({rq.ORACLES['a16_content_angle']})) WHERE r = 1""")
def d18_serp_pack(spark, d):
    """The ten first headings, questions and entities, the median depth of a page, and the leading angle (mixed on a tie)."""
    top = lambda kind, df: r.top_k(df, [F.desc("score"), F.desc("then"), "text"], 10, "k").select(F.lit(kind).alias("kind"), "text", "score", "k")
    headings = rq.a12_heading_patterns(spark, d).where("diversity >= 2").select("text", F.col("diversity").alias("score"), F.col("frequency").alias("then"))
    questions = rq.a13_faq_patterns(spark, d).select(F.col("question").alias("text"), F.col("frequency").alias("score"), F.lit(0).alias("then"))
    entities = rq.a14_entity_patterns(spark, d).select(F.concat_ws("/", "p_type", "name").alias("text"), F.col("frequency").alias("score"), F.lit(0).alias("then"))
    depth = d1_page_signals(spark, d).agg(r.upper_median("words").cast("long").alias("score")).select(F.lit("depth").alias("kind"), F.lit("words").alias("text"), "score", F.lit(1).alias("k"))
    best = rq.a16_content_angle(spark, d).groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("first")).orderBy(F.desc("score")).limit(1)  # a row per angle at most
    angle = best.select(F.lit("angle").alias("kind"), F.when(F.col("n") > 1, "mixed").otherwise(F.col("first")).alias("text"), "score", F.lit(1).alias("k"))
    return top("heading", headings).unionByName(top("faq", questions)).unionByName(top("entity", entities)).unionByName(depth).unionByName(angle)


@query("SELECT key, frequency, CASE WHEN frequency >= 3 THEN 'deep' WHEN frequency >= 2 THEN 'moderate' ELSE 'shallow' END AS depth FROM (" + rq.ORACLES["a18_intent_candidates"] + ")")
def d19_intent_pack(spark, d):
    return rq.a18_intent_candidates(spark, d).select("key", "frequency", s.intent_depth(F.col("frequency"), F.lit(1)).alias("depth"))


@query("SELECT a, count(*) AS related, CASE WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM (" + rq.ORACLES["j13_containment_join"] + ") GROUP BY 1")
def d20_topic_expansion(spark, d):
    g = rq.j13_containment_join(spark, d).groupBy("a").agg(F.count(F.lit(1)).alias("related"))
    return g.select("a", "related", s.signal_confidence(F.col("related"), F.lit(0), F.lit("low")).alias("confidence"))


# Rules of combination over the test tables: a name, and for each dimension its table, key and link.
N, S, C, R = ("nation", "n_name", "n_nationkey"), ("supplier", "s_name", "s_nationkey"), ("customer", "c_name", "c_nationkey"), ("region", "r_name", "r_regionkey")
RULES = {"nation_supplier": [N, S], "nation_customer": [N, C], "supplier_customer": [S, C], "nation_supplier_customer": [N, S, C], "region_nation": [R, ("nation", "n_name", "n_regionkey")]}
PER_RULE = 10


def _rule_sql(name: str, dims: list[tuple[str, str, str]]) -> str:
    keys = ", ".join(f"t{i}.{k} AS k{i}" for i, (_, k, _) in enumerate(dims)) + ", NULL AS k2" * (len(dims) == 2)
    joins = " ".join(f"JOIN {t} t{i} ON t0.{dims[0][2]} = t{i}.{link}" for i, (t, _, link) in enumerate(dims) if i)
    return f"SELECT * FROM (SELECT DISTINCT '{name}' AS rule, {keys} FROM {dims[0][0]} t0 {joins} ORDER BY k0, k1, k2 LIMIT {PER_RULE})"


@query(" UNION ALL ".join(_rule_sql(n, dims) for n, dims in RULES.items()))
def d21_longtail_combinations(spark, d):
    out = None
    for name, dims in RULES.items():
        tables = {f"k{i}": rq.dimension(spark, d, *dim) for i, dim in enumerate(dims)}
        rows = r.combinations(tables, "key", "ids", PER_RULE).select(F.lit(name).alias("rule"), "k0", "k1", F.col("k2") if len(dims) == 3 else F.lit(None).cast("string").alias("k2"))
        out = rows if out is None else out.unionByName(rows)
    return out


# Signals of a candidate from an order's lines: the kind by line number and part, the raw value is the quantity, none up to 5.
KIND_SQL = "(l_linenumber - 1 + 7 * (l_partkey % 2)) % 13"
WEIGHTS_SQL = ", ".join(f"('{p}', {i}, '{n}', {s.signal_weights(p)[n]}::DOUBLE)" for p in s.SCORING_PROFILES for i, n in enumerate(s.SCORING_SIGNALS))
HINT_SQL = " || ".join([
    "CASE WHEN NOT list_contains(kinds, 'serp_weakness') THEN 'missing_serp_pack,' ELSE '' END",
    "CASE WHEN NOT list_contains(kinds, 'content_gap') AND NOT list_contains(kinds, 'faq_gap') THEN 'missing_serp_intent_pack,' ELSE '' END",
    "CASE WHEN NOT list_contains(kinds, 'knowledge_strength') THEN 'missing_knowledge_pack,' ELSE '' END",
    "CASE WHEN no_metric THEN 'missing_provider_metrics,' ELSE '' END", "CASE WHEN sources <= 1 THEN 'weak_source_diversity,' ELSE '' END",
    "CASE WHEN weak_serp THEN 'verify_shallow_competitor_coverage,' ELSE '' END"])


@query(f"""
    WITH c AS (SELECT l_orderkey, profile, name, pos, l_linenumber, l_suppkey, l_quantity > 5 AS known, CASE WHEN l_quantity > 5 THEN l_quantity * 2 ELSE -8 END AS v, w,
                      CASE WHEN l_returnflag = 'A' THEN 3 WHEN l_returnflag = 'N' THEN 2 ELSE 1 END AS conf
               FROM lineitem JOIN (VALUES {WEIGHTS_SQL}) s(profile, pos, name, w) ON pos = {KIND_SQL}),
    g AS (SELECT l_orderkey, profile, floor(round(sum(v * w) / sum(abs(w)), 9) + 0.5) AS raw, bool_or(NOT known) AS degraded, avg(conf) AS conf, list(DISTINCT name) AS kinds, count(DISTINCT l_suppkey) AS sources,
                 bool_or(name = 'unknown_metric_penalty' OR name = 'provider_metric' AND NOT known) AS no_metric, bool_or(name = 'serp_weakness' AND known AND v < 35) AS weak_serp,
                 coalesce(max(v) FILTER (WHERE name = 'faq_gap'), -1) AS faq FROM c GROUP BY 1, 2),
    t AS (SELECT l_orderkey, profile, string_agg(name, ',' ORDER BY k) AS rationale FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, profile ORDER BY v * w DESC, pos, l_linenumber) AS k FROM c WHERE v * w > 0)
          WHERE k <= 5 GROUP BY 1, 2),
    b AS (SELECT *, greatest(0, least(100, raw))::INT AS score, CASE WHEN conf >= 2.5 THEN 'high' WHEN conf >= 1.5 THEN 'medium' ELSE 'low' END AS band0 FROM g)
    SELECT l_orderkey, profile, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS band, degraded,
           CASE WHEN degraded AND band0 = 'high' THEN 'medium' WHEN degraded THEN 'low' ELSE band0 END AS confidence, coalesce(rationale, '') AS rationale, {HINT_SQL} AS hints,
           CASE WHEN faq >= 60 THEN 'faq_page' ELSE 'supporting_page' END AS page_type
    FROM b LEFT JOIN t USING (l_orderkey, profile)""")
def d22_candidate_scoring(spark, d):
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    kind = ((F.col("l_linenumber") - 1 + 7 * (F.col("l_partkey") % 2)) % len(s.SCORING_SIGNALS)).cast("int")
    confidence = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    known = F.col("l_quantity") > 5
    signals = li.select(F.col("l_orderkey").alias("candidate"), kind.alias("pos"), known.alias("known"), F.when(known, F.col("l_quantity") * 2).otherwise(-8.0).alias("value"),
                        confidence.alias("confidence"), F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("seq"))
    return r.score_candidates(signals).withColumnRenamed("candidate", "l_orderkey")


@query("SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS slot, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part QUALIFY slot <= 12")
def d23_seo_pack_outline(spark, d):
    p = read(spark, d, "part", "p_brand", "p_partkey", "p_name").withColumn("slot", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("slot <= 12")
    return p.select("p_brand", "slot", t.slug(F.col("p_name")).alias("slug"))


@query("SELECT conv_id, array_to_string(list(role || ': ' || turn ORDER BY turn), chr(10)) AS prompt, bool_or(contains(text, '?')) AS needs_research FROM conversations GROUP BY 1")
def d24_generation_context(spark, d):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], F.lit(": "), x["turn"].cast("string")))
    return read(spark, d, "conversations", "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.array_join(lines, "\n").alias("prompt"), F.bool_or(F.col("text").contains("?")).alias("needs_research"))


@query(f"SELECT c_custkey, budget, CASE WHEN budget > 80 THEN 'critical' WHEN budget > 40 THEN 'warning' END AS alert FROM ({rq.ORACLES['w7_budget_shares']})")
def d25_research_planning(spark, d):
    return rq.w7_budget_shares(spark, d).select("c_custkey", "budget", s.alert_severity(F.col("budget"), F.lit(40)).alias("alert"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'approved' WHEN value < 10 THEN 'rejected' ELSE 'pending_review' END AS status FROM events")
def d26_enrichment_review(spark, d):
    e = read(spark, d, "events", "event_id", "value")
    approved = e.where("event_id % 3 = 0").select(F.col("event_id").alias("a"))
    return e.join(approved, F.col("a") == F.col("event_id"), "left").select("event_id", F.when(F.col("a").isNotNull(), "approved").when(F.col("value") < 10, "rejected").otherwise("pending_review").alias("status"))


@query("SELECT 'frontier' AS area, crawl_status AS status, count(*) AS n FROM " + rq.FRONTIER + " GROUP BY ALL UNION ALL SELECT 'attempts', status, count(*) FROM " + rq.ATTEMPTS + " GROUP BY ALL UNION ALL SELECT 'documents', lang, count(*) FROM documents GROUP BY ALL")
def d27_operator_status(spark, d):
    n = F.count(F.lit(1)).alias("n")
    a = frontier_entries(spark, d).groupBy(F.lit("frontier").alias("area"), F.col("crawl_status").alias("status")).agg(n)
    b = attempts(spark, d).groupBy(F.lit("attempts").alias("area"), "status").agg(n)
    return a.unionByName(b).unionByName(read(spark, d, "documents", "lang").groupBy(F.lit("documents").alias("area"), F.col("lang").alias("status")).agg(n))


@query(f"SELECT doc_id, max(vector) AS vector, max(keyword) AS keyword, count(*) AS modes FROM (SELECT doc_id, round(vector, 6) AS vector, keyword FROM ({VECTOR_SQL}) UNION ALL SELECT doc_id, vector, keyword FROM ({WORDS_SQL})) GROUP BY 1")
def u1_union_of_modes(spark, d):
    docs = read(spark, d, "documents", "doc_id", "source", "text")
    v = retrieval.vector_branch(docs, read(spark, d, "embeddings", "vec_id", "embedding"), query_vector(spark, d), 3 * K).select("doc_id", F.round("vector", 6).alias("vector"), F.lit(0.0).alias("keyword"))
    k = retrieval.keyword_branch(docs, TERMS, 3 * K).select("doc_id", F.lit(0.0).alias("vector"), "keyword")
    return v.unionByName(k).groupBy("doc_id").agg(F.max("vector").alias("vector"), F.max("keyword").alias("keyword"), F.count(F.lit(1)).alias("modes"))


@query(f"SELECT doc_id, score FROM ({HYBRID_SQL}) ORDER BY score DESC, doc_id LIMIT 5")
def o2_hybrid_topk(spark, d):
    return d10_hybrid_retrieval(spark, d).orderBy(F.desc("score"), "doc_id").limit(5).select("doc_id", "score")


@query("""
    WITH RECURSIVE s AS (SELECT user_id, min(ts) AS a FROM events GROUP BY 1
                         UNION ALL SELECT s.user_id, min(e.ts) FROM s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.a + INTERVAL 1 DAY GROUP BY s.user_id, s.a),
    w AS (SELECT e.user_id, event_id, row_number() OVER (PARTITION BY e.user_id, a ORDER BY ts, event_id) AS nth FROM events e ASOF JOIN s ON e.user_id = s.user_id AND e.ts >= s.a)
    SELECT user_id, event_id, nth <= 3 AS allowed, greatest(3 - nth, 0)::INT AS remaining FROM w""")
def st7_rate_limit(spark, d):
    e = read(spark, d, "events", "event_id", "user_id", "ts").withColumn("ts", ts("ts"))
    return state.rate_limit(e, "user_id", "ts", "event_id", limit=3, window_seconds=86400.0)


def machine_sql(wanted: list[str], start: str, transitions: dict[str, set[str]]) -> str:
    """One command of each key a step, from the state that the one before left."""
    may = ", ".join(f"('{a}', '{b}')" for a, to in transitions.items() for b in sorted(to))
    return f"""
    WITH RECURSIVE c AS (SELECT user_id, event_id, {wanted}[event_id % {len(wanted)} + 1] AS wish, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    t(was, wish) AS (VALUES {may}),
    r AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS k, '{start}' AS state, '' AS outcome FROM c
          UNION ALL SELECT c.user_id, c.event_id, c.k, CASE WHEN t.was IS NULL THEN r.state ELSE c.wish END, CASE WHEN t.was IS NULL THEN 'rejected' ELSE 'applied' END
          FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1 LEFT JOIN t ON t.was = r.state AND t.wish = c.wish)
    SELECT user_id, event_id, outcome, state FROM r WHERE k > 0"""


RUN_WISHES = ["leased", "running", "checkpointed", "succeeded", "failed", "queued", "cancelled", "partial"]
TOPIC_WISHES = ["active", "paused", "active", "archived"]


@query(machine_sql(RUN_WISHES, "queued", state.RUN_TRANSITIONS))
def st5_run_machine(spark, d):
    to = F.element_at(F.array(*[F.lit(x) for x in RUN_WISHES]), (F.col("event_id") % 8 + 1).cast("int"))
    return state.run_machine(read(spark, d, "events", "event_id", "user_id").withColumn("to", to), "user_id", "event_id", "to")


@query(f"SELECT attempt_id, CASE WHEN attempt_id % 2 = 0 THEN 'late' ELSE 'on_time' END AS outcome FROM {rq.ATTEMPTS}")
def st3_late_completions(spark, d):
    a = attempts(spark, d).select("attempt_id", F.col("attempt_id").alias("entry_id"), F.col("recorded_at").alias("completed_at"))
    lease = F.when(F.col("attempt_id") % 2 == 0, F.col("completed_at") - F.expr("interval 1 second")).otherwise(F.col("completed_at"))
    frontier = a.select("entry_id", F.col("attempt_id").alias("active_attempt_id"), lease.alias("lease_expires_at"))
    good, late = state.late_completions(frontier, a)
    return good.select("attempt_id", F.lit("on_time").alias("outcome")).unionByName(late.select("attempt_id", F.lit("late").alias("outcome")))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 140 DAY > TIMESTAMP '2024-06-01'")
def st8_ttl_cache(spark, d):
    e = read(spark, d, "events", "event_id", "ts").withColumn("expires_at", ts("ts") + F.expr("interval 140 days"))
    return state.expired(e, "expires_at", datetime(2024, 6, 1)).select("event_id")


@query("SELECT * FROM (VALUES ('price', 'has_price'), ('cost', 'has_price'), ('available in', 'available_in_location'), ('applies to', 'available_in_location'), ('requires', 'has_requirement'), "
       "('eligible for', 'has_requirement'), ('contraindication', 'has_contraindication'), ('compatible with', 'compatible_with'), ('mentions', 'mentions')) v(alias, key)")
def s12_seed_registry(spark, d):
    return ports.seed_registry(spark).select("alias", "key")


# Bodies of robots.txt by the length of the origin; the last one answers 404. What they say to the agent below is written out for the SQL.
ROBOTS = ["User-agent: *\nDisallow: /de/\nCrawl-delay: 2\n\n# own group\r\nUser-Agent: TesseraBot\nUser-agent: other\nDisallow: /fr/ # no French\nAllow: /fr/2\nno colon\nCrawl-delay: 5\nCrawl-delay: x",
          "User-agent: *\nDisallow: /\nAllow: /en/\nAllow: /e\nDisallow: /es/1\nUser-agent: *\nDisallow: /en/1\nCrawl-delay:", "Disallow: /lost\nUser-agent: nobody\nDisallow: /", "User-agent: *\nDisallow: /"]
ROBOTS_SQL = "(VALUES (0, 1, '/fr/', false, 5.0), (0, 2, '/fr/2', true, 5.0), (1, 1, '/', false, 0.0), (1, 2, '/en/', true, 0.0), (1, 3, '/e', true, 0.0), (1, 4, '/es/1', false, 0.0), (1, 5, '/en/1', false, 0.0))"


@query(f"""
    WITH p AS (SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]+') AS origin, {PATH_SQL} || regexp_extract(url, '^[^?#]*(\\?[^#]*)?', 1) AS path, page_id % 40 AS hour FROM pages),
    k AS (SELECT *, length(origin) % 4 AS body, hour >= 24 AND NOT (length(origin) % 4 = 1 AND hour >= 30) AS gone, length(origin) % 4 = 1 AND hour >= 30 AS again FROM p),
    r AS (SELECT page_id, arg_max(allow, (length(rule), -seq)) AS allow, arg_max(rule, (length(rule), -seq)) AS rule FROM k JOIN {ROBOTS_SQL} v(b, seq, rule, allow, delay) ON b = body AND starts_with(path, rule) GROUP BY 1)
    SELECT k.page_id AS id, CASE WHEN gone THEN false WHEN again OR body > 1 THEN true ELSE coalesce(allow, true) END AS allowed,
           CASE WHEN gone THEN 'robots unavailable' WHEN again THEN 'no matching robots path rule' WHEN body > 1 THEN 'no matching robots group' WHEN rule IS NULL THEN 'no matching robots path rule'
                ELSE CASE WHEN allow THEN 'allow: ' ELSE 'disallow: ' END || rule END AS evidence,
           CASE WHEN gone OR again OR body > 1 THEN NULL WHEN body = 0 THEN 5.0 ELSE 0.0 END::DOUBLE AS delay
    FROM k LEFT JOIN r ON r.page_id = k.page_id""")
def p12_robots_decisions(spark, d):
    """Every page at some hour: bodies were fetched at midnight and live a day; every second origin's was fetched again at six the next day."""
    hour = lambda n: F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), n)
    pages = read(spark, d, "pages", "page_id", "url").select(F.col("page_id").alias("id"), "url", hour((F.col("page_id") % 40).cast("int")).alias("at"))
    kind = F.length("origin") % 4
    first = pages.select(w.origin_of(F.col("url")).alias("origin")).where("origin is not null").distinct().select(
        "origin", hour(F.lit(0)).alias("fetched_at"), F.when(kind == 3, 404).otherwise(200).alias("status"), F.get(F.array(*[F.lit(b) for b in ROBOTS]), kind.cast("int")).alias("body"))
    again = first.where(kind == 1).select("origin", hour(F.lit(30)).alias("fetched_at"), "status", F.lit("User-agent: *\nDisallow:").alias("body"))
    return robots.decide(pages, first.unionByName(again), "TesseraBot/1.0", ttl_seconds=86400, fail_closed=True)


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 1")
def s13_append_sink(spark, d):
    path, docs = sinks.shared_folder(spark), read(spark, d, "documents", "doc_id", "lang")
    for k in range(2):
        sinks.append(docs.where(F.col("doc_id") % 2 == k), path)
    return spark.read.parquet(path)


@query("SELECT doc_id, lang, CASE WHEN lang IN ('de', 'fr') THEN 'new' ELSE 'old' END AS origin FROM documents")
def s16_replace_by_key(spark, d):
    path, docs = sinks.shared_folder(spark), read(spark, d, "documents", "doc_id", "lang")
    sinks.replace_by_key(docs.withColumn("origin", F.lit("old")), path, "lang")
    sinks.replace_by_key(docs.where(F.col("lang").isin("de", "fr")).withColumn("origin", F.lit("new")), path, "lang")
    return spark.read.parquet(path).select("doc_id", "lang", "origin")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def s20_temp_view(spark, d):
    read(spark, d, "documents", "doc_id", "lang").createOrReplaceTempView("tessera_documents")
    return spark.sql("SELECT lang, count(*) AS n FROM tessera_documents GROUP BY lang")


@query(f"SELECT page_id, NOT ({HOST_SQL} IS NULL) AS safe FROM pages")
def p17_configured_url_safety(spark, d):
    return read(spark, d, "pages", "page_id", "url").select("page_id", (~w.is_unsafe_host(w.host_of(F.col("url")))).alias("safe"))


QUEUES = {"click": "crawled", "view": "processed", "purchase": "embedded", "signup": "extracted"}


@query("SELECT event_id, event_type, CASE event_type " + " ".join(f"WHEN '{q}' THEN '{x}'" for q, x in QUEUES.items()) + " ELSE 'no_consumer' END AS outcome FROM events")
def st1_queue_consumers(spark, d):
    """Four queues in one inbox, delivered twice; each job is handled once."""
    folder, jobs = sinks.shared_folder(spark), read(spark, d, "events", "event_id", "event_type", "ts").withColumn("ts", ts("ts"))
    service = lambda new: new.select("event_id", "event_type", F.coalesce(s.lookup(QUEUES, F.col("event_type")), F.lit("no_consumer")).alias("outcome"))
    for _ in range(2):
        sinks.append(jobs, f"{folder}/inbox")
        leases.drain(leases.once(stream(spark, f"{folder}/inbox"), ["event_id"], "ts", "1 hour"), f"{folder}/checkpoint", leases.append_epoch(f"{folder}/out", service))
    return spark.read.parquet(f"{folder}/out").drop("epoch")


@query("""SELECT event_id, 100 AS entries, 'x-props' AS first_name, 2000 AS first_length, 'h-99=' || event_type AS last, sha256(substr(repeat(coalesce(props, 'none') || '|', 1000), 1, 2000)) AS first_hash FROM events""")
def p25_header_bounds(spark, d):
    """121 headers, the first with a long value: names in lower case, values cut to 2,000 characters, the first 100 kept."""
    names = F.array(F.lit("X-Props"), *[F.lit(f"H-{i}") for i in range(1, 121)])
    first = F.repeat(F.concat(F.coalesce("props", F.lit("none")), F.lit("|")), F.lit(1000))
    headers = F.map_from_arrays(names, F.concat(F.array(first), F.array_repeat("event_type", 120)))
    bounded = read(spark, d, "events", "event_id", "event_type", "props").select("event_id", t.bounded_headers(headers).alias("h"))
    bounded, entry = bounded.select("event_id", F.map_entries("h").alias("e")), F.col("e")
    return bounded.select("event_id", F.size("e").alias("entries"), entry[0]["key"].alias("first_name"), F.length(entry[0]["value"]).alias("first_length"), F.concat_ws("=", entry[99]["key"], entry[99]["value"]).alias("last"), F.sha2(entry[0]["value"], 256).alias("first_hash"))


@query("SELECT entry_id FROM " + rq.FRONTIER + " WHERE crawl_status IN ('scheduled', 'succeeded') AND next_crawl_at <= TIMESTAMP '1997-01-01' ORDER BY next_crawl_at, priority DESC, entry_id LIMIT 40")
def st2_lease(spark, d):
    f = frontier_entries(spark, d).withColumn("lease_expires_at", F.lit(None).cast("timestamp")).withColumn("last_crawled_at", F.lit(None).cast("timestamp"))
    return state.lease(f, datetime(1997, 1, 1), 40).select("entry_id")


LEASE_HOURS = 6


@query(f"""
    WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, event_type IN ('view', 'signup') AS asks, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS t, NULL::BIGINT AS gone, NULL::BIGINT AS gone_at, '' AS outcome, NULL::BIGINT AS about, NULL::BIGINT AS holder, NULL::BIGINT AS until FROM c
          UNION ALL SELECT c.user_id, c.k, c.t, CASE WHEN until <= c.t THEN holder END, CASE WHEN until <= c.t THEN until END,
              CASE WHEN asks THEN CASE WHEN until > c.t THEN 'busy' ELSE 'leased' END ELSE CASE WHEN until > c.t THEN 'completed' ELSE 'late' END END,
              CASE WHEN NOT asks AND until > c.t THEN holder ELSE c.event_id END,
              CASE WHEN asks THEN CASE WHEN until > c.t THEN holder ELSE c.event_id END END, CASE WHEN asks THEN CASE WHEN until > c.t THEN until ELSE c.t + {LEASE_HOURS * 3600000} END END
          FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1)
    SELECT user_id, about AS id, outcome, t AS at_ms FROM r WHERE k > 0
    UNION ALL SELECT user_id, gone, 'expired', gone_at FROM r WHERE gone IS NOT NULL
    UNION ALL SELECT user_id, holder, 'expired', until FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1) WHERE until <= (SELECT max(t) FROM c) - 3600000""")
def st2_lease_timers(spark, d):
    """Requests and acks of entries as a stream: leases return to the pool by timer. Events stand for both (views and signups ask)."""
    folder, events = sinks.shared_folder(spark), stream(spark, f"{d}/events.parquet")
    kind = F.when(F.col("event_type").isin("view", "signup"), "request").otherwise("ack")
    calls = events.select("user_id", F.col("event_id").alias("id"), kind.alias("kind"), ts("ts").alias("at"))
    for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
        leases.drain(leases.lease_stream(calls, "user_id", lease_seconds=LEASE_HOURS * 3600, delay="1 hour"), f"{folder}/checkpoint", leases.append_epoch(f"{folder}/out"))
    return spark.read.parquet(f"{folder}/out").drop("epoch")


@query("SELECT event_id AS lease_id, CASE WHEN value IS NULL OR floor(value * 60) > 1800 THEN 'missing' WHEN floor(value * 60) <= 600 THEN 'on_time' ELSE 'late' END AS outcome FROM events")
def st3_completion_stream(spark, d):
    """A lease of ten minutes at each event and an ack after as many minutes as its value says; both are streams. The last rows are
    heartbeats, which carry the watermarks past all leases."""
    folder, e = sinks.shared_folder(spark), read(spark, d, "events", "event_id", "ts", "value").withColumn("ts", ts("ts"))
    beat = e.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("interval 2 days")).alias("ts"), F.lit(0.0).alias("value"))
    rows = e.unionByName(beat)
    acked = F.timestamp_seconds(F.unix_micros("ts") / 1e6 + F.floor(F.col("value") * 60))
    rows.select(F.col("event_id").alias("lease_id"), F.col("ts").alias("leased_at"), (F.col("ts") + F.expr("interval 10 minutes")).alias("expires_at")).write.parquet(f"{folder}/leases")
    rows.where("value is not null").select(F.col("event_id").alias("lease_id"), acked.alias("acked_at")).write.parquet(f"{folder}/acks")
    joined = leases.completion_stream(stream(spark, f"{folder}/leases"), stream(spark, f"{folder}/acks"), grace="30 minutes", delay="1 hour")
    leases.drain(joined, f"{folder}/checkpoint", leases.append_epoch(f"{folder}/out"))
    return spark.read.parquet(f"{folder}/out").where("lease_id >= 0").drop("epoch")


@query("SELECT event_id, event_type FROM events")
def st10_exactly_once(spark, d):
    """Work delivered twice, the first half of it three times, in runs that start again from the checkpoint; then the first epoch is replayed."""
    folder, e = sinks.shared_folder(spark), read(spark, d, "events", "event_id", "event_type", "ts").withColumn("ts", ts("ts"))
    handle = leases.append_epoch(f"{folder}/out")
    first = e.where("event_id % 2 = 0")
    for delivered in (first, e, e):
        sinks.append(delivered, f"{folder}/inbox")
        leases.drain(leases.once(stream(spark, f"{folder}/inbox"), ["event_id"], "ts", "60 days"), f"{folder}/checkpoint", handle)
    handle(first, 0)
    return spark.read.parquet(f"{folder}/out").select("event_id", "event_type")


@query(f"""
    WITH r AS (SELECT *, sum((status = 'succeeded')::INT) OVER (PARTITION BY entry_id ORDER BY recorded_at, attempt_id) AS run FROM {rq.ATTEMPTS}),
    f AS (SELECT *, CASE WHEN status = 'succeeded' THEN 0 ELSE sum((status = 'failed_retryable')::INT) OVER (PARTITION BY entry_id, run ORDER BY recorded_at, attempt_id) END::BIGINT AS failures FROM r),
    n AS (SELECT *, CASE WHEN status = 'succeeded' THEN 'succeeded' WHEN status <> 'failed_retryable' OR failures >= 5 THEN 'failed_terminal' ELSE 'failed_retryable' END AS next_status FROM f)
    SELECT attempt_id, entry_id, failures, next_status, CASE WHEN next_status = 'failed_retryable' THEN epoch_us(recorded_at) // 1000 + least(21600000.0, floor(300000.0 * pow(2.0, failures) + 0.5))::BIGINT END AS next_at_ms FROM n""")
def st4_retry_schedule(spark, d):
    return state.retry_schedule(attempts(spark, d), "entry_id", "recorded_at", "attempt_id", "status")


@query(rq.ORACLES["w3_retry_streaks"])
def st4_retry_to_terminal(spark, d):
    return rq.w3_retry_streaks(spark, d)


@query(machine_sql(TOPIC_WISHES, "draft", state.TOPIC_TRANSITIONS))
def st6_topic_lifecycle(spark, d):
    to = F.element_at(F.array(*[F.lit(x) for x in TOPIC_WISHES]), (F.col("event_id") % 4 + 1).cast("int"))
    return state.run_machine(read(spark, d, "events", "event_id", "user_id").withColumn("to", to), "user_id", "event_id", "to", "draft", state.TOPIC_TRANSITIONS)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st9_scheduler_tick(spark, d):
    control = spark.createDataFrame([("paused", 1), ("enabled", 2)], "state string, updated_at int")
    return state.tick(control, lambda: read(spark, d, "events", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def st10_already_done(spark, d):
    return read(spark, d, "documents", "doc_id").join(read(spark, d, "labels", "doc_id"), "doc_id", "left_anti")


@query("SELECT conv_id, turn, CASE WHEN " + COLLAPSED.format("text") + " = '' THEN 0 ELSE len(string_split(" + COLLAPSED.format("text") + ", ' ')) END::INT AS n FROM conversations")
def ud1_tokenizer_port(spark, d):
    return read(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", ports.count_tokens(F.col("text")).alias("n"))


@query()
def ud2_embedding_port(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", udfs.embedder(16)(F.col("text")).alias("embedding"))


@query("SELECT event_id, unnest(CASE WHEN event_type = 'view' THEN [] ELSE ['cost', 'requires'] END) AS predicate_text, unnest(CASE WHEN event_type = 'view' THEN [] ELSE [(event_id % 97)::VARCHAR || '.5', user_id::VARCHAR] END) AS value FROM events")
def ud3_fact_extraction_port(spark, d):
    """The default extractor over sentences made of events: amounts near words of price and need; views say nothing."""
    said = F.when(F.col("event_type") == "view", "A pretty price. Nothing costs.").otherwise(F.concat(F.lit("The cost of item no "), F.col("event_id") % 97, F.lit(".5 is fair.\nIt Requires about "), "user_id", F.lit(" days")))
    events = read(spark, d, "events", "event_id", "event_type", "user_id").withColumn("said", said)
    return events.lateralJoin(ports.fact_extractor()(F.col("said").outer())).select("event_id", "predicate_text", "value")


def broken():
    raise ValueError("down")


@query(f"SELECT page_id, CASE WHEN {HOST_SQL} LIKE '%.org' THEN 'browser' ELSE 'http' END AS provider_key, CASE WHEN html IS NULL OR html = '' THEN 'empty' ELSE 'fetched' END AS outcome, length(coalesce(html, ''))::INT AS size FROM pages")
def ud4_crawler_adapters(spark, d):
    """Each url goes to the adapter that takes its host; the recorded pages stand for the network."""
    pages = read(spark, d, "pages", "page_id", "url", "html").withColumn("org", F.coalesce(w.host_of(F.col("url")).endswith(".org"), F.lit(False)))
    html = F.coalesce("html", F.lit(""))
    fetch = lambda rows: rows.select("page_id", F.when(html == "", "empty").otherwise("fetched").alias("outcome"), F.length(html).alias("size"))
    return ports.collect_providers({"browser": lambda: fetch(pages.where("org")), "http": lambda: fetch(pages.where("not org"))})[0]


@query("SELECT 'seed' AS provider_key, n_name AS target, NULL::BIGINT AS page_id FROM nation UNION ALL SELECT 'link', unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>', 1)), page_id FROM pages")
def ud5_discovery_adapters(spark, d):
    links = lambda: read(spark, d, "pages", "page_id", "html").select("page_id", F.explode(w.anchors(F.col("html"))).alias("a")).select(F.col("a.href").alias("target"), "page_id")
    seeds = lambda: read(spark, d, "nation", "n_name").select(F.col("n_name").alias("target"), F.lit(None).cast("long").alias("page_id"))
    return ports.collect_providers({"seed": seeds, "broken": broken, "link": links})[0]


@query("SELECT p_name AS keyword, 'fallback' AS provider_key, NULL::BIGINT AS volume FROM part UNION ALL SELECT event_type, 'recorded', count(*) FROM events GROUP BY 1")
def ud6_demand_adapters(spark, d):
    """A provider with recorded volumes; the fallback knows keywords without metrics."""
    recorded = lambda: read(spark, d, "events", "event_type").groupBy(F.col("event_type").alias("keyword")).agg(F.count(F.lit(1)).alias("volume"))
    fallback = lambda: read(spark, d, "part", "p_name").select(F.col("p_name").alias("keyword"), F.lit(None).cast("long").alias("volume"))
    return ports.collect_providers({"recorded": recorded, "broken": broken, "fallback": fallback})[0]


@query("SELECT event_id, CASE WHEN coalesce(value, 0) < 10 THEN 'failed' ELSE 'executed' END AS status, CASE WHEN coalesce(value, 0) < 10 THEN 'below budget' ELSE event_type END AS detail FROM events")
def ud9_dispatch(spark, d):
    def execute(command):
        if not command["value"] >= 10:
            raise ValueError("below budget")
        return command["event_type"]

    return ports.dispatch(read(spark, d, "events", "event_id", "event_type", "value"), execute).select("event_id", "status", "detail")


@query("SELECT c_name AS name, 'crm' AS provider_key FROM customer UNION ALL SELECT s_name, 'erp' FROM supplier")
def ud7_provider_union(spark, d):
    found, _ = ports.collect_providers({
        "crm": lambda: read(spark, d, "customer", "c_name").select(F.col("c_name").alias("name")), "broken": broken,
        "erp": lambda: read(spark, d, "supplier", "s_name").select(F.col("s_name").alias("name"))})
    return found
