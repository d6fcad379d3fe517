"""Whole steps of the knowledge base over the test tables: page signals, versions, mentions with expansion, trust, registry use,
sources that fail open; with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import markup, ports
from tessera.functions import scoring as s
from tessera.functions import text as t
from tessera.functions import web as w
from tessera.operators import relational as r
from tessera.plans import relational_queries as rq
from tessera.plans.scalar_queries import HOST_SQL, STRIP_SQL, TITLE_SQL
from tessera.sources.tables import attempts, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


EXTRACTED_SQL = """(SELECT page_id, url, replace(html, '</head>', '<meta name="description" content="About ' || page_id || ' &amp;lt; more"><link rel="canonical" href="' || url || '"><link rel="alternate" hreflang="fr-CA" href="/fr"><meta property="og:title" content="T"><script type="application/ld+json">{"a":'
                   || page_id || '}</script></head>') AS html FROM pages)"""


@query(f"""SELECT page_id, {TITLE_SQL} AS title, 'About ' || page_id || ' < more' AS description, url AS canonical, {HOST_SQL} AS host, nullif(regexp_extract(html, '(?i)<html\\b[^>]*\\blang=["'']([^"'']+)["''][^>]*>', 1), '') AS language,
           len(regexp_extract_all(html, '(?i)<h[1-6]\\b'))::INT AS headings, len(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>'))::INT AS links, 1 AS open_graph, 'CA' AS geo, page_id AS structured, len(string_split({STRIP_SQL}, ' '))::INT AS words,
           length({STRIP_SQL})::INT AS characters, sha256(html) AS content_hash FROM {EXTRACTED_SQL}""")
def d1_content_signals(spark, d):
    """All signals of a page in one pass over its markup, without a shuffle; a head with metadata is added to the test pages."""
    head = F.concat(F.lit('<meta name="description" content="About '), "page_id", F.lit(' &amp;lt; more"><link rel="canonical" href="'), "url", F.lit('"><link rel="alternate" hreflang="fr-CA" href="/fr"><meta property="og:title" content="T"><script type="application/ld+json">{"a":'),
                    "page_id", F.lit("}</script></head>"))
    pages = read(spark, d, "pages", "page_id", "url", "html").withColumn("html", F.replace("html", F.lit("</head>"), head))
    html, plain = F.col("html"), w.plain_text(F.col("html"))
    tags = F.map_keys(markup.hreflang_map(html))
    return pages.select(
        "page_id", w.page_title(html).alias("title"), markup.decode(w.meta_content(html, "description")).alias("description"), w.canonical_link(html).alias("canonical"), w.host_of(F.col("url")).alias("host"),
        markup.language_hints(html)[0]["tag"].alias("language"), F.size(markup.headings(html)).alias("headings"), F.size(w.anchors(html)).alias("links"), F.size(markup.meta_map(html, "property", "og:")).alias("open_graph"),
        F.upper(F.get(F.split(tags[0], "-"), F.lit(1))).alias("geo"), F.try_variant_get(markup.json_ld(html)[0]["data"], "$.a", "bigint").alias("structured"), t.token_count(plain).alias("words"), F.length(plain).alias("characters"),
        F.sha2(html, 256).alias("content_hash"))


@query(f"""
    WITH a AS (SELECT *, first_value(attempt_id) OVER v AS owner, lag(content_hash) OVER e AS before FROM {rq.ATTEMPTS} WHERE status = 'succeeded' WINDOW v AS (PARTITION BY entry_id, content_hash ORDER BY recorded_at, attempt_id), e AS (PARTITION BY entry_id ORDER BY recorded_at, attempt_id)),
    n AS (SELECT *, count(*) FILTER (WHERE attempt_id = owner) OVER (PARTITION BY entry_id ORDER BY recorded_at, attempt_id) AS made FROM a),
    o AS (SELECT attempt_id, made AS version FROM n WHERE attempt_id = owner)
    SELECT n.attempt_id, entry_id, o.version, CASE WHEN n.attempt_id = owner THEN 'created' WHEN before = content_hash THEN 'unchanged' ELSE 'reused' END AS outcome FROM n JOIN o ON o.attempt_id = owner""")
def d2_version_outcomes(spark, d):
    """Document versions: a new content makes the next version, a known one is reused by its hash, the same as before changes nothing."""
    a, order = attempts(spark, d).where("status = 'succeeded'"), ["recorded_at", "attempt_id"]
    seen, entry = Window.partitionBy("entry_id", "content_hash").orderBy(*order), Window.partitionBy("entry_id").orderBy(*order)
    a = a.select("attempt_id", "entry_id", *order[:1], "content_hash", F.first("attempt_id").over(seen).alias("owner"), F.lag("content_hash").over(entry).alias("before"))
    a = a.withColumn("made", F.count_if(F.col("attempt_id") == F.col("owner")).over(entry.rowsBetween(Window.unboundedPreceding, 0)))
    outcome = F.when(F.col("attempt_id") == F.col("owner"), "created").when(F.col("before") == F.col("content_hash"), "unchanged").otherwise("reused")
    version = F.first("made").over(Window.partitionBy("entry_id", "content_hash").orderBy(*order))  # of the owner, the first of the content
    return a.select("attempt_id", "entry_id", version.alias("version"), outcome.alias("outcome"))


@query(f"""SELECT m.doc_id, m.entity, m.mentions, e.aliases, m.mentions * 10 + len(e.aliases) AS weight FROM ({rq.ORACLES['j12_ngram_mentions']}) m
           JOIN (SELECT entity, string_agg(alias, '|' ORDER BY alias) AS aliases FROM (VALUES {", ".join(f"('{a}', '{e}')" for a, e in [*rq.ALIASES, ('whole', 'e2'), ('the', 'e1')])}) v(alias, entity) GROUP BY 1) e ON e.entity = m.entity""")
def d5_mentions_expanded(spark, d):
    """What a text mentions, and the approved aliases by which a query for it would be expanded."""
    registry = spark.createDataFrame([*rq.ALIASES, ("whole", "e2"), ("the", "e1")], "alias string, entity string")
    known = registry.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("aliases"))
    found = rq.j12_ngram_mentions(spark, d).join(F.broadcast(known), "entity")  # a row for each entity of the registry above
    return found.select("doc_id", "entity", "mentions", "aliases", (F.col("mentions") * 10 + F.length("aliases")).alias("weight"))


KIND_OF = {0: "news", 1: "forum_community", 2: "affiliate", 3: "government", 4: "unknown"}
CL4 = rq.CL4


@query(f"""
    WITH l AS (SELECT *, CASE l_suppkey % 5 WHEN 0 THEN 0.65 WHEN 1 THEN 0.34 WHEN 2 THEN 0.26 WHEN 3 THEN 0.95 ELSE 0.45 END::DOUBLE AS trust FROM lineitem),
    e AS (SELECT l_partkey, {CL4.format("0.28::DOUBLE + least(0.24::DOUBLE, count(DISTINCT l_orderkey) * 0.06::DOUBLE) + least(0.24::DOUBLE, count(DISTINCT l_orderkey) * 0.08::DOUBLE) + least(0.24::DOUBLE, count(DISTINCT l_suppkey) * 0.08::DOUBLE) + (round(avg(trust), 9) - 0.5) * 0.28 - CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 0.18 ELSE 0.0 END::DOUBLE")} AS evidence FROM l GROUP BY 1),
    f AS (SELECT l.l_partkey, l_suppkey, l_orderkey, evidence, {CL4.format("round(l_discount * 10 * 0.3 + l_discount * 10 * 0.25 + evidence * 0.3 + trust * 0.15, 9)")} AS confidence, trust FROM l JOIN e ON e.l_partkey = l.l_partkey),
    g AS (SELECT l_partkey, any_value(evidence) AS evidence, round(avg(confidence), 9) AS c, count(*) AS n, count(DISTINCT l_orderkey) AS o, count(DISTINCT l_suppkey) AS s, round(avg(trust), 9) AS trust FROM f GROUP BY 1)
    SELECT l_partkey AS entity, evidence, round(c, 6) AS fact_confidence, {CL4.format(f"c * 0.35 + c * 0.2 + {CL4.format('least(1.0::DOUBLE, n * 0.05::DOUBLE)')} * 0.15 + {CL4.format('least(1.0::DOUBLE, o * 0.12::DOUBLE) + least(1.0::DOUBLE, s * 0.18::DOUBLE)')} * 0.15 + trust * 0.15")} AS entity_score FROM g""")
def d8_trust_chain(spark, d):
    """Source trust by kind, evidence strength by subject, confidence of each fact from both, and the score of the entity."""
    li = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_orderkey", "l_linestatus", "l_discount")
    kind = s.lookup(KIND_OF, (F.col("l_suppkey") % 5).cast("int"))
    by = Window.partitionBy("l_partkey")  # the one shuffle: all that follows is by entity
    nth = lambda c: F.when(F.col(c).isNotNull(), F.dense_rank().over(by.orderBy(F.asc_nulls_last(c))))  # noqa: E731  (the last one is the number of distinct values)
    f = li.where("l_partkey is not null").withColumn("trust", s.source_trust(kind, F.lit(False), F.lit(0))).withColumn("o", nth("l_orderkey")).withColumn("s", nth("l_suppkey"))
    f = f.select("l_partkey", "l_discount", "trust", F.coalesce(F.max("o").over(by), F.lit(0)).alias("o"), F.coalesce(F.max("s").over(by), F.lit(0)).alias("s"), F.count(F.lit(1)).over(by).alias("n"),
                 F.round(F.avg("trust").over(by), 9).alias("t"), F.coalesce(F.min("l_linestatus").over(by) < F.max("l_linestatus").over(by), F.lit(False)).alias("conflict"))
    f = f.withColumn("evidence", s.evidence_strength(F.col("o"), F.col("o"), F.col("s"), F.col("t"), F.col("conflict")))
    sure = F.round(F.col("l_discount") * 10 * 0.3 + F.col("l_discount") * 10 * 0.25 + F.col("evidence") * 0.3 + F.col("trust") * 0.15, 9)
    g = f.withColumn("confidence", s.clamp4(sure)).groupBy("l_partkey").agg(F.round(F.avg("confidence"), 9).alias("c"), *[F.first(x).alias(x) for x in ("evidence", "n", "o", "s", "t")])
    score = s.entity_score(F.col("c"), F.lit(None).cast("double"), F.col("n"), F.col("o"), F.col("s"), F.col("t"))
    return g.select(F.col("l_partkey").alias("entity"), "evidence", (F.floor(F.col("c") * 1e6 + 0.5) / 1e6).alias("fact_confidence"), score.alias("entity_score"))


@query("""SELECT v.alias, v.key, count(d.doc_id) AS documents FROM (VALUES ('price', 'has_price'), ('cost', 'has_price'), ('available in', 'available_in_location'), ('applies to', 'available_in_location'), ('requires', 'has_requirement'), ('eligible for', 'has_requirement'),
          ('contraindication', 'has_contraindication'), ('compatible with', 'compatible_with'), ('mentions', 'mentions'), ('the', 'none'), ('tion', 'none')) v(alias, key) LEFT JOIN documents d ON contains(lower(d.text), v.alias) GROUP BY 1, 2""")
def s12_registry_use(spark, d):
    """The seeded predicates, and in how many documents each alias occurs; two words of the corpus join them here."""
    registry = ports.seed_registry(spark).select("alias", "key").unionByName(spark.createDataFrame([("the", "none"), ("tion", "none")], "alias string, key string"))
    docs = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.lower("text").alias("a"))
    hits = r.contained(docs, registry, "a", "alias", ("doc_id",)).groupBy("alias").agg(F.count("doc_id").alias("documents"))
    return registry.join(hits, "alias", "left").select("alias", "key", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


def unavailable() -> DataFrame:
    raise ConnectionError("metadata index is down")


@query("SELECT 'keyword' AS provider_key, count(*) FILTER (WHERE contains(lower(text), 'the')) AS n FROM documents UNION ALL SELECT 'vector', count(*) FROM embeddings WHERE embedding IS NOT NULL UNION ALL SELECT 'metadata: ConnectionError', 0")
def u1_modes_fail_open(spark, d):
    """Retrieval modes as providers: one that fails is left out, with a warning, and the others still answer."""
    n = F.count(F.lit(1)).alias("n")
    found, warnings = ports.collect_providers({
        "keyword": lambda: read(spark, d, "documents", "text").where(F.lower("text").contains("the")).agg(n), "metadata": unavailable, "vector": lambda: read(spark, d, "embeddings", "embedding").where("embedding is not null").agg(n)})
    told = spark.createDataFrame([(x, 0) for x in warnings], "provider_key string, n long")
    return found.select("provider_key", "n").unionByName(told)


@query("SELECT event_id, 'k' AS name, (json_extract(props, '$.k'))::BIGINT AS value, event_type || ':' || (json_extract(props, '$.k'))::BIGINT AS external_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def s10_typed_entities(spark, d):
    """Entities of a JSON source with their typed values."""
    e = read(spark, d, "events", "event_id", "event_type", "props").select("event_id", "event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "value"))
    return e.where("value is not null").select("event_id", "name", "value", F.concat_ws(":", "event_type", "value").alias("external_id"))
