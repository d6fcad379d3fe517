"""Scans, sinks, joins, aggregates, windows, orders and set operations over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as s
from tessera.functions import text as t
from tessera.functions import web as w
from tessera.operators import relational as r
from tessera.sources.tables import attempts, facts, frontier_entries, read, ts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "1997-01-01 00:00:00"
HOST = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1)"
FRONTIER = ("(SELECT o_orderkey AS entry_id, o_custkey AS topic_id, CASE o_orderstatus WHEN 'O' THEN 'scheduled' WHEN 'F' THEN 'succeeded' ELSE 'leased' END AS crawl_status, "
            "o_totalprice AS priority, o_orderdate AS next_crawl_at FROM orders)")
ATTEMPTS = ("(SELECT event_id AS attempt_id, user_id AS entry_id, ts AS recorded_at, CASE event_type WHEN 'error' THEN 'failed_retryable' WHEN 'signup' THEN 'cancelled' ELSE 'succeeded' END AS status, "
            "sha256(props) AS content_hash FROM events)")
FACTS = "(SELECT l_partkey AS subject, l_returnflag AS predicate, l_linestatus AS value, l_suppkey AS domain, l_orderkey AS chunk, l_discount * 10 AS trust, l_tax * 10 AS evidence FROM lineitem)"
CL4 = "greatest(0.0, least(1.0, floor(({}) * 1e4 + 0.5) / 1e4))"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Scans, sources and sinks


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr'")
def s1_table_scan(spark, d):
    return read(spark, d, "documents", "doc_id", "lang", "source").where(F.col("lang") == "fr")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey = 42")
def s2_point_lookup(spark, d):
    return read(spark, d, "customer", "c_custkey", "c_mktsegment").where(F.col("c_custkey") == 42).limit(1)


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey % 7 = 0 AND p_partkey < 2100")
def s3_multi_key_lookup(spark, d):
    return r.in_list(read(spark, d, "part", "p_partkey", "p_brand"), "p_partkey", list(range(0, 2100, 7)))


@query("SELECT page_id, host, rule FROM (SELECT page_id, " + HOST + " AS host FROM pages) JOIN (SELECT o_host, 'disallow' AS rule FROM (SELECT DISTINCT " + HOST + " AS o_host FROM pages) WHERE o_host LIKE '%.net') ON host = o_host")
def s6_robots_lookup(spark, d):
    pages = read(spark, d, "pages", "page_id", "url").select("page_id", w.host_of(F.col("url")).alias("host"))
    robots = pages.select("host").distinct().where(F.col("host").endswith(".net")).withColumn("rule", F.lit("disallow"))
    return pages.join(robots, "host").select("page_id", "host", "rule")


@query("SELECT n_regionkey, seed, rank FROM (SELECT n_regionkey, unnest(l) AS seed, generate_subscripts(l, 1) AS rank FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1))")
def s7_seed_source(spark, d):
    seeds = read(spark, d, "nation", "n_regionkey", "n_name").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("l"))
    return seeds.select("n_regionkey", F.posexplode("l").alias("rank", "seed")).withColumn("rank", F.col("rank") + 1)


@query("SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS position FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>', 1) AS l FROM pages)")
def s8_link_source(spark, d):
    return read(spark, d, "pages", "page_id", "html").select("page_id", F.posexplode(w.anchors(F.col("html"))).alias("position", "a")).select("page_id", F.col("a.href").alias("href"), "position")


@query("SELECT user_id, metric, value FROM (SELECT user_id, unnest(['clicks', 'total']) AS metric, unnest([n::DOUBLE, round(v, 4)]) AS value FROM (SELECT user_id, count(*) AS n, sum(value) AS v FROM events GROUP BY 1))")
def s9_metric_unpivot(spark, d):
    wide = read(spark, d, "events", "user_id", "value").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("clicks"), F.round(F.sum("value"), 4).alias("total"))
    return wide.unpivot("user_id", ["clicks", "total"], "metric", "value")


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) IS NOT NULL AS known FROM events WHERE props IS NOT NULL")
def s10_json_source(spark, d):
    e = read(spark, d, "events", "event_id", "props").where("props is not null")
    first = F.element_at(F.map_values(F.from_json("props", "map<string,string>")), 1)
    return e.select("event_id", first.isNotNull().alias("known"))


@query("SELECT user_id, list_has_any(list(DISTINCT event_type), ['purchase', 'error']) AS capable FROM events GROUP BY 1")
def s11_capability_filter(spark, d):
    return read(spark, d, "events", "user_id", "event_type").groupBy("user_id").agg(F.collect_set("event_type").alias("c")).select(
        "user_id", F.arrays_overlap("c", F.array(F.lit("purchase"), F.lit("error"))).alias("capable"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS segment, round(c_acctbal, 2) AS balance FROM customer UNION ALL SELECT -n_nationkey - 1, 'new', 0.0 FROM nation")
def s14_upsert_merge(spark, d):
    old = read(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.round("c_acctbal", 2).alias("balance"))
    new = old.where("k % 2 = 0").select("k", F.lit("new").alias("segment"), F.lit(-1.0).alias("balance")).unionByName(
        read(spark, d, "nation", "n_nationkey").select((-F.col("n_nationkey") - 1).cast("long").alias("k"), F.lit("new").alias("segment"), F.lit(0.0).alias("balance")))
    return r.upsert(old, new, ["k"], ["segment"])


@query("SELECT doc_id, 'old' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s15_insert_ignore(spark, d):
    old = read(spark, d, "labels", "doc_id").withColumn("origin", F.lit("old"))
    return r.insert_ignore(old, read(spark, d, "documents", "doc_id").withColumn("origin", F.lit("new")), ["doc_id"])


@query("SELECT doc_id, CASE WHEN k IS NULL THEN 'malformed' WHEN k IN (SELECT sha256(lower(text)) FROM documents WHERE doc_id < 50) OR n > 1 THEN 'duplicate' ELSE 'accepted' END AS receipt FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN sha256(lower(text)) END AS k FROM documents WHERE doc_id >= 50))")
def s17_append_receipts(spark, d):
    docs = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(F.lower("text"), 256).alias("h"))
    known = docs.where("doc_id < 50").select(F.col("h").alias("k"))
    batch = docs.where("doc_id >= 50").select("doc_id", F.when(F.col("doc_id") % 17 != 0, F.col("h")).alias("k"))
    return r.append_receipts(known, batch, "k", "doc_id").select("doc_id", "receipt")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'applied' ELSE 'conflict' END AS outcome, CASE WHEN o_orderstatus = 'O' THEN 'leased' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 3 = 0")
def s18_guarded_update(spark, d):
    orders = read(spark, d, "orders", "o_orderkey", "o_orderstatus")
    commands = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("O").alias("expected"), F.lit("leased").alias("next"))
    return r.guarded_update(orders, commands, "o_orderkey", "o_orderstatus")


@query("SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 25)::INT AS batch FROM documents")
def s19_queue_batches(spark, d):
    return r.batches(read(spark, d, "documents", "doc_id", "lang"), ["doc_id"], 25, ["lang"])


# Predicates on rows


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")
def p1_conditional_filters(spark, d):
    return r.where_given(read(spark, d, "documents", "doc_id", "lang", "source"), lang="en", source=["src1", "src2"], doc_id=None)


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.page') IN ('home', 'cart', '1', '2', '3') OR json_extract_string(props, '$.k') IN ('1', '2')")
def p2_json_path_filter(spark, d):
    e = read(spark, d, "events", "event_id", "props")
    at = lambda k: F.get_json_object("props", f"$.{k}")
    return e.where(at("page").isin("home", "cart", "1", "2", "3") | at("k").isin("1", "2")).select("event_id")


@query(f"SELECT entry_id FROM {FRONTIER} WHERE (crawl_status IN ('idle', 'scheduled', 'succeeded', 'failed_retryable') OR priority > 300000) AND next_crawl_at <= TIMESTAMP '{NOW}'")
def p4_eligible_frontier(spark, d):
    f = frontier_entries(spark, d)
    open_ = F.col("crawl_status").isin("idle", "scheduled", "succeeded", "failed_retryable") | (F.col("priority") > 300000)
    return f.where(open_ & (F.col("next_crawl_at") <= F.lit(NOW).cast("timestamp"))).select("entry_id")


@query("SELECT event_id FROM events WHERE (props IS NULL OR event_type = 'click') AND (event_type = 'view' OR event_type = 'click' OR event_type IS NULL)")
def p5_optional_dimension(spark, d):
    e = read(spark, d, "events", "event_id", "event_type", "props")
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    return e.where(F.when(F.col("event_type") == "click", True).otherwise(F.col("props").isNull()) & r.matches_or_neutral(kind, "click")).select("event_id")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'stupid') THEN 'rejected' WHEN NOT ((contains(lower(text), 'the') OR contains(lower(text), 'les')) AND contains(lower(text), 'ion')) THEN 'insufficient_evidence' "
       "WHEN score >= 0.6 THEN 'accepted' ELSE 'rejected' END AS decision, score FROM (SELECT doc_id, text, round(least(1.0, greatest(0.0, 0.5 + 0.3 * contains(lower(text), 'ing')::INT - 0.2 * contains(lower(text), 'ung')::INT)), 6)::DOUBLE AS score FROM documents)")
def p9_relevance(spark, d):
    low = F.lower("text")
    score = F.round(s.clamp01(F.lit(0.5) + low.contains("ing").cast("int") * 0.3 - low.contains("ung").cast("int") * 0.2), 6)
    groups = (low.contains("the") | low.contains("les")) & low.contains("ion")
    decision = F.when(low.contains("stupid"), "rejected").when(~groups, "insufficient_evidence").when(score >= 0.6, "accepted").otherwise("rejected")
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", decision.alias("decision"), score.alias("score"))


@query("SELECT p.page_id, CASE WHEN c IS NULL THEN 'missing' WHEN c = p.url THEN 'self' WHEN ch LIKE '%spam%' THEN 'denied' WHEN ch <> h THEN 'cross_host' WHEN t.page_id IS NULL THEN 'unresolved' ELSE 'consolidated' END AS decision FROM "
       f"(SELECT page_id, url, {HOST} AS h, c, {HOST.replace('url', 'c')} AS ch FROM (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN url WHEN 2 THEN 'https://spam.x.com/' WHEN 3 THEN 'https://other.com/' ELSE url || '/' END AS c FROM pages)) p LEFT JOIN pages t ON t.url = c")
def p10_canonical_decision(spark, d):
    p = read(spark, d, "pages", "page_id", "url")
    k = F.col("page_id") % 5
    c = F.when(k == 1, F.col("url")).when(k == 2, "https://spam.x.com/").when(k == 3, "https://other.com/").when(k == 4, F.concat("url", F.lit("/")))
    known = p.select(F.col("url").alias("known")).withColumn("there", F.lit(True))
    j = p.withColumn("c", c).join(known, F.col("known") == F.col("c"), "left")
    ch = w.host_of(F.col("c"))
    return j.select("page_id", F.when(F.col("c").isNull(), "missing").when(F.col("c") == F.col("url"), "self").when(ch.contains("spam"), "denied")
                    .when(ch != w.host_of(F.col("url")), "cross_host").when(F.col("there").isNull(), "unresolved").otherwise("consolidated").alias("decision"))


@query("SELECT o_orderkey, min(adapter) AS adapter FROM orders JOIN (VALUES ('a_http', 'O'), ('b_render', 'F'), ('c_any', 'O'), ('c_any', 'F'), ('c_any', 'P')) v(adapter, st) ON st = o_orderstatus GROUP BY 1")
def p11_adapter_select(spark, d):
    adapters = spark.createDataFrame([("a_http", ["O"]), ("b_render", ["F"]), ("c_any", ["O", "F", "P"])], "adapter string, can array<string>")
    one = adapters.select("adapter", F.explode("can").alias("o_orderstatus"))
    return read(spark, d, "orders", "o_orderkey", "o_orderstatus").join(F.broadcast(one), "o_orderstatus").groupBy("o_orderkey").agg(F.min("adapter").alias("adapter"))


@query("SELECT page_id, rule FROM (SELECT page_id, rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS n FROM (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS p FROM pages) JOIN (VALUES ('/'), ('/en/'), ('/en/1'), ('/de/')) v(rule) ON starts_with(p, rule)) WHERE n = 1")
def p12_robots_longest_prefix(spark, d):
    rules = spark.createDataFrame([("/",), ("/en/",), ("/en/1",), ("/de/",)], "rule string")
    pages = read(spark, d, "pages", "page_id", "url").withColumn("p", w.path_of(F.col("url")))
    return r.latest(pages.join(F.broadcast(rules), F.expr("startswith(p, rule)")), ["page_id"], [F.length("rule").desc()]).select("page_id", "rule")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 0 THEN 'quantity' WHEN l_discount > 0.09 THEN 'discount' WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 'date' END AS problem FROM lineitem WHERE l_discount > 0.09 OR l_quantity <= 0 OR l_shipdate < TIMESTAMP '1993-01-01'")
def p15_first_failing_rule(spark, d):
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate")
    problem = F.when(F.col("l_quantity") <= 0, "quantity").when(F.col("l_discount") > 0.09, "discount").when(ts("l_shipdate") < F.lit("1993-01-01").cast("timestamp"), "date")
    return li.select("l_orderkey", "l_linenumber", problem.alias("problem")).where("problem is not null")


@query("SELECT c_custkey, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'range' END, CASE WHEN c_nationkey > 20 THEN 'nation' END, CASE WHEN length(c_name) > 18 THEN 'length' END], lambda x: x IS NOT NULL)) AS violation FROM customer")
def p18_configuration_violations(spark, d):
    c = read(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_name")
    rules = {"range": F.col("c_acctbal") < 0, "nation": F.col("c_nationkey") > 20, "length": F.length("c_name") > 18}
    return c.select("c_custkey", F.explode(F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in rules.items()]))).alias("violation"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>')) > 5 AS too_many, least(5, len(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>')))::INT AS kept FROM pages")
def p19_result_bounds(spark, d):
    a = w.anchors(F.col("html"))
    return read(spark, d, "pages", "page_id", "html").select("page_id", (F.size(a) > 5).alias("too_many"), F.size(F.slice(a, 1, 5)).alias("kept"))


# Joins

J1 = "documents d JOIN embeddings e ON e.vec_id = d.doc_id"


@query(f"SELECT doc_id, label FROM {J1} WHERE label IS NOT NULL")
def j1_inner_join(spark, d):
    return read(spark, d, "documents", "doc_id").join(read(spark, d, "embeddings", "vec_id", "label"), F.col("doc_id") == F.col("vec_id")).where("label is not null").select("doc_id", "label")


@query("SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def j2_join_group(spark, d):
    return read(spark, d, "customer", "c_nationkey", "c_mktsegment").join(read(spark, d, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents LEFT JOIN (SELECT doc_id AS l, toxic FROM labels) ON l = doc_id WHERE l IS NULL OR toxic = 1")
def j3_backlog_antijoin(spark, d):
    return r.backlog(read(spark, d, "documents", "doc_id"), read(spark, d, "labels", "doc_id", "toxic"), ["doc_id"], "toxic", [1])


@query("SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderdate < l_shipdate AND o_orderstatus <> 'P' WHERE o_orderkey IS NULL OR o_orderpriority = '1-URGENT'")
def j4_backlog_many_keys(spark, d):
    o = read(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderdate") < F.col("l_shipdate")) & (F.col("o_orderstatus") != "P")
    return li.join(o, on, "left").where("o_orderkey is null or o_orderpriority = '1-URGENT'").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, CASE WHEN o_orderkey IS NULL THEN 'pending' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'retry' END AS status FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j5_three_way_status(spark, d):
    last = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"), F.max_by("o_orderstatus", "o_orderkey").alias("st"))
    return read(spark, d, "customer", "c_custkey").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "c_custkey", F.when(F.col("k").isNull(), "pending").when(F.col("st") == "F", "done").otherwise("retry").alias("status"))


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3")
def j6_left_dimension(spark, d):
    return read(spark, d, "supplier", "s_suppkey", "s_nationkey").join(read(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").where("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def j7_left_chain(spark, d):
    o, c, n, g = (read(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(g, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT l_orderkey, l_linenumber, round(trust, 6) AS trust FROM lineitem LEFT JOIN (SELECT k, arg_min(v, (v, -k)) AS trust FROM (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY k) ON k = l_suppkey")
def j8_or_key_lookup(spark, d):
    s_ = read(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    keys = s_.select(F.explode(F.array("s_suppkey", F.col("s_nationkey").cast("long"))).alias("k"), "s_acctbal")
    best = keys.groupBy("k").agg(F.min("s_acctbal").alias("trust"))
    return read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").join(best, F.col("k") == F.col("l_suppkey"), "left").select("l_orderkey", "l_linenumber", F.round("trust", 6).alias("trust"))


@query("SELECT c_custkey, last_order FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j9_hash_attach(spark, d):
    last = r.latest(read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return read(spark, d, "customer", "c_custkey").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("last_order"))


@query("SELECT doc_id, coalesce(e.label::VARCHAR, source) AS reference FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND e.label > 4")
def j10_reference_fallback(spark, d):
    e = read(spark, d, "embeddings", "vec_id", "label").where("label > 4")
    return read(spark, d, "documents", "doc_id", "source").join(e, F.col("vec_id") == F.col("doc_id"), "left").select("doc_id", F.coalesce(F.col("label").cast("string"), "source").alias("reference"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE c_custkey IS NULL) AS missing FROM events LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0 GROUP BY 1")
def j11_snapshot_join(spark, d):
    c = read(spark, d, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0")
    return read(spark, d, "events", "event_type", "user_id").join(c, F.col("user_id") == F.col("c_custkey"), "left").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_custkey").isNull()).alias("missing"))


ALIASES = [("is the", "e1"), ("of", "e2"), ("the and", "e3"), ("in that", "e4")]


@query("SELECT doc_id, entity, count(*) AS mentions FROM (SELECT doc_id, w[i] AS a, w[i] || ' ' || w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ') AS w FROM documents))) "
       "JOIN (VALUES ('is the', 'e1'), ('of', 'e2'), ('the and', 'e3'), ('in that', 'e4')) v(alias, entity) ON alias = a OR alias = b GROUP BY ALL")
def j12_ngram_mentions(spark, d):
    lengths = sorted({len(a.split()) for a, _ in ALIASES})  # only the lengths that the alias table has
    docs = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.split(F.lower(t.collapse(F.col("text"))), " ").alias("w"))
    at = docs.select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    grams = at.select("doc_id", F.explode(F.array(*[F.when(F.col("i") + (n - 1) <= F.size("w"), F.array_join(F.slice("w", F.col("i"), n), " ")) for n in lengths])).alias("alias"))
    aliases = spark.createDataFrame(ALIASES, "alias string, entity string")
    return grams.join(F.broadcast(aliases), "alias").groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("mentions"))


@query("SELECT a.p_type AS a, b.p_type AS b FROM (SELECT DISTINCT lower(p_type) AS p_type FROM part) a JOIN (SELECT DISTINCT lower(n_name) AS p_type FROM nation UNION SELECT DISTINCT split_part(lower(p_type), ' ', 1) FROM part) b ON contains(a.p_type, b.p_type) OR contains(b.p_type, a.p_type)")
def j13_containment_join(spark, d):
    types = read(spark, d, "part", "p_type").select(F.lower("p_type").alias("a")).distinct()
    short = read(spark, d, "nation", "n_name").select(F.lower("n_name").alias("b")).union(types.select(F.split("a", " ")[0])).distinct()
    return r.contains_join(types, short, "a", "b")


@query("SELECT doc_id, item_id FROM (SELECT doc_id, lower(text) AS t FROM documents) JOIN (SELECT item_id, lower(text) AS p FROM benchmark WHERE text <> '') ON contains(t, p)")
def j13_phrases_in_documents(spark, d):
    """Whole benchmark texts within whole documents."""
    docs = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.lower("text").alias("a"))
    items = read(spark, d, "benchmark", "item_id", "text").select("item_id", F.lower("text").alias("b"))
    return r.contained(docs, items, "a", "b", ("doc_id",)).join(items, "b").select("doc_id", "item_id")


@query("SELECT DISTINCT lower(p_type) AS a, EXISTS (SELECT 1 FROM region WHERE contains(lower(p.p_type), lower(substr(r_name, 1, 2)))) AS geo FROM part p")
def j14_containment_semi_join(spark, d):
    types = read(spark, d, "part", "p_type").select(F.lower("p_type").alias("a")).distinct()
    names = read(spark, d, "region", "r_name").select(F.lower(F.substring("r_name", 1, 2)).alias("b"))
    hit = r.contained(types, names, "a", "b").select("a").distinct().withColumn("geo", F.lit(True))
    return types.join(hit, "a", "left").select("a", F.coalesce("geo", F.lit(False)).alias("geo"))


def dimension(spark, d, table: str, key: str, link: str) -> DataFrame:
    return read(spark, d, table, key, link).select(F.col(key).alias("key"), F.array(link).alias("ids"))


@query("SELECT n_name AS first, s_name AS second, c_name AS third FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN customer ON n_nationkey = c_nationkey ORDER BY 1, 2, 3 LIMIT 25")
def j15_dimension_combinations(spark, d):
    return r.combinations({"first": dimension(spark, d, "nation", "n_name", "n_nationkey"), "second": dimension(spark, d, "supplier", "s_name", "s_nationkey"),
                           "third": dimension(spark, d, "customer", "c_name", "c_nationkey")}, "key", "ids", 25)


@query("SELECT p_partkey, last_line FROM part LEFT JOIN (SELECT l_partkey, max(l_orderkey * 10 + l_linenumber) AS last_line FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def j16_last_page_per_candidate(spark, d):
    last = read(spark, d, "lineitem", "l_partkey", "l_orderkey", "l_linenumber").groupBy("l_partkey").agg(F.max(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("last_line"))
    return read(spark, d, "part", "p_partkey").join(last, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", "last_line")


@query("SELECT a.n_name AS alias, string_agg(b.n_name, ',' ORDER BY b.n_name) AS expansion FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name GROUP BY 1")
def j17_two_hop_expansion(spark, d):
    n = read(spark, d, "nation", "n_name", "n_regionkey")
    b = n.select(F.col("n_name").alias("other"), "n_regionkey")
    return n.join(b, "n_regionkey").where("n_name <> other").groupBy(F.col("n_name").alias("alias")).agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("expansion"))


PREDICATES = [("click", "en", "p1", 0.9), ("click", None, "p2", 0.95), ("view", "de", "p3", 0.5), ("view", "en", "p4", 0.5), ("purchase", None, "p5", 0.7), ("purchase", None, "p6", 0.7)]


@query("SELECT DISTINCT event_type, CASE WHEN count(*) OVER (PARTITION BY event_type) > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome, min(p) OVER (PARTITION BY event_type) AS predicate FROM (SELECT event_type, p, rank() OVER (PARTITION BY event_type ORDER BY conf + CASE WHEN lang = 'en' THEN 2 WHEN lang IS NULL THEN 1 ELSE 0 END DESC) AS n "
       "FROM (SELECT DISTINCT event_type FROM events) JOIN (VALUES ('click', 'en', 'p1', 0.9), ('click', NULL, 'p2', 0.95), ('view', 'de', 'p3', 0.5), ('view', 'en', 'p4', 0.5), ('purchase', NULL, 'p5', 0.7), ('purchase', NULL, 'p6', 0.7)) v(alias, lang, p, conf) ON alias = event_type) WHERE n = 1")
def j18_predicate_resolution(spark, d):
    names = read(spark, d, "events", "event_type").distinct()
    registry = spark.createDataFrame(PREDICATES, "alias string, lang string, p string, conf double")
    score = F.col("conf") + F.when(F.col("lang") == "en", 2).when(F.col("lang").isNull(), 1).otherwise(0)
    ranked = r.rank_with_ties(names.join(F.broadcast(registry), F.col("alias") == F.col("event_type")).withColumn("score", score), ["event_type"], "score")
    return ranked.groupBy("event_type", "outcome").agg(F.min("p").alias("predicate"))


# Aggregates


@query(f"SELECT crawl_status, count(*) AS n FROM {FRONTIER} GROUP BY 1")
def a1_count_by_status(spark, d):
    return frontier_entries(spark, d).groupBy("crawl_status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT topic_id, count(*) AS total, count(*) FILTER (WHERE crawl_status = 'scheduled') AS scheduled, count(*) FILTER (WHERE crawl_status = 'leased') AS leased FROM {FRONTIER} GROUP BY 1")
def a2_status_summary(spark, d):
    is_ = lambda x: F.count_if(F.col("crawl_status") == x)
    return frontier_entries(spark, d).groupBy("topic_id").agg(F.count(F.lit(1)).alias("total"), is_("scheduled").alias("scheduled"), is_("leased").alias("leased"))


@query(f"SELECT lang, count(*) AS chunks, count(DISTINCT source) AS sources, count(vec_id) > 0 AS ready FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1")
def a3_readiness(spark, d):
    e = read(spark, d, "embeddings", "vec_id")
    return read(spark, d, "documents", "doc_id", "lang", "source").join(e, F.col("vec_id") == F.col("doc_id"), "left").groupBy("lang").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("sources"), (F.count("vec_id") > 0).alias("ready"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, l_discount, l_tax, count(*) AS n FROM lineitem GROUP BY ALL")
def a4_many_key_count(spark, d):
    return read(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax").groupBy("l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) FILTER (WHERE next_crawl_at <= TIMESTAMP '{NOW}') AS eligible, greatest(0, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(min(next_crawl_at) FILTER (WHERE crawl_status = 'scheduled'))) / 6e7))::BIGINT AS oldest_minutes FROM {FRONTIER}")
def a5_frontier_telemetry(spark, d):
    now = F.lit(NOW).cast("timestamp")
    oldest = F.min(F.when(F.col("crawl_status") == "scheduled", F.col("next_crawl_at")))
    return frontier_entries(spark, d).agg(F.count_if(F.col("next_crawl_at") <= now).alias("eligible"), s.age_minutes(oldest, now).cast("long").alias("oldest_minutes"))


@query(f"SELECT subject, predicate, value, round(avg(trust), 6) AS confidence, count(DISTINCT domain) AS domains, count(DISTINCT chunk) AS chunks FROM {FACTS} GROUP BY 1, 2, 3")
def a6_fact_groups(spark, d):
    return facts(spark, d).groupBy("subject", "predicate", "value").agg(F.round(F.avg("trust"), 6).alias("confidence"), F.count_distinct("domain").alias("domains"), F.count_distinct("chunk").alias("chunks"))


ALTERNATIVES = (f"SELECT subject, predicate, value, count(*) AS facts, count(DISTINCT domain) AS domains, {CL4.format('avg(trust)')} AS trust, {CL4.format('avg(evidence)')} AS evidence FROM {FACTS} GROUP BY 1, 2, 3")
SUPPORT = CL4.format("least(0.35::DOUBLE, facts * 0.1::DOUBLE) + least(0.25::DOUBLE, domains * 0.1::DOUBLE) + trust * 0.2 + evidence * 0.2")


def alternatives(spark, d) -> DataFrame:
    """One row per subject, predicate and value, from one scan that is pre-aggregated by domain. first_domains counts the
    domains that no smaller value of the group has, so that its sum over a group is the group's number of domains."""
    each = facts(spark, d).groupBy("subject", "predicate", "domain", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("trust").alias("t"), F.count("trust").alias("t_n"), F.sum("evidence").alias("e"), F.count("evidence").alias("e_n"))
    first = F.row_number().over(Window.partitionBy("subject", "predicate", "domain").orderBy("value")) == 1
    a = each.withColumn("first", first & F.col("domain").isNotNull()).groupBy("subject", "predicate", "value").agg(
        F.sum("n").alias("facts"), F.count("domain").alias("domains"), s.clamp4(F.sum("t") / F.sum("t_n")).alias("trust"), s.clamp4(F.sum("e") / F.sum("e_n")).alias("evidence"),
        F.count_if("first").alias("first_domains"))
    return a.withColumn("support", s.support_score(F.col("facts"), F.col("domains"), F.col("trust"), F.col("evidence")))


def consensus(spark, d) -> DataFrame:
    """One row per subject and predicate: facts, domains, best support, level, and the severity of its conflict (null without one)."""
    g = alternatives(spark, d).groupBy("subject", "predicate").agg(
        F.sum("facts").alias("facts"), F.sum("first_domains").alias("domains"), F.max("support").alias("best"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("domains") > 0).alias("supported"))
    severity = F.when((F.col("supported") >= 2) & (F.col("domains") >= 3), "high").when(F.col("supported") >= 2, "medium").otherwise("low")
    return g.withColumn("level", s.consensus_level(F.col("facts"), F.col("domains"), F.col("best"))).withColumn("severity", F.when(F.col("n") > 1, severity))


@query(f"SELECT subject, predicate, facts, domains, best, CASE WHEN facts >= 3 AND domains >= 2 AND best >= 0.65 THEN 'strong' WHEN facts >= 2 AND best >= 0.5 THEN 'moderate' ELSE 'weak' END AS level FROM (SELECT subject, predicate, sum(facts)::BIGINT AS facts, max(best) AS best FROM (SELECT *, {SUPPORT} AS best FROM ({ALTERNATIVES})) GROUP BY 1, 2) JOIN (SELECT subject, predicate, count(DISTINCT domain) AS domains FROM {FACTS} GROUP BY 1, 2) USING (subject, predicate)")
def a7_consensus_groups(spark, d):
    return consensus(spark, d).select("subject", "predicate", "facts", "domains", "best", "level")


@query(f"SELECT subject, predicate, value, facts, domains, trust, evidence, {SUPPORT} AS support FROM ({ALTERNATIVES})")
def a8_alternatives(spark, d):
    return alternatives(spark, d).drop("first_domains")


@query(f"SELECT subject, predicate, CASE WHEN count(*) >= 2 AND any_value(gd) >= 3 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS severity FROM ({ALTERNATIVES}) JOIN (SELECT subject, predicate, count(DISTINCT domain) AS gd FROM {FACTS} GROUP BY 1, 2) USING (subject, predicate) GROUP BY 1, 2 HAVING count(*) > 1")
def a9_conflict_sets(spark, d):
    return consensus(spark, d).where("severity is not null").select("subject", "predicate", "severity")


@query("SELECT subject, " + CL4.format("0.28::DOUBLE + least(0.24::DOUBLE, count(DISTINCT chunk) * 0.06::DOUBLE) + least(0.24::DOUBLE, count(DISTINCT chunk) * 0.08::DOUBLE) + least(0.24::DOUBLE, count(DISTINCT domain) * 0.08::DOUBLE) + (" + CL4.format("round(avg(trust), 9)") + " - 0.5) * 0.28 - CASE WHEN count(DISTINCT value) > 1 THEN 0.18 ELSE 0.0 END::DOUBLE") + f" AS strength FROM {FACTS} GROUP BY 1")
def a10_evidence_strength(spark, d):
    g = facts(spark, d).groupBy("subject").agg(F.count_distinct("chunk").alias("c"), F.count_distinct("domain").alias("n"), F.round(F.avg("trust"), 9).alias("t"), (F.count_distinct("value") > 1).alias("conflict"))
    return g.select("subject", s.evidence_strength(F.col("c"), F.col("c"), F.col("n"), s.clamp4(F.col("t")), F.col("conflict")).alias("strength"))


@query("SELECT l_suppkey, " + CL4.format("conf * 0.35 + conf * 0.2 + " + CL4.format("least(1.0::DOUBLE, n * 0.05::DOUBLE)") + " * 0.15 + " + CL4.format("least(1.0::DOUBLE, o * 0.12::DOUBLE) + least(1.0::DOUBLE, p * 0.18::DOUBLE)") + " * 0.15 + 0.45::DOUBLE * 0.15") + " AS score FROM (SELECT l_suppkey, avg(l_discount) * 10 AS conf, count(*) AS n, count(DISTINCT l_orderkey) AS o, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1)")
def a11_entity_score(spark, d):
    g = read(spark, d, "lineitem", "l_suppkey", "l_discount", "l_orderkey", "l_partkey").groupBy("l_suppkey").agg(
        (F.avg("l_discount") * 10).alias("conf"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("o"), F.count_distinct("l_partkey").alias("p"))
    return g.select("l_suppkey", s.entity_score(F.col("conf"), F.lit(None).cast("double"), F.col("n"), F.col("o"), F.col("p"), F.lit(None).cast("double")).alias("score"))


HEADINGS = f"(SELECT page_id, {HOST} AS domain, unnest(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS raw FROM pages)"


def page_headings(spark, d) -> DataFrame:
    p = read(spark, d, "pages", "page_id", "url", "html").select("page_id", w.host_of(F.col("url")).alias("domain"), F.explode(w.headings(F.col("html"))).alias("h"))
    return p.select("page_id", "domain", F.col("h.level").alias("level"), t.normalize_concept(F.col("h.text")).alias("text"))


NORM = "trim(regexp_replace(regexp_replace(lower(replace(replace(replace(replace(replace(replace(regexp_replace(raw, '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')), '[^\\p{L}\\p{N}\\s?]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT text, count(*) AS frequency, count(DISTINCT domain) AS diversity FROM (SELECT page_id, domain, {NORM} AS text FROM {HEADINGS}) GROUP BY 1")
def a12_heading_patterns(spark, d):
    return page_headings(spark, d).where("level = 1").groupBy("text").agg(F.count(F.lit(1)).alias("frequency"), F.count_distinct("domain").alias("diversity"))


@query("SELECT question, count(DISTINCT conv_id) AS frequency FROM (SELECT conv_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS question FROM conversations WHERE contains(text, '?') OR turn = 0) GROUP BY 1")
def a13_faq_patterns(spark, d):
    c = read(spark, d, "conversations", "conv_id", "turn", "text").where(F.col("text").contains("?") | (F.col("turn") == 0))
    return c.groupBy(t.normalize_chunk(F.col("text")).alias("question")).agg(F.count_distinct("conv_id").alias("frequency"))


@query("SELECT p_type, lower(p_brand) AS name, count(*) AS frequency, count(DISTINCT p_size) AS diversity FROM part GROUP BY ALL")
def a14_entity_patterns(spark, d):
    return read(spark, d, "part", "p_type", "p_brand", "p_size").groupBy("p_type", F.lower("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("frequency"), F.count_distinct("p_size").alias("diversity"))


@query("SELECT c_mktsegment, min(c_acctbal) AS low, list_sort(list(c_acctbal))[(count(*) // 2) + 1] AS middle, max(c_acctbal) AS high FROM customer GROUP BY 1")
def a15_depth_median(spark, d):
    return read(spark, d, "customer", "c_mktsegment", "c_acctbal").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("low"), r.upper_median("c_acctbal").alias("middle"), F.max("c_acctbal").alias("high"))


ANGLES = {"informational": ["what is", "why", "risks"], "commercial": ["price", "cost", "ering"], "local": ["city", "map", "tion"], "review": ["best", "top", "the"]}


@query("SELECT angle, sum(contains(lower(html), k)::INT)::BIGINT AS score FROM pages, (VALUES " + ", ".join(f"('{a}', '{k}')" for a, ks in ANGLES.items() for k in ks) + ") v(angle, k) GROUP BY 1")
def a16_content_angle(spark, d):
    low = F.lower("html")
    sums = [F.sum(sum((low.contains(k).cast("int") for k in ks), F.lit(0))).alias(a) for a, ks in ANGLES.items()]
    return read(spark, d, "pages", "html").agg(*sums).unpivot([], list(ANGLES), "angle", "score")


@query("SELECT keyword, count(*) AS observations, min(conv_id) AS first_conv, arg_min(role, (CASE role WHEN 'assistant' THEN 0 ELSE 1 END, conv_id, turn)) AS source FROM (SELECT conv_id, turn, role, split_part(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ', 1) AS keyword FROM conversations) GROUP BY 1")
def a17_keyword_candidates(spark, d):
    c = read(spark, d, "conversations", "conv_id", "turn", "role", "text").withColumn("keyword", F.split(t.normalize_chunk(F.col("text")), " ")[0])
    first = F.min(F.struct(F.when(F.col("role") == "assistant", 0).otherwise(1).alias("tier"), "conv_id", "turn", "role"))["role"]
    return c.groupBy("keyword").agg(F.count(F.lit(1)).alias("observations"), F.min("conv_id").alias("first_conv"), first.alias("source"))


@query("SELECT key, max(frequency)::BIGINT AS frequency, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT p_brand AS key, 'brand' AS kind, count(*) AS frequency FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'size', max(p_size) FROM part GROUP BY 1) GROUP BY 1")
def a18_intent_candidates(spark, d):
    p = read(spark, d, "part", "p_brand", "p_size").groupBy(F.col("p_brand").alias("key"))
    a = p.agg(F.count(F.lit(1)).alias("frequency")).withColumn("kind", F.lit("brand"))
    b = p.agg(F.max("p_size").cast("long").alias("frequency")).withColumn("kind", F.lit("size"))
    return a.unionByName(b).groupBy("key").agg(F.max("frequency").alias("frequency"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("SELECT p_brand, CASE max(CASE WHEN p_size > 40 THEN 3 WHEN p_size > 20 THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM part GROUP BY 1")
def a19_signal_merge(spark, d):
    rank = F.max(F.when(F.col("p_size") > 40, 3).when(F.col("p_size") > 20, 2).otherwise(1))
    return read(spark, d, "part", "p_brand", "p_size").groupBy("p_brand").agg(rank.alias("k")).select("p_brand", F.when(F.col("k") == 3, "high").when(F.col("k") == 2, "medium").otherwise("low").alias("confidence"))


@query("SELECT n_regionkey, string_agg(c_mktsegment || '=' || n, ',' ORDER BY c_mktsegment) AS counts FROM (SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) GROUP BY 1")
def a20_cluster_rollup(spark, d):
    c = read(spark, d, "customer", "c_nationkey", "c_mktsegment").join(read(spark, d, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = c.groupBy("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", "n"))), lambda x: F.concat_ws("=", x["c_mktsegment"], x["n"])), ",").alias("counts"))


@query("SELECT n_regionkey, min(n_nationkey)::INT AS lowest, count(*) AS leaves FROM nation GROUP BY 1")
def a21_opportunity_tree(spark, d):
    return read(spark, d, "nation", "n_regionkey", "n_nationkey").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("lowest"), F.count(F.lit(1)).alias("leaves"))


WEIGHTS = {"1": 1.2, "2": 1.1, "3": 1.0, "4": 0.8, "5": -0.6}


@query("SELECT l_orderkey, greatest(0, least(100, floor(sum(coalesce(CASE WHEN l_quantity > 5 THEN l_quantity * 2 END, -8) * w) / sum(abs(w)) + 0.5)))::INT AS score, bool_or(l_quantity <= 5) AS degraded FROM lineitem JOIN (VALUES (1, 1.2::DOUBLE), (2, 1.1), (3, 1.0), (4, 0.8), (5, -0.6)) v(k, w) ON k = l_linenumber GROUP BY 1")
def a22_opportunity_score(spark, d):
    """Weighted signals of an order, added in the order of the table's rows: a sum of doubles that falls on a half depends on it."""
    weight = s.lookup({int(k): v for k, v in WEIGHTS.items()}, F.col("l_linenumber"))
    value = F.coalesce(F.when(F.col("l_quantity") > 5, F.col("l_quantity") * 2), F.lit(-8.0))
    li = read(spark, d, "lineitem").select("l_orderkey", "l_quantity", value.alias("value"), weight.alias("w"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).where("w is not null")
    lines = F.array_sort(F.collect_list(F.struct("file", "row", (F.col("value") * F.col("w")).alias("x"), F.abs("w").alias("w"))))  # the few lines of an order
    g = li.groupBy("l_orderkey").agg(lines.alias("lines"), F.bool_or(F.col("l_quantity") <= 5).alias("degraded"))
    total = lambda name: F.aggregate("lines", F.lit(0.0), lambda a, x: a + x[name])
    return g.select("l_orderkey", s.clamp(s.js_round(total("x") / total("w")), 0, 100).cast("int").alias("score"), "degraded")


@query("SELECT l_suppkey, CASE WHEN avg(k) >= 2.5 THEN 'high' WHEN avg(k) >= 1.5 THEN 'medium' WHEN avg(k) > 0 THEN 'low' ELSE 'unknown' END AS band FROM (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 1 ELSE 0 END AS k FROM lineitem) GROUP BY 1")
def a23_confidence_band(spark, d):
    rank = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 1).otherwise(0)
    return read(spark, d, "lineitem", "l_suppkey", "l_returnflag").groupBy("l_suppkey").agg(s.confidence_band(F.avg(rank)).alias("band"))


@query("SELECT l_partkey, CASE WHEN round(avg(l_discount * 10), 6) >= 0.8 AND count(DISTINCT l_suppkey) >= 2 THEN 'high' WHEN round(avg(l_discount * 10), 6) >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem GROUP BY 1")
def a24_pack_confidence(spark, d):
    g = read(spark, d, "lineitem", "l_partkey", "l_discount", "l_suppkey").groupBy("l_partkey").agg(F.round(F.avg(F.col("l_discount") * 10), 6).alias("a"), F.count_distinct("l_suppkey").alias("n"))
    return g.select("l_partkey", F.when((F.col("a") >= 0.8) & (F.col("n") >= 2), "high").when(F.col("a") >= 0.6, "medium").otherwise("low").alias("confidence"))


@query("SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS chunks, count(DISTINCT role) AS sources, max(length(text))::INT AS best FROM conversations GROUP BY 1")
def a25_context_sections(spark, d):
    g = read(spark, d, "conversations", "conv_id", "turn", "role", "text").groupBy("conv_id")
    return g.agg(F.array_join(F.array_sort(F.collect_list("turn")), ",").alias("chunks"), F.count_distinct("role").alias("sources"), F.max(F.length("text")).alias("best"))


@query("SELECT source, array_to_string(list_filter([CASE WHEN count(*) < 30 THEN 'few' END, CASE WHEN count(DISTINCT lang) <= 3 THEN 'language' END, CASE WHEN bool_or(lang = 'es') IS NOT TRUE THEN 'geo' END], lambda x: x IS NOT NULL), ',') AS gaps FROM documents GROUP BY 1")
def a26_gap_detection(spark, d):
    g = read(spark, d, "documents", "source", "lang").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("l"), F.bool_or(F.col("lang") == "es").alias("es"))
    gaps = F.array_compact(F.array(F.when(F.col("n") < 30, F.lit("few")), F.when(F.col("l") <= 3, F.lit("language")), F.when(~F.coalesce("es", F.lit(False)), F.lit("geo"))))
    return g.select("source", F.array_join(gaps, ",").alias("gaps"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS refresh, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-01-01') AS stale, count(*) FILTER (WHERE o_orderpriority IS NULL) AS missing FROM orders")
def a27_freshness_counters(spark, d):
    return read(spark, d, "orders", "o_orderstatus", "o_orderdate", "o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("refresh"), F.count_if(ts("o_orderdate") < F.lit("1995-01-01").cast("timestamp")).alias("stale"), F.count_if(F.col("o_orderpriority").isNull()).alias("missing"))


@query("SELECT count(*) AS active, count(*) FILTER (WHERE last_order IS NULL OR last_order < TIMESTAMP '1997-06-01') AS starved FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal > 0")
def a28_operations_snapshot(spark, d):
    last = read(spark, d, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.max(ts("o_orderdate")).alias("last"))
    c = read(spark, d, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0").join(last, F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("last").isNull() | (F.col("last") < F.lit("1997-06-01").cast("timestamp"))).alias("starved"))


@query("SELECT event_type, count(*) AS receipts, sum((value > 50)::INT)::BIGINT AS failed FROM events GROUP BY 1")
def a29_receipt_counters(spark, d):
    return read(spark, d, "events", "event_type", "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("receipts"), F.sum((F.col("value") > 50).cast("int")).alias("failed"))


@query("SELECT lang, count(*) FILTER (WHERE toxic = 0) AS accepted, count(*) FILTER (WHERE toxic = 1) AS rejected, count(*) FILTER (WHERE toxic IS NULL) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def a30_outcome_pivot(spark, d):
    j = read(spark, d, "documents", "doc_id", "lang").join(read(spark, d, "labels", "doc_id", "toxic"), "doc_id", "left")
    state = F.when(F.col("toxic").isNull(), "missing").when(F.col("toxic") == 1, "rejected").otherwise("accepted")
    return j.withColumn("state", state).groupBy("lang").pivot("state", ["accepted", "rejected", "missing"]).count().na.fill(0)


# Windows


@query("SELECT doc_id, source, 1.0::DOUBLE / row_number() OVER (PARTITION BY source ORDER BY doc_id) AS diversity FROM documents")
def w1_diversity_rank(spark, d):
    return r.diversity_factor(read(spark, d, "documents", "doc_id", "source"), F.col("source"), [F.col("doc_id")])


@query(f"SELECT attempt_id, CASE WHEN b IS NULL THEN 'unknown' WHEN b = content_hash THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT *, lag(content_hash) OVER (PARTITION BY entry_id ORDER BY recorded_at, attempt_id) AS b FROM {ATTEMPTS} WHERE status = 'succeeded')")
def w2_content_change(spark, d):
    return r.change_of(attempts(spark, d), "entry_id", ["recorded_at", "attempt_id"], "content_hash", "status").select("attempt_id", "change")


@query(f"SELECT attempt_id, failures::BIGINT AS failures, CASE WHEN status = 'succeeded' THEN 'succeeded' WHEN status <> 'failed_retryable' OR failures >= 5 THEN 'failed_terminal' ELSE 'failed_retryable' END AS next_status FROM (SELECT *, sum((status = 'failed_retryable')::INT) OVER (PARTITION BY entry_id, run ORDER BY recorded_at, attempt_id ROWS UNBOUNDED PRECEDING) AS failures FROM (SELECT *, sum((status = 'succeeded')::INT) OVER (PARTITION BY entry_id ORDER BY recorded_at, attempt_id ROWS UNBOUNDED PRECEDING) AS run FROM {ATTEMPTS}))")
def w3_retry_streaks(spark, d):
    return r.failure_streaks(attempts(spark, d), "entry_id", ["recorded_at", "attempt_id"], "status").select("attempt_id", "failures", "next_status")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def w4_latest_per_key(spark, d):
    return read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("SELECT l_partkey, l_suppkey, CASE WHEN count(*) OVER (PARTITION BY l_partkey) > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome FROM (SELECT l_partkey, l_suppkey, rank() OVER (PARTITION BY l_partkey ORDER BY n DESC) AS k FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k = 1")
def w5_rank_with_ties(spark, d):
    g = read(spark, d, "lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return r.rank_with_ties(g, ["l_partkey"], "n").select("l_partkey", "l_suppkey", "outcome")


@query(f"SELECT attempt_id, first_value(attempt_id) OVER (PARTITION BY entry_id, content_hash ORDER BY recorded_at, attempt_id) AS version, coalesce(lag(content_hash) OVER (PARTITION BY entry_id ORDER BY recorded_at, attempt_id) = content_hash, false) AS skipped FROM {ATTEMPTS} WHERE status = 'succeeded'")
def w6_version_chain(spark, d):
    a = attempts(spark, d).where("status = 'succeeded'")
    order = ["recorded_at", "attempt_id"]
    version = F.first("attempt_id").over(Window.partitionBy("entry_id", "content_hash").orderBy(*order))
    before = F.lag("content_hash").over(Window.partitionBy("entry_id").orderBy(*order))
    return a.select("attempt_id", version.alias("version"), F.coalesce(before == F.col("content_hash"), F.lit(False)).alias("skipped"))


@query("SELECT c_custkey, floor(1000 * w / sum(w) OVER (PARTITION BY c_nationkey))::INT AS budget FROM (SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 3.0 WHEN 'MACHINERY' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM customer WHERE c_acctbal > 0)")
def w7_budget_shares(spark, d):
    weight = F.when(F.col("c_mktsegment") == "BUILDING", 3.0).when(F.col("c_mktsegment") == "MACHINERY", 2.0).otherwise(1.0)
    c = read(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal").where("c_acctbal > 0").withColumn("w", weight)
    return c.select("c_custkey", F.floor(1000 * F.col("w") / F.sum("w").over(Window.partitionBy("c_nationkey"))).cast("int").alias("budget"))


@query("SELECT conv_id, role, 'source-' || dense_rank() OVER (PARTITION BY conv_id ORDER BY first) AS source_id FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL)")
def w8_ordinal_ids(spark, d):
    g = read(spark, d, "conversations", "conv_id", "role", "turn").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return g.select("conv_id", "role", F.concat(F.lit("source-"), F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first"))).alias("source_id"))


@query("SELECT min(doc_id) AS doc_id, sha256(lower(text)) AS h FROM documents GROUP BY 2")
def w9_first_wins(spark, d):
    docs = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(F.lower("text"), 256).alias("h"))
    return r.first_wins(docs, ["h"], "doc_id")


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chunk_index, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations")
def w10_chunk_positions(spark, d):
    by = Window.partitionBy("conv_id")
    return read(spark, d, "conversations", "conv_id", "turn").select("conv_id", "turn", (F.row_number().over(by.orderBy("turn")) - 1).alias("chunk_index"), F.count(F.lit(1)).over(by).alias("total"))


@query("SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) = 1 THEN 'medium' ELSE 'low' END AS confidence FROM customer")
def w11_rank_confidence(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("c_nationkey", "c_mktsegment"))
    return read(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select("c_custkey", F.when(n == 1, "medium").otherwise("low").alias("confidence"))


# Order and limits


@query(f"SELECT entry_id, priority FROM {FRONTIER} WHERE crawl_status = 'scheduled' ORDER BY next_crawl_at, priority DESC, entry_id LIMIT 50")
def o1_lease_topn(spark, d):
    return frontier_entries(spark, d).where("crawl_status = 'scheduled'").orderBy("next_crawl_at", F.desc("priority"), "entry_id").limit(50).select("entry_id", "priority")


@query("SELECT doc_id FROM documents ORDER BY created, doc_id LIMIT 20".replace("created", "n_chars"))
def o5_backlog_order(spark, d):
    return read(spark, d, "documents", "doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(20).select("doc_id")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def o6_recent_n(spark, d):
    return read(spark, d, "orders", "o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey")


@query(f"SELECT text, frequency, diversity FROM ({ORACLES['a12_heading_patterns']}) ORDER BY diversity DESC, frequency DESC, text LIMIT 10")
def o7_pattern_order(spark, d):
    return a12_heading_patterns(spark, d).orderBy(F.desc("diversity"), F.desc("frequency"), "text").limit(10)


@query(f"SELECT p_brand, confidence FROM ({ORACLES['a19_signal_merge']}) ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, p_brand LIMIT 10")
def o8_confidence_order(spark, d):
    return a19_signal_merge(spark, d).orderBy(s.confidence_rank(F.col("confidence")).desc(), "p_brand").limit(10)


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 10")
def o9_topn_per_kind(spark, d):
    return r.latest(read(spark, d, "documents", "lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 10).select("lang", "doc_id")


@query("SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_quantity DESC, l_linenumber) AS top FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS k FROM lineitem WHERE l_quantity > 10) WHERE k <= 5 GROUP BY 1")
def o10_top5_rationale(spark, d):
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").where("l_quantity > 10")
    by = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")
    top = li.withColumn("k", F.row_number().over(by)).where("k <= 5").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", "l_linenumber"))).alias("t"))
    return top.select("l_orderkey", F.array_join(F.transform("t", lambda x: x["l_linenumber"].cast("string")), ",").alias("top"))


@query("SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def o11_global_cap(spark, d):
    return read(spark, d, "part", "p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100).select("p_partkey")


# Set operations


@query("SELECT h, max(n_chars) AS n_chars, arg_min(doc_id, (-n_chars, doc_id)) AS base, min(doc_id) AS first_seq, count(*) AS merged FROM (SELECT doc_id, n_chars, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h FROM documents) GROUP BY 1")
def u2_dedupe_merge(spark, d):
    docs = read(spark, d, "documents", "doc_id", "n_chars", "text").withColumn("h", F.sha2(t.normalize_chunk(F.col("text")), 256))
    return r.merge_by_hash(docs.drop("text"), "h", "n_chars", "doc_id")


@query("SELECT c_name AS name, 'customer' AS provider, c_acctbal AS metric FROM customer UNION ALL SELECT s_name, 'supplier', NULL FROM supplier")
def u3_union_providers(spark, d):
    a = read(spark, d, "customer", "c_name", "c_acctbal").select(F.col("c_name").alias("name"), F.lit("customer").alias("provider"), F.col("c_acctbal").alias("metric"))
    b = read(spark, d, "supplier", "s_name").select(F.col("s_name").alias("name"), F.lit("supplier").alias("provider"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT q, arg_min(src, rank) AS src FROM (SELECT lower(text) AS q, 'conv' AS src, 0 AS rank FROM conversations WHERE turn = 0 UNION ALL SELECT lower(text), 'bench', 1 FROM benchmark) GROUP BY 1")
def u4_union_distinct(spark, d):
    a = read(spark, d, "conversations", "text", "turn").where("turn = 0").select(F.lower("text").alias("q"), F.lit("conv").alias("src"), F.lit(0).alias("rank"))
    b = read(spark, d, "benchmark", "text").select(F.lower("text").alias("q"), F.lit("bench").alias("src"), F.lit(1).alias("rank"))
    return a.unionByName(b).groupBy("q").agg(F.min_by("src", "rank").alias("src"))


@query("SELECT doc_id, len(list_distinct(string_split(text, ' ')))::INT AS n FROM documents")
def u5_array_distinct(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(F.array_distinct(F.split("text", " "))).alias("n"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u6_difference(spark, d):
    return read(spark, d, "documents", "doc_id").exceptAll(read(spark, d, "labels", "doc_id"))


@query("SELECT a.conv_id, len(list_intersect(string_split(a.text, ' '), string_split(b.text, ' ')))::INT AS common FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1")
def u7_intersection(spark, d):
    c = read(spark, d, "conversations", "conv_id", "turn", "text")
    b = c.where("turn = 1").select("conv_id", F.col("text").alias("other"))
    return c.where("turn = 0").join(b, "conv_id").select("conv_id", F.size(F.array_intersect(F.split("text", " "), F.split("other", " "))).alias("common"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS warnings FROM events GROUP BY 1")
def u8_union_warnings(spark, d):
    return read(spark, d, "events", "user_id", "event_type").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("event_type"))))), ",").alias("warnings"))


@query("SELECT event_type, date_trunc('hour', ts) AS w, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def st_event_tumbling(spark, d):
    e = read(spark, d, "events", "event_type", "ts", "value").withColumn("ts", ts("ts"))
    g = e.groupBy("event_type", F.window("ts", "1 hour").alias("win")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return g.select("event_type", F.col("win.start").cast("timestamp_ntz").alias("w"), "n", "v")


@query("SELECT user_id, max(session)::BIGINT AS sessions, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1")
def st_event_sessions(spark, d):
    return r.sessions(read(spark, d, "events", "user_id", "ts"), "user_id", ts("ts"), 3600).groupBy("user_id").agg(F.max("session").alias("sessions"), F.count(F.lit(1)).alias("n"))
