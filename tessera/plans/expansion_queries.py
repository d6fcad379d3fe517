"""Topic expansion and long-tail discovery over the test tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import expansion as x
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


NORMAL = "trim(regexp_replace(regexp_replace(lower(label), '[^\\p{L}\\p{N}\\s?]', ' ', 'g'), '\\s+', ' ', 'g'))"
RANKED = "CASE coalesce(confidence, 'low') WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
# Signals: names of parts are demand, types questions, headings and comparisons, nouns entities; nations are entities and every second one a place.
SIGNALS_SQL = f"""
    WITH i AS (SELECT p_partkey AS seq, 'demand_candidate' AS type, p_name AS label, CASE WHEN p_partkey % 4 = 0 THEN 'medium' END AS confidence, p_size % 3 AS diversity FROM part
        UNION ALL SELECT p_partkey, 'serp_faq', 'Why ' || p_type || '?', 'low', 1 FROM part UNION ALL SELECT p_partkey, 'knowledge_entity', split_part(p_name, ' ', 2), 'high', 0 FROM part
        UNION ALL SELECT p_partkey, 'serp_heading', p_type || CASE WHEN p_partkey % 2 = 0 THEN ' alternative' ELSE '' END, 'unknown', NULL FROM part
        UNION ALL SELECT p_partkey, 'intent_opportunity', p_brand || ' -- ' || CASE WHEN p_partkey % 3 = 0 THEN 'versus' ELSE 'price' END, NULL, NULL FROM part
        UNION ALL SELECT n_nationkey, 'serp_entity', n_name || ' market', 'low', 1 FROM nation UNION ALL SELECT n_nationkey, 'geo_hint', n_name, 'low', 1 FROM nation WHERE n_nationkey % 2 = 0),
    s AS (SELECT type, {NORMAL} AS value, arg_min(label, seq) AS label, max({RANKED}) AS rank, max(diversity) AS diversity FROM i GROUP BY 1, 2),
    v AS (SELECT DISTINCT value FROM s WHERE value <> ''), p AS (SELECT a.value AS a, b.value AS b FROM v a JOIN v b ON contains(a.value, b.value) OR contains(b.value, a.value)),
    t AS (SELECT a, type, count(*) AS n, max(coalesce(diversity, 0)) AS d, max(rank) AS r FROM p JOIN s ON s.value = b GROUP BY 1, 2),
    g AS (SELECT a, sum(n)::BIGINT AS related, max(d) AS d, max(r) AS r, bool_or(type = 'geo_hint') AS geo FROM t GROUP BY 1),
    k AS (SELECT s.*, related, regexp_matches(value, '\\b(vs|versus|compare|comparison|alternative)\\b') AS compares, geo,
                 CASE WHEN related >= 2 AND d >= 2 THEN 'high' WHEN related >= 2 OR d >= 2 THEN 'medium' ELSE ['unknown', 'low', 'medium', 'high'][r + 1] END AS confidence FROM s JOIN g ON a = value),
    c AS (SELECT *, CASE WHEN type = 'demand_candidate' THEN 'supporting_page' WHEN type = 'serp_faq' THEN 'faq_page' WHEN type LIKE '%entity' THEN CASE WHEN geo THEN 'geo_page' ELSE 'entity_page' END
                         WHEN type = 'intent_opportunity' THEN CASE WHEN compares THEN 'comparison_page' ELSE 'supporting_page' END WHEN type = 'serp_heading' AND compares THEN 'comparison_page' END AS candidate_type FROM k)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    part, nation, k = read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size"), read(spark, d, "nation", "n_nationkey", "n_name"), F.col("p_partkey")
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("int")

    def rows(df, seq, kind, label, sure, diversity):
        return df.select(F.col(seq).cast("long").alias("seq"), F.lit(kind).alias("type"), label.alias("label"), sure.alias("confidence"), diversity.cast("int").alias("diversity"), F.array().cast("array<string>").alias("ids"))

    inputs = [rows(part, "p_partkey", "demand_candidate", F.col("p_name"), F.when(k % 4 == 0, "medium"), F.col("p_size") % 3), rows(part, "p_partkey", "serp_faq", F.concat(F.lit("Why "), "p_type", F.lit("?")), F.lit("low"), F.lit(1)),
              rows(part, "p_partkey", "knowledge_entity", F.split("p_name", " ")[1], F.lit("high"), F.lit(0)),
              rows(part, "p_partkey", "serp_heading", F.concat("p_type", F.when(k % 2 == 0, " alternative").otherwise("")), F.lit("unknown"), no_number),
              rows(part, "p_partkey", "intent_opportunity", F.concat("p_brand", F.lit(" -- "), F.when(k % 3 == 0, "versus").otherwise("price")), none, no_number),
              rows(nation, "n_nationkey", "serp_entity", F.concat("n_name", F.lit(" market")), F.lit("low"), F.lit(1)), rows(nation.where("n_nationkey % 2 = 0"), "n_nationkey", "geo_hint", F.col("n_name"), F.lit("low"), F.lit(1))]
    every = inputs[0]
    for more in inputs[1:]:
        every = every.unionByName(more)
    return x.expansion_candidates(staged(x.merged(every)))


@query(f"""{SIGNALS_SQL} SELECT type, value, candidate_type, candidate_type || ':' || regexp_replace(value, '\\s+', '-', 'g') AS key, label, related, confidence, CASE WHEN confidence IN ('medium', 'high') THEN 'candidate' ELSE 'needs_validation' END AS status,
           CASE WHEN confidence = 'low' THEN 'Candidate has limited supporting evidence and needs validation' END AS warning FROM c WHERE candidate_type IS NOT NULL""")
def d20_expansion_candidates(spark, d):
    return candidates(spark, d).drop("by_type")


@query(f"""{SIGNALS_SQL},
    q AS (SELECT *, CASE candidate_type WHEN 'faq_page' THEN 'FAQ' WHEN 'comparison_page' THEN 'Comparison' WHEN 'geo_page' THEN 'Geo' WHEN 'entity_page' THEN 'Entity' ELSE 'Supporting' END AS parent FROM c WHERE candidate_type IS NOT NULL),
    h AS (SELECT parent, count(*) AS children, ['unknown', 'low', 'medium', 'high'][max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) + 1] AS confidence FROM q GROUP BY 1),
    n AS (SELECT parent, t.type, sum(n)::BIGINT AS signals FROM q JOIN t ON t.a = q.value GROUP BY 1, 2)
    SELECT h.parent, children, confidence, CASE WHEN children = 1 THEN 'Cluster has one candidate and may need more evidence' END AS warning, n.type, signals FROM h JOIN n ON n.parent = h.parent""")
def d20_expansion_clusters(spark, d):
    return x.clusters(candidates(spark, d))


# Dimensions: nations are cities, types procedures, brands body parts, adjectives technologies, nouns questions, sizes comparisons that name a procedure.
DIMENSIONS_SQL = f"""
    WITH i AS (SELECT n_nationkey AS seq, 'city' AS type, n_name AS label, CASE WHEN n_nationkey % 5 > 0 THEN 'high' ELSE 'low' END AS confidence, 1 AS diversity, 'r' || (n_nationkey % 4) AS id FROM nation
        UNION ALL SELECT p_partkey, 'procedure', p_type, CASE WHEN p_partkey % 2 = 0 THEN 'medium' ELSE 'low' END, p_size, 'r' || (p_partkey % 3) FROM part WHERE p_type < 'S'
        UNION ALL SELECT p_partkey, 'body_part', p_brand, 'high', 2, CASE WHEN p_size % 9 < 2 THEN 'r' || (p_size % 9) ELSE 'b' || p_size END FROM part
        UNION ALL SELECT p_partkey, 'technology', split_part(p_name, ' ', 1), CASE WHEN p_partkey % 2 = 0 THEN 'medium' END, 1, 'b' || p_size FROM part
        UNION ALL SELECT p_partkey, 'faq', split_part(p_name, ' ', 2) || '?', 'medium', 1, 'r' || (p_partkey % 3) FROM part
        UNION ALL SELECT p_partkey, 'comparison', 'size ' || (p_size % 8) || ' vs', 'medium', 1, NULL FROM part),
    m AS (SELECT type, {NORMAL} AS value, arg_min(label, seq) AS label, max({RANKED}) AS rank, max(diversity)::INT AS diversity, count(*) AS signals, list_sort(list(DISTINCT id) FILTER (WHERE id IS NOT NULL)) AS ids FROM i GROUP BY 1, 2),
    named AS (SELECT DISTINCT trim(lower(p_type)) AS procedure, 'size ' || (p_size % 8) || ' vs' AS comparison FROM part WHERE p_partkey % 10 = 0 AND p_type < 'S')"""


def _rule_sql(order: int, rule: tuple) -> str:
    key, types, cap, sure, evidence, page = rule
    fit = lambda k: f"(SELECT * FROM m WHERE type = '{k}' AND signals >= {evidence / len(types)} AND rank >= {x.s.CONFIDENCE_RANK[sure]})"
    pair = lambda a, b: f"(list_has_any(v{a}.ids, v{b}.ids) OR (v{b}.type = 'comparison' AND EXISTS (SELECT 1 FROM named WHERE procedure = v{a}.value AND comparison = v{b}.value)))"
    on = " AND ".join(pair(a, b) for b in range(len(types)) for a in range(b))
    values = ", ".join(f"v{k}.value" for k in range(len(types)))
    many = lambda c: "[" + ", ".join(f"v{k}.{c}" for k in range(len(types))) + "]"
    return (f"SELECT * FROM (SELECT {order} AS ord, '{key}' AS rule, '{page}' AS page_type, {many('value')} AS vals, {many('label')} AS path, {many('rank')} AS ranks, {many('signals')} AS sigs FROM "
            + ", ".join(f"{fit(k)} v{n}" for n, k in enumerate(types)) + f" WHERE {on} ORDER BY {values} LIMIT {cap})")


TAIL_SQL = f"""{DIMENSIONS_SQL}, u AS ({" UNION ALL ".join(f"({_rule_sql(n, rule)})" for n, rule in enumerate(x.LONG_TAIL_RULES))}),
    c AS (SELECT *, row_number() OVER (ORDER BY ord, vals) AS n, array_to_string(vals, ' ') AS concept, ['unknown', 'low', 'medium', 'high'][list_min(ranks) + 1] AS confidence, list_sum(sigs)::BIGINT AS signals FROM u QUALIFY n <= 100)"""


def dimensions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part, nation, k, size = read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size"), read(spark, d, "nation", "n_nationkey", "n_name"), F.col("p_partkey"), F.col("p_size")

    def rows(df, seq, kind, label, sure, diversity, id_):
        return df.select(F.col(seq).cast("long").alias("seq"), F.lit(kind).alias("type"), label.alias("label"), sure.alias("confidence"), diversity.cast("int").alias("diversity"), F.array_compact(F.array(id_)).alias("ids"))

    of = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    compared, early = F.concat(F.lit("size "), size % 8, F.lit(" vs")), part.where("p_type < 'S'")
    every = rows(nation, "n_nationkey", "city", F.col("n_name"), F.when(F.col("n_nationkey") % 5 > 0, "high").otherwise("low"), F.lit(1), of("r", F.col("n_nationkey") % 4))
    for more in (rows(early, "p_partkey", "procedure", F.col("p_type"), F.when(k % 2 == 0, "medium").otherwise("low"), size, of("r", k % 3)),
                 rows(part, "p_partkey", "body_part", F.col("p_brand"), F.lit("high"), F.lit(2), F.when(size % 9 < 2, of("r", size % 9)).otherwise(of("b", size))),
                 rows(part, "p_partkey", "technology", F.split("p_name", " ")[0], F.when(k % 2 == 0, "medium"), F.lit(1), of("b", size)),
                 rows(part, "p_partkey", "faq", F.concat(F.split("p_name", " ")[1], F.lit("?")), F.lit("medium"), F.lit(1), of("r", k % 3)),
                 rows(part, "p_partkey", "comparison", compared, F.lit("medium"), F.lit(1), F.lit(None).cast("string"))):
        every = every.unionByName(more)
    named = early.where("p_partkey % 10 = 0").select(F.lit("procedure").alias("type_a"), F.trim(F.lower("p_type")).alias("value_a"), F.lit("comparison").alias("type_b"), compared.alias("value_b")).distinct()
    return staged(x.merged(every)), named


@query(f"{DIMENSIONS_SQL} SELECT type, value, label, rank, diversity, signals, coalesce(array_to_string(ids, ','), '') AS ids FROM m")
def a21_longtail_dimensions(spark, d):
    return dimensions(spark, d)[0].withColumn("ids", F.array_join(F.array_sort("ids"), ","))


@query(f"""{TAIL_SQL} SELECT n::INT AS n, rule, rule || ':' || regexp_replace(concept, '\\s+', '-', 'g') AS key, concept, array_to_string(path, ' ') AS label, page_type, confidence, CASE WHEN confidence IN ('medium', 'high') THEN 'candidate' ELSE 'needs_validation' END AS status, signals FROM c""")
def d21_longtail_candidates(spark, d):
    return x.long_tail(*dimensions(spark, d)).drop("root", "path")


@query(f"""{TAIL_SQL},
    w AS (SELECT path[1] AS root, n, unnest(path) AS label, generate_subscripts(path, 1) AS i FROM c), f AS (SELECT root, label, min((n, i)) AS first FROM w GROUP BY 1, 2),
    l AS (SELECT root, string_agg(label, ',' ORDER BY first) AS path_labels FROM f GROUP BY 1),
    t AS (SELECT path[1] AS root, count(*) AS children, sum(signals)::BIGINT AS signals, ['unknown', 'low', 'medium', 'high'][min(list_min(ranks)) + 1] AS confidence FROM c GROUP BY 1)
    SELECT 'tree:' || regexp_replace({NORMAL.replace('label', 't.root')}, '\\s+', '-', 'g') AS key, t.root, path_labels, children, signals, confidence, CASE WHEN children = 1 THEN 'Opportunity tree has one candidate and may need more evidence' END AS warning
    FROM t JOIN l ON l.root = t.root""")
def a21_opportunity_trees(spark, d):
    return x.opportunity_trees(staged(x.long_tail(*dimensions(spark, d)))).withColumn("path_labels", F.array_join("path_labels", ","))
