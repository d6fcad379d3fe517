"""Topic expansion and long-tail discovery: signals and dimensions merged from inputs, candidates, clusters and opportunity trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as s
from tessera.functions import text as t
from tessera.operators.relational import combinations, contains_join

NAMES = ["unknown", "low", "medium", "high"]


def _named(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in NAMES]), rank.cast("int"))


def merged(inputs: DataFrame) -> DataFrame:
    """inputs(seq, type, label, confidence, diversity, ids array) -> type, value, label (the first), rank (of the best confidence),
    diversity, signals (how many inputs), ids. Values are normalised labels; empty ones are left out."""
    i = inputs.withColumn("value", t.normalize_concept(F.col("label"))).where("value <> ''")
    rank = s.confidence_rank(F.coalesce("confidence", F.lit("low")))
    out = i.groupBy("type", "value").agg(F.min_by("label", "seq").alias("label"), F.max(rank).alias("rank"), F.max("diversity").alias("diversity"), F.count(F.lit(1)).alias("signals"))
    ids = i.select("type", "value", F.explode("ids").alias("id")).groupBy("type", "value").agg(F.collect_set("id").alias("ids"))
    return out.join(ids, ["type", "value"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


PAGES = ["demand_candidate", "serp_faq", "knowledge_entity", "serp_entity", "intent_opportunity", "serp_missing_opportunity", "serp_heading"]


def expansion_candidates(signals: DataFrame) -> DataFrame:
    """merged() signals -> type, value, candidate_type, key, label, related (signals whose value contains it or lies in it, its own
    among them), confidence, status, warning, by_type (related signals of each type)."""
    values = signals.select("value").distinct()
    pairs = contains_join(values.withColumnRenamed("value", "a"), values.withColumnRenamed("value", "b"), "a", "b")
    other = signals.select(F.col("value").alias("b"), F.col("type").alias("__t"), F.col("rank").alias("__r"), F.coalesce("diversity", F.lit(0)).alias("__d"))
    per_type = pairs.join(other, "b").groupBy("a", "__t").agg(F.count(F.lit(1)).alias("n"), F.max("__d").alias("d"), F.max("__r").alias("r"))  # merges before it is shuffled
    near = per_type.groupBy("a").agg(F.sum("n").alias("related"), F.max("d").alias("d"), F.max("r").alias("r"), F.bool_or(F.col("__t") == "geo_hint").alias("geo"), F.map_from_entries(F.collect_list(F.struct("__t", "n"))).alias("by_type"))
    kind, compares = F.col("type"), t.is_comparison(F.col("value"))
    page = (F.when(kind.isin("demand_candidate", "serp_missing_opportunity"), "supporting_page").when(kind == "serp_faq", "faq_page")
            .when(kind.isin("knowledge_entity", "serp_entity"), F.when(F.col("geo"), "geo_page").otherwise("entity_page"))
            .when(kind == "intent_opportunity", F.when(compares, "comparison_page").otherwise("supporting_page")).when((kind == "serp_heading") & compares, "comparison_page"))
    sure = F.when((F.col("related") >= 2) & (F.col("d") >= 2), "high").when((F.col("related") >= 2) | (F.col("d") >= 2), "medium").otherwise(_named(F.col("r")))
    c = signals.where(kind.isin(PAGES)).join(near, F.col("value") == F.col("a")).withColumn("candidate_type", page).where("candidate_type is not null").withColumn("confidence", sure)
    low = F.when(F.col("confidence") == "low", "Candidate has limited supporting evidence and needs validation")
    return c.select("type", "value", "candidate_type", F.concat("candidate_type", F.lit(":"), F.regexp_replace("value", t.SPACE, "-")).alias("key"), "label", "related", "confidence",
                    F.when(F.col("confidence").isin("medium", "high"), "candidate").otherwise("needs_validation").alias("status"), low.alias("warning"), "by_type")


def clusters(candidates: DataFrame) -> DataFrame:
    """parent, children, confidence (the best), warning, type, signals: a row for each type of signal among a cluster's candidates."""
    parent = F.coalesce(s.lookup({"faq_page": "FAQ", "comparison_page": "Comparison", "geo_page": "Geo", "entity_page": "Entity"}, F.col("candidate_type")), F.lit("Supporting"))
    c = candidates.withColumn("parent", parent)
    heads = c.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), _named(F.max(s.confidence_rank(F.col("confidence")))).alias("confidence"))
    counts = c.select("parent", F.explode("by_type").alias("type", "n")).groupBy("parent", "type").agg(F.sum("n").alias("signals"))
    warning = F.when(F.col("children") == 1, "Cluster has one candidate and may need more evidence")
    return heads.withColumn("warning", warning).join(counts, "parent")


# Rule, dimension types, at most, least confidence, least evidence, page type.
LONG_TAIL_RULES = [
    ("city-procedure", ["city", "procedure"], 25, "medium", 2, "local_page"), ("city-procedure-body-part", ["city", "procedure", "body_part"], 25, "medium", 3, "local_page"),
    ("technology-body-part", ["technology", "body_part"], 20, "medium", 2, "supporting_page"), ("procedure-faq", ["procedure", "faq"], 20, "medium", 2, "faq_page"),
    ("procedure-comparison", ["procedure", "comparison"], 20, "medium", 2, "comparison_page")]


def long_tail(dimensions: DataFrame, compatible: DataFrame, *, rules: list = LONG_TAIL_RULES, degraded: bool = False, most: int = 100) -> DataFrame:
    """merged() dimensions and compatible(type_a, value_a, type_b, value_b) -> n, rule, key, concept, label, page_type, confidence,
    status, signals, root, path. Members fit together in pairs: they share an id, or one names the other. The first `most` of
    all rules, in the order of rules and values; a degraded run takes members of high confidence only."""
    link = F.concat_ws("\x00", "type_a", "value_a", "type_b", "value_b")
    named = compatible.select(F.col("type_a").alias("type"), F.col("value_a").alias("value"), link.alias("id")).unionByName(compatible.select(F.col("type_b").alias("type"), F.col("value_b").alias("value"), link.alias("id")))
    named = named.groupBy("type", "value").agg(F.collect_set("id").alias("__named"))
    dims = dimensions.join(named, ["type", "value"], "left").withColumn("links", F.concat("ids", F.coalesce("__named", F.array().cast("array<string>")))).drop("__named")
    if degraded:
        dims = dims.where(F.col("rank") == s.CONFIDENCE_RANK["high"])
    found = None
    for order, (rule, types, cap, sure, evidence, page) in enumerate(rules):
        fit = dims.where((F.col("signals") >= evidence / len(types)) & (F.col("rank") >= s.CONFIDENCE_RANK[sure]))
        chosen = combinations({f"v{k}": fit.where(F.col("type") == kind).select(F.col("value").alias("key"), F.col("links").alias("ids")) for k, kind in enumerate(types)}, "key", "ids", cap)
        rows = chosen.select(F.lit(order).alias("order"), F.lit(rule).alias("rule"), F.lit(page).alias("page_type"), F.array(*[F.lit(x) for x in types]).alias("types"), F.array(*[f"v{k}" for k in range(len(types))]).alias("values"))
        found = rows if found is None else found.unionByName(rows)
    first = found.orderBy("order", "values").limit(most)  # some hundred rows from here on
    first = first.withColumn("n", F.row_number().over(Window.orderBy("order", "values")))
    parts = first.select("n", F.posexplode(F.arrays_zip("types", "values")).alias("at", "x")).select("n", "at", F.col("x.types").alias("type"), F.col("x.values").alias("value"))
    known = parts.join(dims, ["type", "value"]).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("l"), F.min("rank").alias("rank"), F.sum("signals").alias("signals"))
    sure = F.lit("medium") if degraded else _named(F.col("rank"))
    labels = F.transform("l", lambda x: x["label"])
    concept = F.array_join("values", " ")
    return first.join(known, "n").select(
        "n", "rule", F.concat("rule", F.lit(":"), F.regexp_replace(t.normalize_concept(concept), t.SPACE, "-")).alias("key"), concept.alias("concept"), F.array_join(labels, " ").alias("label"), "page_type", sure.alias("confidence"),
        F.when(sure.isin("medium", "high"), "candidate").otherwise("needs_validation").alias("status"), "signals", labels[0].alias("root"), labels.alias("path"))


def opportunity_trees(candidates: DataFrame) -> DataFrame:
    """long_tail() candidates by the label of their first dimension: key, root, path_labels, children, signals, confidence (the
    lowest), warning."""
    heads = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("children"), F.sum("signals").alias("signals"), _named(F.min(s.confidence_rank(F.col("confidence")))).alias("confidence"))
    paths = candidates.select("root", "n", F.posexplode("path").alias("at", "label")).groupBy("root", "label").agg(F.min(F.struct("n", "at")).alias("first"))
    paths = paths.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "label"))), lambda x: x["label"]).alias("path_labels"))
    warning = F.when(F.col("children") == 1, "Opportunity tree has one candidate and may need more evidence")
    return reduce(lambda a, b: a.join(b, "root"), [heads, paths]).select(t.stable_key("tree", F.col("root")).alias("key"), "root", "path_labels", "children", "signals", "confidence", warning.alias("warning"))
