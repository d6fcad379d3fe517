"""Context and knowledge packs: what a retrieval found, arranged for a reader, for any number of packs at once.

results(pack, seq, chunk_id, source_url, canonical_url, domain, language, geo, heading_path, section_title, text, score) hold
what was retrieved for each pack, a few dozen rows each, seq being the order of arrival.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

URL = "coalesce(canonical_url, source_url)"


def sources(results: DataFrame) -> DataFrame:
    """pack, url, source_id, n, domain, language, geo: distinct urls, numbered in order of arrival; the first arrival's columns count."""
    first = results.groupBy("pack", F.expr(URL).alias("url")).agg(F.min(F.struct("seq", "domain", "language", "geo")).alias("f"))
    n = F.row_number().over(Window.partitionBy("pack").orderBy("f.seq"))  # the rows of one pack
    return first.select("pack", "url", n.alias("n"), F.concat(F.lit("source-"), n).alias("source_id"), "f.domain", "f.language", "f.geo")


def _with_sources(results: DataFrame, known: DataFrame) -> DataFrame:
    ids = known.select(F.col("pack").alias("__p"), F.col("url").alias("__u"), "source_id")
    return results.withColumn("url", F.expr(URL)).join(ids, (F.col("pack") == F.col("__p")) & F.col("url").eqNullSafe(F.col("__u"))).drop("__p", "__u")


def sections(results: DataFrame, known: DataFrame) -> DataFrame:
    """pack, n, heading_path, section_title, chunk_ids, source_ids, texts, score: results of one heading, best first; sections by their best."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "seq", "chunk_id", "source_id", "text")))
    title = F.coalesce("section_title", F.lit(""))
    g = _with_sources(results, known).groupBy("pack", "heading_path", title.alias("title")).agg(ranked.alias("r"), F.first("section_title").alias("section_title"), F.max("score").alias("score"))
    of = lambda name: F.transform("r", lambda x: x[name])
    n = F.row_number().over(Window.partitionBy("pack").orderBy(F.col("r")[0]["minus"], F.col("r")[0]["seq"]))
    return g.select("pack", n.alias("n"), "heading_path", "section_title", of("chunk_id").alias("chunk_ids"), F.array_distinct(of("source_id")).alias("source_ids"), of("text").alias("texts"), "score")


def faq_candidates(found: DataFrame) -> DataFrame:
    """Sections whose title or a heading asks: pack, n, chunk_id, question, source_ids."""
    asks = F.coalesce(F.col("section_title").contains("?"), F.lit(False)) | F.exists("heading_path", lambda h: F.contains(h, F.lit("?")))
    return found.where(asks).select("pack", "n", F.col("chunk_ids")[0].alias("chunk_id"), F.coalesce("section_title", F.try_element_at("heading_path", F.lit(-1))).alias("question"), "source_ids")


def _codes(*rules: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in order."""
    return F.filter(F.array(*[F.when(cond, code) for cond, code in rules]), lambda x: x.isNotNull())


def context_pack(packs: DataFrame, results: DataFrame) -> DataFrame:
    """packs(pack, degraded, asset_filter, knowledge_missing) -> one row for each, also where nothing was found: sections, sources,
    faq, outline, gaps."""
    known = sources(results)
    found = sections(results, known)
    in_order = lambda df, name, *cols: df.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("n", *cols))).alias(name))
    parts = [in_order(known, "sources", "source_id", "url", "domain", "language", "geo"), in_order(found, "sections", "heading_path", "section_title", "chunk_ids", "source_ids", "texts", "score"),
             in_order(found, "outline", "heading_path", "section_title", "source_ids"), in_order(faq_candidates(found), "faq", "chunk_id", "question", "source_ids")]
    out = reduce(lambda a, b: a.join(b, "pack", "left"), parts, packs)
    n = F.coalesce(F.size("sources"), F.lit(0))
    some = lambda f: F.coalesce(F.exists("sources", f), F.lit(False))
    domains = F.size(F.array_distinct(F.transform("sources", lambda s: F.coalesce(s["domain"], F.lit("")))))
    return out.withColumn("gaps", _codes(
        (F.col("knowledge_missing"), "knowledge_pack_unavailable"), (F.col("asset_filter"), "research_asset_filter_deferred"), (F.col("degraded"), "degraded_retrieval"), (n < 2, "few_sources"),
        ((n == 0) | (domains <= 1), "single_domain"), (some(lambda s: F.coalesce(s["language"], F.lit("")) == ""), "missing_language"), (some(lambda s: F.coalesce(F.size(s["geo"]), F.lit(0)) == 0), "missing_geo")))


def packed_facts(facts: DataFrame, results: DataFrame, known: DataFrame) -> DataFrame:
    """facts(fact_id, chunk_id, subject, object, predicate, attributes, confidence) of retrieved chunks, equal ones as one row per pack:
    pack, fact_id (of the surest), subject, object, predicate, attributes, confidence (mean), chunk_ids, source_ids (surest first).
    Facts are looked up by the packs' chunks; a fact belongs to every pack that holds its chunk."""
    chunks = _with_sources(results, known).select("pack", F.col("chunk_id").alias("__c"), "source_id").distinct()
    mine = chunks.join(facts, F.col("__c") == F.col("chunk_id"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("minus"), "fact_id", "chunk_id", "source_id")))
    g = mine.groupBy("pack", "subject", F.coalesce(F.col("object").cast("string"), F.lit("")).alias("object"), "predicate", "attributes").agg(ranked.alias("r"))
    of = lambda name: F.array_distinct(F.transform("r", lambda x: x[name]))
    mean = F.aggregate("r", F.lit(0.0), lambda a, x: a - x["minus"]) / F.size("r")
    return g.select("pack", F.col("r")[0]["fact_id"].alias("fact_id"), "subject", "object", "predicate", "attributes", mean.alias("confidence"), of("chunk_id").alias("chunk_ids"), of("source_id").alias("source_ids"))


def knowledge_facts(results: DataFrame, facts: DataFrame, trust: DataFrame, consensus: DataFrame) -> DataFrame:
    """The packed facts with trust(fact_id, final_confidence, flags) and consensus(fact_id, level, conflict) attached, surest first (n)."""
    rows = packed_facts(facts, results, sources(results)).join(trust, "fact_id", "left").join(consensus, "fact_id", "left")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("confidence"), "fact_id")))


def confidence_level(average: Column, facts: Column, found: Column) -> Column:
    return F.when(average.isNull() | (facts == 0), "unknown").when((average >= 0.8) & (found >= 2), "high").when(average >= 0.6, "medium").otherwise("low")


def knowledge_summary(packs: DataFrame, results: DataFrame, rows: DataFrame, aliases: DataFrame, ontology: DataFrame) -> DataFrame:
    """packs(pack, degraded) with the pack's confidence, counts and evidence gaps; rows are its knowledge_facts; aliases(subject,
    language) approved ones, of which the pack's language or none count (packs.language null: all); ontology(predicate)."""
    sure = F.round("confidence", 9).cast("decimal(18,9)")  # added exactly: the mean does not depend on the order of rows
    f = rows.groupBy("pack").agg(F.count(F.lit(1)).alias("fact_count"), F.avg(sure).cast("double").alias("average"), F.bool_or(F.size("chunk_ids") < 2).alias("weak"),
                                 F.bool_or(F.array_contains("flags", "possible_conflict_unresolved")).alias("open_conflict"))
    s = sources(results).groupBy("pack").agg(F.count(F.lit(1)).alias("source_count"), F.size(F.collect_set(F.coalesce("domain", F.lit("")))).alias("domains"))
    asked = packs.select("pack", F.col("language").alias("__l"))
    named = rows.select("pack", "subject").distinct().join(asked, "pack").join(aliases, "subject").where(F.col("__l").isNull() | F.col("language").isNull() | (F.col("language") == F.col("__l")))
    a = named.groupBy("pack").agg(F.count(F.lit(1)).alias("alias_count"))
    o = rows.select("pack", "predicate").distinct().join(ontology.select("predicate").distinct(), "predicate").groupBy("pack").agg(F.count(F.lit(1)).alias("ontology_count"))
    out = reduce(lambda x, y: x.join(y, "pack", "left"), [f, s, a, o], packs).fillna(0, ["fact_count", "source_count", "domains", "alias_count", "ontology_count"])
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = F.col("fact_count") > 0
    gaps = _codes((~some, "no_canonical_facts"), (yes("weak"), "weak_fact_support"), ((F.col("source_count") > 0) & (F.col("domains") <= 1), "single_source_support"),
                  (some & (F.col("alias_count") == 0), "missing_entity_aliases"), (some & (F.col("ontology_count") == 0), "missing_ontology_reference"), (F.col("degraded"), "retrieval_degraded"),
                  (yes("open_conflict"), "possible_conflict_unresolved"))
    return out.select("pack", confidence_level(F.col("average"), F.col("fact_count"), F.col("source_count")).alias("level"), "fact_count", "source_count", "average", "alias_count", gaps.alias("gaps"))
