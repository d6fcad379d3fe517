"""Planning packs as joins and groupings: demand candidates and pages, intent packs, dispatch plans, page packs. Every input
carries the key of its topic, pack, job or request, so that all of them are planned together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as s
from tessera.functions import text as t

METRICS = ["volume", "difficulty", "cpc", "traffic"]


def keyword_candidates(observations: DataFrame, limit: int = 100) -> DataFrame:
    """observations(topic, seq, observed_text, provider, tier, evidence, metric_status, volume, difficulty, cpc, traffic,
    collected_at) -> topic, rank, keyword, confidence, metric_status, provider, metrics, evidence_count, only_fallback.

    Metrics come from a keyword's first provider-backed observation, else from its first one of own data. Only aggregates that
    merge are used, so a keyword with very many observations is not gathered.
    """
    o = observations.withColumn("keyword", t.normalize_keyword(F.col("observed_text"))).where("keyword <> ''")
    values = F.struct("seq", F.col("metric_status").alias("status"), "provider", *METRICS, "collected_at")
    first = lambda status: F.min(F.when(F.col("metric_status") == status, values))
    g = o.groupBy("topic", "keyword").agg(first("provider_backed").alias("p"), first("owned_data_backed").alias("o"), F.min_by("provider", "seq").alias("any"), F.size(F.collect_set("evidence")).alias("evidence_count"),
                                          F.bool_and(F.col("tier") == "fallback").alias("only_fallback"))
    m = F.coalesce("p", "o")
    c = g.select("topic", "keyword", F.coalesce(m["status"], F.lit("fallback_only")).alias("metric_status"), F.coalesce(m["provider"], "any").alias("provider"), *[m[x].alias(x) for x in METRICS],
                 m["collected_at"].alias("collected_at"), "evidence_count", "only_fallback")
    sure = F.when(F.col("metric_status") != "fallback_only", "high").when(F.col("evidence_count") >= 3, "medium").otherwise("low")
    order = Window.partitionBy("topic").orderBy(F.desc(s.confidence_rank(F.col("confidence"))), F.desc("evidence_count"), "keyword")
    return c.withColumn("confidence", sure).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def missing_metrics() -> Column:
    return s.missing_names({"searchVolume": F.col("volume"), "keywordDifficulty": F.col("difficulty"), "cpc": F.col("cpc"), "trafficPotential": F.col("traffic")})


def candidate_pages(candidates: DataFrame) -> DataFrame:
    """A page for each candidate with measured demand or two kinds of evidence: topic, keyword, slug, page_type, missing."""
    page = candidates.where((F.col("metric_status") != "fallback_only") | (F.col("evidence_count") >= 2))
    slug = F.concat(F.lit("/"), F.regexp_replace("keyword", t.SPACE, "-"), F.lit("/"))
    return page.select("topic", "keyword", slug.alias("slug"), F.when(F.col("keyword").contains(" vs "), "comparison").otherwise("guide").alias("page_type"), missing_metrics().alias("missing"))


def visibility(candidates: DataFrame, now: Column, stale_hours: float = 720.0) -> DataFrame:
    """topic, keyword, visibility: unknown_metrics, stale_metrics or fresh_metrics."""
    return candidates.select("topic", "keyword", s.metric_visibility(F.col("metric_status"), missing_metrics(), F.col("collected_at"), now, stale_hours).alias("visibility"))


def intents(packs: DataFrame, expectations: DataFrame, opportunities: DataFrame) -> DataFrame:
    """packs(pack, degraded, angle), expectations and opportunities(pack, label, kind, frequency, diversity, result) -> pack, n,
    key, label, frequency, diversity, kinds, evidence, results, confidence, depth, gap. Rows of one key (the label, normalised)
    merge: the largest counts, all kinds and results; expectations come before opportunities, the pack's angle last."""
    rows = lambda df, part, evidence: df.select("pack", "label", "kind", F.col("frequency").cast("long"), F.col("diversity").cast("long"), F.col("result").cast("string"), F.lit(part).alias("part"), F.lit(evidence).alias("evidence"))
    angle = packs.where("angle <> 'unknown'").select("pack", F.concat("angle", F.lit(" content angle")).alias("label"), F.lit("angle").alias("kind"), F.lit(1).alias("frequency"), F.lit(1).alias("diversity"), F.lit(None).alias("result"))
    every = rows(expectations, 0, "serp_expectation").unionByName(rows(opportunities, 1, "missing_opportunity")).unionByName(rows(angle, 2, "content_angle"))
    g = every.withColumn("key", t.normalize_concept(F.col("label"))).where("key <> ''").groupBy("pack", "key").agg(
        F.min(F.struct("part", "label"))["label"].alias("label"), F.max("frequency").alias("frequency"), F.max("diversity").alias("diversity"), F.sort_array(F.collect_set("kind")).alias("kinds"),
        F.sort_array(F.collect_set("evidence")).alias("evidence"), F.count_distinct("result").alias("results"))
    f, v = F.col("frequency"), F.col("diversity")
    sure = F.when((f >= 3) & (v >= 3), "high").when((f >= 2) & (v >= 2), "medium").when((f > 0) | (v > 0), "low").otherwise("unknown")
    g = g.withColumn("confidence", sure).join(packs.select("pack", "degraded"), "pack").withColumn("depth", s.intent_depth(f, v))
    g = g.withColumn("gap", s.intent_gap(f, v, F.col("confidence"), F.col("kinds"), F.col("evidence"), F.col("degraded")))
    return g.withColumn("n", F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("diversity"), F.desc("frequency"), "key")))


def intent_pack(packs: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each pack: the intents of each kind of gap in order, and warnings."""
    of = lambda gap: F.transform(F.array_sort(F.collect_list(F.when(F.col("gap") == gap, F.struct("n", "label")))), lambda x: x["label"])
    g = found.groupBy("pack").agg(*[of(gap).alias(gap) for gap in ("must_cover", "recommended", "opportunity", "monitor")])
    none = F.when(F.col("must_cover").isNull(), F.array(F.lit("SERP Intent Pack built without intent candidates"))).otherwise(F.array().cast("array<string>"))
    return packs.join(g, "pack", "left").withColumn("warnings", none)


# The priority of a trigger, the objectives that need discovery.
TRIGGER_PRIORITY = {
    "generation_request": "highest", "user_waiting_for_generation": "highest", "manual_research": "high", "competitor_refresh_requested": "high", "scheduled_serp_refresh": "medium",
    "topic_expansion_candidate": "medium", "recently_discovered_keyword": "medium", "new_discovery_observation": "medium", "stale_page_recrawl": "low", "sitemap_refresh": "low",
    "entity_expansion_background": "low", "background_growth": "low", "scheduled_demand_refresh": "medium", "scheduled_planning_pack_refresh": "medium"}
DISCOVERY = ["generate_page", "generate_page_brief", "generate_content_cluster", "generate_local_seo_page", "generate_comparison_page", "research_topic", "research_query", "research_competitor", "background_growth"]


def priority(mode: Column, trigger: Column) -> Column:
    """The trigger's priority; in the background at most medium; none for a trigger that nobody knows."""
    known = s.lookup(TRIGGER_PRIORITY, trigger, "none")
    return F.when((mode == "background") & known.isin("highest", "high"), "medium").otherwise(known)


def freshness(assets: DataFrame, now: Column, ttl_hours: float) -> DataFrame:
    """assets(job, asset, seen_at, snapshot_at, content, entity, ontology, policy) -> job, asset, reasons, status, crawl, process, serp."""
    r = s.freshness_reasons(s.ttl_expired(F.col("seen_at"), now, ttl_hours), F.col("snapshot_at").isNull(), F.col("content"), F.col("entity"), F.col("ontology"), F.col("policy"))
    df = assets.select("job", "asset", r.alias("reasons"), (F.col("policy") | F.col("ontology") | F.col("entity") | F.col("content")).alias("forced"))
    any_of = lambda *names: F.arrays_overlap("reasons", F.array(*[F.lit(n) for n in names]))
    return df.select("job", "asset", "reasons", s.freshness_status(F.col("reasons"), F.col("forced")).alias("status"), any_of("ttl_expired", "content_changed", "policy_changed").alias("crawl"),
                     any_of("content_changed", "ontology_updated", "entity_missing").alias("process"), any_of("serp_changed").alias("serp"))


def dispatch_plan(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """jobs(job, topic, mode, trigger, objective) -> job, n, target, priority, force: the commands of each job, in order."""
    d = decisions.groupBy("job").agg(*[F.bool_or(c).alias(c) for c in ("serp", "crawl", "process")])
    j = jobs.join(d, "job", "left").withColumn("priority", priority(F.col("mode"), F.col("trigger"))).where("priority <> 'none'")
    yes, goal = lambda c: F.coalesce(F.col(c), F.lit(False)), F.col("objective")
    packs = goal.isin("refresh_planning_packs", "refresh_seo_pack")
    wanted = [(goal.isin(DISCOVERY), "discovery_sources"), (goal == "refresh_demand_metrics", "demand_engine"), (packs, "seo_pack"), (yes("serp"), "serp_intelligence"), (yes("crawl"), "url_frontier"),
              (yes("process"), "content_processing"), (yes("process"), "knowledge_pipeline"), ((F.col("mode") == "focused") & ~packs, "seo_pack")]
    targets = F.array_compact(F.array(*[F.when(cond, target) for cond, target in wanted]))
    return j.select("job", "topic", "objective", "priority", (F.col("trigger") == "manual_research").alias("force"), F.posexplode(targets).alias("n", "target"))


# What a page of each profile is for.
PURPOSE = {
    "landing_page": "Convert qualified search demand with concise proof.", "guide": "Explain the topic comprehensively with sourced facts.", "faq_page": "Answer recurring questions with evidence-backed responses.",
    "comparison_page": "Compare alternatives using explicit criteria.", "local_page": "Cover local intent, geo constraints and service relevance.", "entity_page": "Explain a canonical entity and its relationships.",
    "supporting_page": "Support a broader topic cluster with focused depth.", "update_existing": "Refresh an existing page with missing evidence and intents."}


class PagePack:
    """The parts of page packs from the packs they build on; every input has the column request, and lists are short per request.

    requests(request, topic, candidate_key, candidate_label, recommended_type, profile, keyword, language, geo, degraded, lacks
    array of pack names), entities(label, entity_id), facts(fact_id, statement, confidence, conflict, source_ids),
    intents(seq, intent_id, label, priority, confidence, question), headings(seq, heading, frequency), questions(seq, question,
    confidence) of results pages, tail(seq, question) of the long tail, labels(seq, label) of related topics.
    """

    def __init__(self, requests: DataFrame, entities: DataFrame, facts: DataFrame, intents: DataFrame, headings: DataFrame, questions: DataFrame, tail: DataFrame, labels: DataFrame):
        self.requests = requests.withColumn("page_type", F.coalesce("profile", "recommended_type", F.lit("guide")))
        weak = F.col("conflict") | F.col("confidence").isin("unknown", "low")
        self.facts, self.entities, self.intents, self.headings, self.questions, self.tail, self.labels = facts.withColumn("weak", weak), entities, intents, headings, questions, tail, labels

    @staticmethod
    def _listed(df: DataFrame, order: list[str], **columns: Column) -> DataFrame:
        """One row per request: for each name the values in order, nulls left out."""
        keyed = [F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(*order, c.alias("v"))))), lambda x: x["v"]).alias(name) for name, c in columns.items()]
        return df.groupBy("request").agg(*keyed)

    def evidence(self) -> DataFrame:
        """request, fact_ids, known_ids, refs (source ids of the facts in order), weak, conflicts, entity_ids."""
        f = self._listed(self.facts, ["fact_id"], fact_ids=F.col("fact_id"), known_ids=F.when(F.col("confidence") != "unknown", F.col("fact_id")), refs=F.col("source_ids"),
                         weak=F.when(F.col("weak"), F.col("statement")), conflicts=F.when(F.col("conflict"), F.col("statement")))
        e = self._listed(self.entities, ["label", "entity_id"], entity_ids=F.col("entity_id"))
        out = self.requests.select("request").join(f, "request", "left").join(e, "request", "left")
        return out.select("request", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("fact_ids", "known_ids", "weak", "conflicts", "entity_ids")],
                          F.flatten(F.coalesce("refs", F.array().cast("array<array<string>>"))).alias("refs"))

    def outline(self, most: int = 12) -> DataFrame:
        """request, n, key, heading, purpose, intent_ids, entity_ids, fact_ids, refs, confidence, warning: an overview, a section for
        each mandatory or opportunity intent, one for each recurring heading; the first of a key, `most` at most."""
        ev = self.evidence()
        mapped = self._listed(self.intents, ["seq"], ids=F.when(F.col("priority").isin("mandatory", "recommended"), F.col("intent_id")))
        nothing, none = F.array().cast("array<string>"), F.lit(None).cast("string")

        def rows(df, part, seq, key, heading, purpose, ids, entities, facts, refs, sure, warning):
            return df.select("request", F.lit(part).alias("part"), seq.cast("long").alias("seq"), key.alias("key"), heading.alias("heading"), purpose.alias("purpose"), ids.alias("intent_ids"),
                             entities.alias("entity_ids"), facts.alias("fact_ids"), refs.alias("refs"), sure.alias("confidence"), warning.alias("warning"))

        bare = F.size("fact_ids") == 0
        over = self.requests.join(ev, "request").join(mapped, "request", "left")
        first = rows(over, 0, F.lit(0), F.lit("overview"), t.title_case(F.coalesce("keyword", "candidate_key")), s.lookup(PURPOSE, F.col("page_type")), F.coalesce("ids", nothing), F.slice("entity_ids", 1, 5),
                     F.slice("fact_ids", 1, 5), F.slice("refs", 1, 5), F.when(bare, "low").otherwise("medium"), F.when(bare, "Outline built without Knowledge Pack facts"))
        must = F.col("priority") == "mandatory"
        second = rows(self.intents.where("priority in ('mandatory', 'opportunity')").join(ev, "request"), 1, F.col("seq"), F.concat(F.lit("intent:"), "intent_id"), t.title_case(F.col("label")),
                      F.when(must, "Cover a mandatory SERP intent.").otherwise("Cover an opportunity intent when evidence supports it."), F.array("intent_id"), nothing, F.slice("known_ids", 1, 3), nothing,
                      F.coalesce("confidence", F.lit("unknown")), none)
        third = rows(self.headings, 2, F.col("seq"), F.concat(F.lit("serp-heading:"), t.slug(F.col("heading"))), t.title_case(F.col("heading")), F.lit("Reflect a recurring SERP heading theme."), nothing, nothing, nothing, nothing,
                     F.when(F.col("frequency") > 1, "medium").otherwise("low"), none)
        return self._first(first.unionByName(second).unionByName(third), "key").where(F.col("n") <= most)

    @staticmethod
    def _first(rows: DataFrame, key: str) -> DataFrame:
        """The first row of each key, numbered in order."""
        kept = rows.withColumn("__k", F.row_number().over(Window.partitionBy("request", key).orderBy("part", "seq"))).where("__k = 1").drop("__k")
        return kept.withColumn("n", F.row_number().over(Window.partitionBy("request").orderBy("part", "seq")))

    def faq(self) -> DataFrame:
        """request, n, question, intent_id, priority, confidence, fact_ids."""
        ev = self.evidence().select("request", F.slice("fact_ids", 1, 3).alias("fact_ids"))
        row = lambda df, part, intent, prio, sure, facts: df.select("request", F.lit(part).alias("part"), F.col("seq").cast("long").alias("seq"), "question", intent.alias("intent_id"), prio.alias("priority"), sure.alias("confidence"), facts.alias("fact_ids"))
        none, unknown = F.lit(None).cast("string"), F.lit("unknown")
        parts = [row(self.questions.join(ev, "request"), 0, none, F.lit("recommended"), F.coalesce("confidence", unknown), F.col("fact_ids")),
                 row(self.intents.where("question <> ''").join(ev, "request"), 1, F.col("intent_id"), F.col("priority"), F.coalesce("confidence", unknown), F.col("fact_ids")),
                 row(self.tail, 2, none, F.lit("opportunity"), F.lit("low"), F.array().cast("array<string>"))]
        return self._first(reduce(DataFrame.unionByName, parts), "question")

    def constraints(self) -> DataFrame:
        """request, n, code, detail, blocking: facts by id, then intents, then language and place."""
        conflict, weak = F.col("conflict"), F.col("weak")
        code = F.when(conflict, "resolve_conflict_before_claim").when(weak, "do_not_assert_weak_fact").otherwise("cite_required_fact")
        told = F.when(conflict, "Resolve conflict before asserting: ").when(weak, "Do not assert weak fact without more evidence: ").otherwise("Cite required fact: ")
        must = F.col("priority") == "mandatory"
        row = lambda df, part, seq, c, detail, blocks: df.select("request", F.lit(part).alias("part"), seq.cast("string").alias("seq"), c.alias("code"), detail.alias("detail"), blocks.alias("blocking"))
        parts = [row(self.facts, 0, F.col("fact_id"), code, F.concat(told, "statement"), conflict),
                 row(self.intents.where("priority in ('mandatory', 'opportunity')"), 1, F.lpad(F.col("seq").cast("string"), 10, "0"), F.when(must, "cover_required_intent").otherwise("consider_opportunity_intent"),
                     F.concat(F.when(must, "Cover required intent: ").otherwise("Consider opportunity intent: "), "label"), F.lit(False)),
                 row(self.requests.where("coalesce(language, '') <> '' or coalesce(geo, '') <> ''"), 2, F.lit(""), F.lit("respect_language_geo"), F.lit("Respect requested language and geographic context."), F.lit(False))]
        return reduce(DataFrame.unionByName, parts).withColumn("n", F.row_number().over(Window.partitionBy("request").orderBy("part", "seq")))

    def header(self) -> DataFrame:
        """request, pack_key, page_type, title, audience, primary_intent, secondary_intents, links, weak, conflicts, warnings, degraded."""
        rank = F.when(F.col("priority") == "mandatory", 0).when(F.col("priority") == "recommended", 1).otherwise(2)
        main = self.intents.groupBy("request").agg(F.min(F.struct(rank.alias("rank"), "seq", "intent_id", "label")).alias("main"))
        others = self._listed(self.intents.join(main, "request").where("intent_id <> main.intent_id"), ["seq"], secondary=F.col("label"))
        links = self._listed(self.labels.withColumn("k", F.row_number().over(Window.partitionBy("request").orderBy("seq"))).where("k <= 8"), ["seq"], links=F.lower("label"))
        thin = self.outline().where("warning is not null").select("request").distinct().withColumn("thin", F.lit(True))
        out = reduce(lambda a, b: a.join(b, "request", "left"), [self.evidence(), main, others, links, thin], self.requests)
        empty = F.array().cast("array<string>")
        return out.select(
            "request", F.concat_ws(":", "topic", "candidate_key", "page_type").alias("pack_key"), "page_type", F.coalesce("candidate_label", "keyword", "candidate_key").alias("title"),
            F.when(F.col("page_type") == "local_page", "Local searchers").alias("audience"), F.col("main.label").alias("primary_intent"), F.coalesce("secondary", empty).alias("secondary_intents"),
            F.coalesce("links", empty).alias("links"), "weak", "conflicts", F.transform("lacks", lambda p: F.concat(F.lit("SEO Pack built without "), p)).alias("warnings"),
            (F.col("degraded") | (F.size("lacks") > 0) | (F.size("weak") > 0) | F.coalesce("thin", F.lit(False))).alias("degraded"))
