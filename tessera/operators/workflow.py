"""Steps between stored tables: frontier reevaluation, fact extraction outcomes, the gate before generation, reviews of enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring as s
from tessera.functions import text as t
from tessera.functions import web as w


def _first(array: Column, holds) -> Column:
    """The first element that holds, or null."""
    return F.get(F.filter(array, holds), F.lit(0))


def _glob(pattern: Column) -> Column:
    """The pattern of a path as a regular expression: only . ^ and $ are taken literally, * matches anything."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(pattern, "([.^$])", "\\\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))


def reevaluate(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """observations(id, topic, version, url, title, snippet, anchor) judged by their topic's configuration of that version.

    snapshots(topic, version, allowed, denied, included, excluded arrays; excluded_terms; required array of arrays; weighted
    array of (term, weight); adjustments array of (host, value); least, exploratory). -> id, topic, url, decision, reason, score,
    priority; decision is missing_snapshot where there is no such configuration. Snapshots are one row for each version of a
    topic and are met by an equi-join; their lists are read in place.
    """
    j = observations.join(snapshots.withColumn("__found", F.lit(True)), ["topic", "version"], "left")
    host, path = w.host_of(F.col("url")), w.path_of(F.col("url"))
    said = [F.when(F.col(c) != "", F.col(c)) for c in ("url", "title", "snippet", "anchor")]
    j = j.select("*", host.alias("__host"), path.alias("__path"), F.lower(F.concat_ws(" ", *said)).alias("__said"))
    has = lambda term: F.contains(F.col("__said"), term)
    matches = lambda p: F.rlike(F.col("__path"), _glob(p))
    gained = F.aggregate("weighted", F.lit(0.0), lambda a, x: a + F.when(has(x["term"]), x["weight"]).otherwise(0.0))
    moved = F.coalesce(_first(F.col("adjustments"), lambda x: x["host"] == F.col("__host"))["value"], F.lit(0.0))
    j = j.withColumn("__score", F.round(s.clamp01(0.5 + gained + moved), 9))
    lacking = F.exists("required", lambda group: ~F.exists(group, has))
    reason = (F.when(F.col("__found").isNull(), "missing_snapshot").when(F.array_contains("denied", F.col("__host")), "denied_host").when(~F.array_contains("allowed", F.col("__host")), "host_not_allowed")
              .when((F.size("included") > 0) & ~F.exists("included", matches), "path_not_included").when(F.exists("excluded", matches), "path_excluded").when(F.exists("excluded_terms", has), "excluded_term")
              .when(lacking, "missing_required_pre_crawl_evidence").when(F.col("__score") < F.col("least"), "below_minimum_score").otherwise("pre_crawl_evidence_matched"))
    j = j.withColumn("reason", reason)
    waits = (F.col("reason") == "missing_required_pre_crawl_evidence") & F.col("exploratory")
    decision = (F.when(F.col("reason") == "missing_snapshot", "missing_snapshot").when(F.col("reason") == "pre_crawl_evidence_matched", "accepted").when(waits, "insufficient_evidence").otherwise("rejected"))
    scored = F.col("reason").isin("pre_crawl_evidence_matched", "below_minimum_score")
    score = F.when(scored, F.col("__score")).when(waits | (F.col("reason") == "missing_snapshot"), F.lit(None).cast("double")).otherwise(0.0)
    j = j.withColumn("decision", decision).withColumn("score", score)
    priority = F.when(F.col("decision").isin("accepted", "insufficient_evidence"), s.frontier_priority(F.col("score"), F.lit(1), F.lit(0), F.lit(1.0))).when(F.col("decision") == "rejected", 0)
    return j.select("id", "topic", "url", "decision", "reason", "score", priority.alias("priority"))


def entries_of(evaluated: DataFrame) -> DataFrame:
    """Entry seeds by natural key, ready for an upsert: of several observations of one url the last id counts."""
    seeds = evaluated.where("decision <> 'missing_snapshot'")
    last = F.max(F.struct("id", "decision", "score", "priority")).alias("l")
    return seeds.groupBy("topic", "url").agg(last).select("topic", t.natural_id(F.col("topic"), F.col("url")).alias("url_hash"), "url", "l.decision", "l.score", "l.priority")


def normalization_attempts(candidates: DataFrame, aliases: DataFrame, *, least: float = 0.4, canonical: float = 0.6) -> DataFrame:
    """candidates(chunk_id, n, subject, predicate, object, attributes json, confidence) of the provider and aliases(alias,
    predicate_id) -> chunk_id, n, status, predicate_id, raw (a raw fact is stored), canonical (a canonical one too), reason.

    The first failing check of a candidate is its reason and keeps it from being stored; a stored one becomes canonical if its
    predicate resolves to one id and its confidence reaches `canonical`.
    """
    known = aliases.select(t.normalize_predicate(F.col("alias")).alias("__alias"), "predicate_id").groupBy("__alias").agg(F.count_distinct("predicate_id").alias("__n"), F.min("predicate_id").alias("predicate_id"))
    sure, plain = F.col("confidence"), F.coalesce(F.schema_of_variant(F.try_parse_json("attributes")).startswith("OBJECT"), F.lit(False))
    failed = (F.when(F.coalesce("subject", F.lit("")) == "", "Raw fact candidate is missing a known subject entity").when(F.trim(F.coalesce("predicate", F.lit(""))) == "", "Raw fact candidate is missing a predicate candidate")
              .when(F.col("object").isNull(), "Raw fact candidate is missing an object candidate").when(~plain, "Raw fact candidate attributes must be a JSON object")
              .when(sure.isNull() | F.isnan(sure) | (sure < 0) | (sure > 1), "Raw fact candidate confidence must be between 0 and 1").when(sure < least, "Raw fact candidate confidence is below the profile threshold"))
    j = candidates.withColumn("__failed", failed).withColumn("__name", t.normalize_predicate(F.col("predicate"))).join(known, F.col("__name") == F.col("__alias"), "left")
    raw = F.col("__failed").isNull()
    status = F.when(~raw, "pending_review").when(F.col("__n") == 1, "resolved").when(F.col("__n") > 1, "ambiguous").otherwise("unresolved")
    j = j.withColumn("raw", raw).withColumn("status", status).withColumn("canonical", raw & (status == "resolved") & (sure >= canonical))
    reason = F.coalesce("__failed", F.when(F.col("canonical"), None).when(F.col("status") == "resolved", "below_canonical_confidence").otherwise(F.concat(F.lit("predicate_"), "status")))
    return j.select("chunk_id", "n", "status", F.when(F.col("status") == "resolved", F.col("predicate_id")).alias("predicate_id"), "raw", "canonical", reason.alias("reason"))


def extraction_outcomes(chunks: DataFrame, attempts: DataFrame) -> DataFrame:
    """chunks(chunk_id, done, selected, provider) -> chunk_id, status, raw, canonical, rejected. done: a completed run of the same
    content exists; provider: ok, unavailable or error. Attempts count only where the provider was asked and answered."""
    g = attempts.groupBy("chunk_id").agg(F.count_if("raw").alias("raw"), F.count_if("canonical").alias("canonical"), F.count_if(~F.col("canonical")).alias("rejected"))
    status = F.when(F.col("done"), "already_processed").when(~F.col("selected"), "skipped").when(F.col("provider") == "unavailable", "provider_unavailable").when(F.col("provider") != "ok", "failed").otherwise("completed")
    j = chunks.withColumn("status", status).join(g, "chunk_id", "left")
    return j.select("chunk_id", "status", *[F.when(F.col("status") == "completed", F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c) for c in ("raw", "canonical", "rejected")])


def safeguard(has_pack: Column, has_fallback: Column, has_context: Column) -> Column:
    """struct(status, warning): whether structured context allows generation, or only raw retrieval is there."""
    status = F.when(has_pack, "structured_context_available").when(has_fallback, "supplemental_context_only").otherwise("blocked_raw_retrieval_only")
    warning = (F.when(has_pack, None).when(has_fallback, "SEO Pack is unavailable; structured fallback context is degraded.")
               .when(has_context, "Context Pack cannot be the only SEO generation context when structured SEO packs are missing.").otherwise("No structured SEO context is available for generation."))
    return F.struct(status.alias("status"), warning.alias("warning"))


def generation_contexts(requests: DataFrame) -> DataFrame:
    """requests(request, topic, objective, query, candidate_key, has_pack, pack_degraded, pack_warnings array, has_fallback,
    has_context, plan_key, plan_degraded, plan_warnings array, force_research, blocked) -> request, key, research, safeguard, state,
    blocked, warnings (distinct, in order)."""
    yes, empty = lambda c: F.coalesce(F.col(c), F.lit(False)), F.array().cast("array<string>")
    guard = safeguard(yes("has_pack"), yes("has_fallback"), yes("has_context"))
    planned = F.col("plan_key").isNotNull()
    research = F.when(planned, F.when(yes("plan_degraded"), "degraded").otherwise("satisfied")).otherwise(F.when(yes("force_research"), "requested").otherwise("required"))
    df = requests.select("*", guard.alias("__guard"), research.alias("research"))
    asked = F.when(planned, F.coalesce("plan_warnings", empty)).otherwise(F.array(F.lit("Focused Research must be requested before SEO generation.")))
    lacking = F.when(yes("has_pack"), F.coalesce("pack_warnings", empty)).otherwise(F.array(F.lit("SEO Pack is unavailable")))
    df = df.withColumn("warnings", F.array_distinct(F.concat(asked, F.array_compact(F.array("__guard.warning")), lacking)))
    stopped = F.col("__guard.status") == "blocked_raw_retrieval_only"
    state = F.when(yes("blocked") | stopped, "blocked").when((F.size("warnings") > 0) | (yes("has_pack") & yes("pack_degraded")), "degraded").otherwise("complete")
    return df.select("request", F.concat_ws(":", "topic", "objective", F.coalesce("candidate_key", "query")).alias("key"), "research", F.col("__guard.status").alias("safeguard"), state.alias("state"), (state == "blocked").alias("is_blocked"), "warnings")


# What the system message tells the generating agent.
SYSTEM = ["You are an SEO generation agent.", "Use only structured gateway context as the authoritative source.", "Do not generate SEO content from raw retrieval chunks alone.",
          "Preserve uncertainty and evidence gaps instead of inventing claims.", "Follow mandatory SERP intent and generation constraints."]


def prompt(sections: dict[str, Column]) -> Column:
    """A user message: each section's title and its lines as a list, `- none` for no lines; sections part by a blank line."""
    def one(title: str, lines: Column) -> Column:
        body = F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- none")
        return F.concat(F.lit(f"## {title}\n"), body)

    return F.concat_ws("\n\n", *[one(title, lines) for title, lines in sections.items()])


def reviewed(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """reviews(id, attempt, subject_type, provider, name, external_id, external_id_type, decision, reviewer) against the evidence of
    their attempt, candidates(attempt, seq, provider, name, external_id, external_id_type) -> id, outcome, evidence_seq.

    An external id needs provider, id and type; a candidate needs provider and name, and the id if one is given; the earliest
    match counts. Blank required fields, unknown attempts and missing evidence are errors and leave no decision.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    by_id = F.col("subject_type") == "external_id"
    problem = F.lit(None).cast("string")
    for field, needed in reversed([("attempt", F.lit(True)), ("provider", F.lit(True)), ("reviewer", F.lit(True)), ("external_id", by_id), ("external_id_type", by_id), ("name", ~by_id)]):
        problem = F.when(needed & blank(F.col(field).cast("string")), f"{field} is required").otherwise(problem)
    r = reviews.withColumn("__problem", problem).withColumn("__key", F.when(by_id, F.concat_ws("\x00", F.lit("i"), "external_id", "external_id_type")).otherwise(F.concat_ws("\x00", F.lit("n"), "name")))
    c = candidates.select(F.col("attempt").alias("__a"), F.col("provider").alias("__p"), "seq", F.col("external_id").alias("__x"), F.explode(F.array_compact(F.array(
        F.when(~blank(F.col("external_id")) & ~blank(F.col("external_id_type")), F.concat_ws("\x00", F.lit("i"), "external_id", "external_id_type")), F.concat_ws("\x00", F.lit("n"), "name")))).alias("__k"))
    c = c.groupBy("__a", "__p", "__k", "__x").agg(F.min("seq").alias("seq"))  # repeated evidence merges before it is joined
    known = candidates.select(F.col("attempt").alias("__ka")).distinct().withColumn("__known", F.lit(True))
    fits = (F.col("attempt") == F.col("__a")) & (F.col("provider") == F.col("__p")) & (F.col("__key") == F.col("__k")) & (by_id | blank(F.col("external_id")) | F.col("external_id").eqNullSafe(F.col("__x")))
    found = r.where("__problem is null").join(c, fits).groupBy("id").agg(F.min("seq").alias("evidence_seq"))
    j = r.join(found, "id", "left").join(known, F.col("attempt") == F.col("__ka"), "left")
    outcome = F.when(F.col("__problem").isNotNull(), F.col("__problem")).when(F.col("__known").isNull(), "attempt not found").when(F.col("evidence_seq").isNull(), "evidence not found").otherwise(F.col("decision"))
    return j.select("id", outcome.alias("outcome"), "evidence_seq")


def discovery_plans(topics: DataFrame, queries: DataFrame, sitemaps: DataFrame, seeds: DataFrame, search_provider: str = "default-search") -> DataFrame:
    """topics(topic, version, search, sitemap, seed: which sources are on; max_results), queries(topic, text, language, geo),
    sitemaps(topic, url), seeds(topic, rank, url) -> topic, version, source_type, provider, source_key, planning_key, urls: one run
    for each query and each sitemap, and one for all seeds of a topic. Keys follow from what is planned, so that planning
    again plans the same runs."""
    none = F.array().cast("array<string>")

    def runs(df, kind: str, provider: str, identity: list, urls: Column):
        on = topics.where(F.col(kind)).select(F.col("topic").alias("__t"), "version", "max_results")
        key = lambda *parts: t.natural_id(F.lit(kind), F.lit(provider), *parts)
        return df.join(on, F.col("topic") == F.col("__t")).select("topic", "version", F.lit(kind).alias("source_type"), F.lit(provider).alias("provider"), key(*identity).alias("source_key"), urls.alias("urls"))

    listed = seeds.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]).alias("urls"))  # a topic's configured list
    every = runs(queries, "search", search_provider, [F.col("text"), F.col("language"), F.col("geo"), F.col("max_results")], none).unionByName(
        runs(sitemaps, "sitemap", "sitemap", [F.col("url")], F.array("url"))).unionByName(runs(listed, "seed", "seed", [F.array_join("urls", "\x00")], F.col("urls")))
    return every.withColumn("planning_key", t.natural_id(F.col("topic"), F.col("version"), F.col("source_type"), F.col("source_key"), F.lit(1)))


def metric_observations(measured: DataFrame, keywords: DataFrame) -> DataFrame:
    """measured(keyword, provider, clicks, impressions) of a search-analytics source and keywords(keyword) -> keyword, provider,
    metric, value: clicks are traffic potential, impressions search volume, their ratio the trend; a keyword that nobody
    measured gets the fallback's rows without values."""
    m = measured.select("keyword", "provider", F.col("clicks").cast("double").alias("traffic_potential"), F.col("impressions").cast("double").alias("search_volume"), F.try_divide("clicks", "impressions").alias("trend"))
    rest = keywords.select("keyword").distinct().join(measured.select("keyword").distinct(), "keyword", "left_anti")
    rest = rest.select("keyword", F.lit("fallback").alias("provider"), *[F.lit(None).cast("double").alias(c) for c in ("traffic_potential", "search_volume", "trend")])
    return m.unionByName(rest).unpivot(["keyword", "provider"], ["traffic_potential", "search_volume", "trend"], "metric", "value")


def consolidate(commands: DataFrame, entries: DataFrame, policies: DataFrame) -> DataFrame:
    """commands(id, source, target_url): what a fetched page of entry `source` calls its canonical url; entries(entry, topic, url
    normalised), policies(topic, allowed, denied arrays of hosts, cross_host; same-host forbids another host, no list of allowed hosts allows all) -> id, status, reason,
    target_entry, relation (one is recorded), suppressed (the source entry that gives way to its target).

    Checks in order: the source exists, the target is a url, it is not the source itself, its host is neither denied nor outside
    the allowed ones, another host is allowed; then the target entry of the same topic, if there is one, takes over.
    """
    source = entries.select(F.col("entry").alias("source"), F.col("topic").alias("__topic"), F.col("url").alias("__from"))
    target = entries.groupBy(F.col("topic").alias("__tt"), F.col("url").alias("__tu")).agg(F.min("entry").alias("target_entry"))
    j = commands.join(source, "source", "left").withColumn("__to", w.normalize_url(F.col("target_url"))).join(policies.withColumnRenamed("topic", "__pt"), F.col("__topic") == F.col("__pt"), "left")
    j = j.join(target, (F.col("__topic") == F.col("__tt")) & (F.col("__to") == F.col("__tu")), "left")
    host, own = w.host_of(F.col("__to")), w.host_of(F.col("__from"))
    reason = (F.when(F.col("__from").isNull(), "source_entry_missing").when(F.col("__to").isNull(), "malformed_target_url").when(F.col("__to") == F.col("__from"), "self")
              .when(F.array_contains("denied", host), "target_denied_host").when(F.col("allowed").isNotNull() & ~F.array_contains("allowed", host), "target_host_not_allowed")
              .when((host != own) & (F.col("cross_host") == "same-host"), "cross_host_canonical_not_allowed").when(F.col("target_entry").isNull(), "target_entry_missing"))
    j = j.withColumn("__reason", reason)
    status = F.when(F.col("__reason").isNull(), "consolidated").when(F.col("__reason") == "self", "self_canonical").when(F.col("__reason") == "target_entry_missing", "recorded_unresolved").otherwise("rejected")
    done = status == "consolidated"
    return j.select("id", status.alias("status"), F.when(status != "self_canonical", F.col("__reason")).alias("reason"), F.when(status == "self_canonical", F.col("source")).when(done, F.col("target_entry")).alias("target_entry"),
                    (~status.isin("self_canonical") & (F.coalesce("__reason", F.lit("")) != "source_entry_missing")).alias("relation"), F.when(done, F.col("source")).alias("suppressed"))


REDIRECTS = [301, 302, 303, 307, 308]


def fetch_outcomes(requests: DataFrame, responses: DataFrame, staged, *, max_redirects: int, max_bytes: int) -> DataFrame:
    """requests(id, url) answered by responses(url, status, content_type, location, bytes), one for each url -> id, status, category,
    final_url, http_status, chain (the urls that redirected, in order).

    Redirects are followed by hand, all requests one hop at a time and each hop a join: every target must be a public http(s)
    host, a redirect beyond `max_redirects` or without a location is blocked, and whoever needs no further hop leaves. Then
    size and type are checked, and the status code is mapped.
    """
    answers = responses.select(F.col("url").alias("__u"), F.col("status").alias("http_status"), "content_type", "location", "bytes")
    going, out = requests.select("id", F.col("url").alias("final_url"), F.array().cast("array<string>").alias("chain")), None
    for hop in range(max_redirects + 1):
        j = going.join(answers, F.col("final_url") == F.col("__u"), "left")
        code, moved = F.col("http_status"), F.col("http_status").isin(REDIRECTS)
        kind = F.lower(F.coalesce("content_type", F.lit("")))
        page = (kind == "") | kind.contains("text/html") | kind.contains("application/xhtml+xml")
        unsafe = ~F.coalesce(F.lower("final_url").rlike("^https?://"), F.lit(False)) | w.is_unsafe_host(w.host_of(F.col("final_url")))
        lost = F.coalesce("location", F.lit("")) == ""
        category = (F.when(unsafe, "unsafe_target").when(code.isNull(), "connection_failure").when(moved & (F.lit(hop == max_redirects) | lost), "policy_redirect_blocked").when(moved, "next")
                    .when(F.col("bytes") > max_bytes, "content_too_large").when(~page, "unsupported_content_type").when(code == 429, "http_429").when(code >= 500, "http_5xx").when(code >= 400, "adapter_error"))
        j = staged(j.withColumn("category", category))
        done = j.where("category is null or category <> 'next'")
        out = done if out is None else out.unionByName(done)
        follow = F.when(F.col("location").startswith("/"), F.concat(w.origin_of(F.col("final_url")), "location")).otherwise(F.col("location"))
        going = j.where("category = 'next'").select("id", follow.alias("final_url"), F.array_append("chain", F.col("final_url")).alias("chain"))
        if not going.limit(1).count():
            break
    status = (F.when(F.col("category") == "unsafe_target", "blocked_by_policy").when(F.col("category").isin("connection_failure", "http_429", "http_5xx"), "failed_retryable").when(F.col("category").isNotNull(), "failed_terminal").otherwise("succeeded"))
    return out.select("id", status.alias("status"), "category", "final_url", "http_status", "chain")
