"""Scores, bands and decisions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import has_word


def js_round(c: Column) -> Column:
    """Rounds half up, also below zero."""
    return F.floor(c + 0.5)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def clamp01(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def round4(c: Column) -> Column:
    return F.floor(c * 1e4 + 0.5) / 1e4


def clamp4(c: Column) -> Column:
    """Four decimals, within 0 and 1."""
    return clamp01(round4(c))


def frontier_priority(relevance: Column, observations: Column, retries: Column, freshness: Column, topic: Column | None = None, operator: Column | None = None) -> Column:
    """Components and their sum, clamped to -1000..1000."""
    rel = js_round(clamp01(F.coalesce(relevance, F.lit(0.25))) * 400)
    fresh = js_round(clamp01(freshness) * 250)
    seen = js_round(F.least(F.greatest(observations, F.lit(0)), F.lit(10)) / 10 * 150)
    retry = -F.least(F.greatest(retries, F.lit(0)), F.lit(5)) * 40
    adjust = clamp(js_round(F.coalesce(topic if topic is not None else F.lit(0), F.lit(0))), -100, 100)
    operate = clamp(js_round(F.coalesce(operator if operator is not None else F.lit(0), F.lit(0))), -500, 500)
    return clamp(rel + fresh + seen + retry + adjust + operate, -1000, 1000).cast("int")


# Weights of vector, keyword, metadata, heading, topic, language, geo, chunk type, diversity.
RANKING_PROFILES = {
    "balanced": (0.35, 0.25, 0.10, 0.08, 0.08, 0.05, 0.06, 0.03, 0.0),
    "semantic": (0.55, 0.15, 0.08, 0.06, 0.06, 0.04, 0.04, 0.02, 0.0),
    "keyword_strict": (0.15, 0.45, 0.08, 0.14, 0.07, 0.04, 0.04, 0.03, 0.0),
    "local_geo": (0.25, 0.20, 0.10, 0.07, 0.08, 0.05, 0.20, 0.05, 0.0),
    "exploration": (0.25, 0.20, 0.10, 0.08, 0.08, 0.05, 0.06, 0.03, 0.15),
}


def weighted(profile: str, *components: Column) -> Column:
    return sum((c * w for c, w in zip(components, RANKING_PROFILES[profile], strict=True)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# Trust by source type.
TRUST_BASE = {
    "official_documentation": 0.9, "government": 0.95, "manufacturer": 0.85, "vendor": 0.72, "news": 0.65, "wiki_reference": 0.62,
    "forum_community": 0.42, "user_generated": 0.35, "marketplace": 0.58, "affiliate": 0.38, "unknown": 0.45,
}
# Fixed values, first match wins: type, confidence, words that stand alone, other patterns.
SOURCE_RULES = [
    ("government", 0.95, None, "\\.gov(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])gov\\."),
    ("official_documentation", 0.85, "official", "(?<![A-Za-z0-9_])docs?\\.|/docs?/"),
    ("wiki_reference", 0.8, "wiki", "(?<![A-Za-z0-9_])wikipedia\\."),
    ("forum_community", 0.75, "forum|community", "(?<![A-Za-z0-9_])reddit\\."),
    ("marketplace", 0.7, "shop|marketplace|product", None),
    ("news", 0.7, "news|article|press", None),
    ("affiliate", 0.65, "affiliate|best|review", None),
]


def source_type(text: Column, reviewed: Column | None = None) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, _, words, pattern in SOURCE_RULES:
        hit = F.lit(False)
        if words:
            hit = hit | has_word(low, words)
        if pattern:
            hit = hit | low.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    out = out.otherwise("unknown")
    return out if reviewed is None else F.coalesce(reviewed, out)


def lookup(table: dict, c: Column, default=None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def source_trust(kind: Column, incomplete: Column, warnings: Column) -> Column:
    base = lookup(TRUST_BASE, kind, 0.45)
    base = base - F.when(incomplete, 0.06).otherwise(0.0) - F.least(F.coalesce(warnings, F.lit(0)), F.lit(3)) * 0.04
    return clamp4(base - F.when(kind == "forum_community", 0.08).otherwise(0.0) - F.when(kind == "affiliate", 0.12).otherwise(0.0))


def fact_confidence(extraction: Column, normalization: Column, evidence: Column, trust: Column) -> Column:
    return clamp4(extraction * 0.3 + F.coalesce(normalization, extraction) * 0.25 + evidence * 0.3 + F.coalesce(trust, F.lit(0.45)) * 0.15)


def evidence_strength(chunks: Column, documents: Column, domains: Column, trust: Column, conflict: Column) -> Column:
    boost = F.least(F.lit(0.24), chunks * 0.06) + F.least(F.lit(0.24), documents * 0.08) + F.least(F.lit(0.24), domains * 0.08)
    return clamp4(F.lit(0.28) + boost + F.coalesce((trust - 0.5) * 0.28, F.lit(0.0)) - F.when(conflict, 0.18).otherwise(0.0))


def entity_score(confidence: Column, alias: Column, mentions: Column, documents: Column, domains: Column, trust: Column) -> Column:
    diversity = clamp4(F.least(F.lit(1.0), documents * 0.12) + F.least(F.lit(1.0), domains * 0.18))
    support = clamp4(F.least(F.lit(1.0), mentions * 0.05))
    return clamp4(confidence * 0.35 + F.coalesce(alias, confidence) * 0.2 + support * 0.15 + diversity * 0.15 + F.coalesce(trust, F.lit(0.45)) * 0.15)


def support_score(facts: Column, domains: Column, trust: Column, evidence: Column) -> Column:
    return clamp4(F.least(F.lit(0.35), facts * 0.1) + F.least(F.lit(0.25), domains * 0.1) + F.coalesce(trust, F.lit(0.45)) * 0.2 + F.coalesce(evidence, F.lit(0.45)) * 0.2)


def consensus_level(facts: Column, domains: Column, support: Column) -> Column:
    return (F.when(facts == 0, "unknown").when((facts >= 3) & (domains >= 2) & (support >= 0.65), "strong")
            .when((facts >= 2) & (support >= 0.5), "moderate").otherwise("weak"))


def stable_jitter(c: Column) -> Column:
    """31-polynomial of the characters modulo 2^32, divided by 2^32 - 1."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: (h * 31 + x) % F.lit(4294967296)) / F.lit(4294967295.0)


def retry_delay_ms(failures: Column, seed: Column, base_ms: float = 300_000.0, most_ms: float = 21_600_000.0, jitter: float = 0.1) -> Column:
    delay = F.lit(base_ms) * F.pow(F.lit(2.0), failures)
    return F.least(F.lit(most_ms), F.floor(delay + delay * jitter * stable_jitter(seed) + 0.5))


def recrawl_hours(interval: Column, change: Column, least: float = 24.0, most: float = 720.0) -> Column:
    factor = F.when(change == "changed", 0.5).when(change == "unchanged", 1.5).otherwise(1.0)
    return clamp(interval * factor, least, most)


def intent_depth(frequency: Column, diversity: Column) -> Column:
    return (F.when((frequency == 0) & (diversity == 0), "unknown").when((frequency >= 3) | (diversity >= 3), "deep")
            .when((frequency >= 2) | (diversity >= 2), "moderate").otherwise("shallow"))


def signal_confidence(signals: Column, diversity: Column, strongest: Column) -> Column:
    return F.when((signals >= 2) & (diversity >= 2), "high").when((signals >= 2) | (diversity >= 2), "medium").otherwise(strongest)


CONFIDENCE_RANK = {"unknown": 0, "low": 1, "medium": 2, "high": 3}


def confidence_rank(c: Column) -> Column:
    return lookup(CONFIDENCE_RANK, c)


def confidence_band(mean_rank: Column) -> Column:
    return F.when(mean_rank >= 2.5, "high").when(mean_rank >= 1.5, "medium").when(mean_rank > 0, "low").otherwise("unknown")


def downgrade(c: Column) -> Column:
    return F.when(c == "high", "medium").when(c == "medium", "low").otherwise(c)


def score_band(c: Column) -> Column:
    return F.when(c >= 70, "high").when(c >= 40, "medium").otherwise("low")


def alert_severity(observed: Column, threshold: Column) -> Column:
    return F.when(observed > threshold * 2, "critical").when(observed > threshold, "warning")


def intent_gap(frequency: Column, diversity: Column, confidence: Column, kinds: Column, evidence: Column, degraded: Column, *, least_diversity: int = 2, least_frequency: int = 2,
               least_confidence: str = "medium") -> Column:
    only_entities = (F.size(kinds) > 0) & F.forall(kinds, lambda k: k == "entity")
    must = ~only_entities & (diversity >= least_diversity) & (frequency >= least_frequency) & (confidence_rank(confidence) >= CONFIDENCE_RANK[least_confidence])
    depth = intent_depth(frequency, diversity)
    return (F.when(must, F.when(degraded, "recommended").otherwise("must_cover")).when(F.array_contains(evidence, "missing_opportunity"), "opportunity")
            .when(depth == "moderate", "recommended").when(depth == "shallow", "opportunity").otherwise("monitor"))


def page_type(hint: Column, faq_gap: Column, concept: Column, has_geo: Column) -> Column:
    return F.coalesce(hint, F.when(faq_gap >= 60, "faq_page").when(concept.contains(" vs "), "comparison_page").when(has_geo, "local_page").otherwise("supporting_page"))


def metric_visibility(status: Column, missing: Column, collected: Column, now: Column, stale_hours: float = 720.0) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(collected)) / 3.6e9
    return (F.when(status.isin("unknown", "fallback_only") | (F.size(missing) > 0), "unknown_metrics")
            .when(collected.isNull() | (age > stale_hours), "stale_metrics").otherwise("fresh_metrics"))


def missing_names(metrics: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in metrics.items()]))


def media_decision(kind: Column, mode: Column, potential: Column, requested: Column, allowed: list[str] | None = None) -> Column:
    barred = ~kind.isin(allowed) if allowed else F.lit(False)
    return (F.when(barred, "metadata_only").when(mode == "full_archive", "archive_allowed")
            .when((mode == "selected") & (requested | (F.coalesce(potential, F.lit(0.0)) >= 0.7)), "selected_for_download").otherwise("metadata_only"))


CHUNK_RULES = [  # fixed values: words of the rules below
    ("faq", "faq|questions|q&a"), ("comparison", "compare|comparison|versus"), ("review", "review|rating|pros|cons"),
    ("conclusion", "conclusion|summary|final thoughts"), ("local_section", "city|near me|local|address|location"),
]


def chunk_type(text: Column, heading: Column, index: Column, total: Column) -> Column:
    """Type of a chunk; `heading` is the heading path joined with spaces, null for none."""
    low = F.lower(F.concat(F.coalesce(heading, F.lit("")), F.lit(" "), text))
    rules = dict(CHUNK_RULES)
    return (
        F.when(text.contains("?") | has_word(low, rules["faq"]), "faq")
        .when(text.rlike("(?m)^\\s*\\|.+\\|\\s*$"), "table").when(text.rlike("(?m)^\\s*([-*]|[0-9]+\\.)\\s+"), "list")
        .when(has_word(low, rules["comparison"]) | low.rlike(" vs\\.? "), "comparison").when(has_word(low, rules["review"]), "review")
        .when(index == 0, "intro").when((total > 1) & (index == total - 1) & has_word(low, rules["conclusion"]), "conclusion")
        .when(has_word(low, rules["local_section"]), "local_section").when(heading.isNotNull(), "section").otherwise("unknown"))


# Longest chunk and overlap, in tokens.
CHUNK_PROFILES = {"short_seo_page": (260, 30), "long_guide": (420, 60), "review": (340, 45), "forum": (220, 25), "default": (320, 40)}


def chunk_profile(text: Column, words: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.when(has_word(low, "review|rating|pros|cons"), "review").when(has_word(low, "forum|thread|comments|discussion"), "forum")
            .when(words > 2500, "long_guide").when(words < 900, "short_seo_page").otherwise("default"))


# Words of factual text, and chunk types that are factual.
FACTUAL = ("price|cost|requires?|requirement|eligible|eligibility|available|availability|contraindication|compatible|causes?|benefits?|risk|deadline|"
           "documents?|steps?|how to|faq")
FACTUAL_TYPES = ["faq", "guide", "table", "comparison", "review", "list"]


def fact_candidate_priority(text: Column, tokens: Column, kind: Column, heading: Column, title: Column, least_tokens: int = 8) -> Column:
    """Priority of a chunk for fact extraction; null if it is skipped."""
    factual = lambda c: has_word(F.lower(c), FACTUAL)
    p = (F.when(kind.isin(FACTUAL_TYPES), 50).otherwise(0) + F.when(factual(heading), 25).otherwise(0) + F.when(factual(text), 20).otherwise(0)
         + F.when(factual(title), 10).otherwise(0))
    return F.when((F.trim(text) != "") & (tokens >= least_tokens) & ~((p == 0) & (kind == "unknown")), p)


def freshness_reasons(ttl_expired: Column, no_snapshot: Column, content: Column, entity: Column, ontology: Column, policy: Column) -> Column:
    named = zip(("ttl_expired", "serp_changed", "content_changed", "entity_missing", "ontology_updated", "policy_changed"),
                (ttl_expired, no_snapshot, content, entity, ontology, policy), strict=True)
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))


def freshness_status(reasons: Column, forced: Column) -> Column:
    return F.when(F.size(reasons) == 0, "reuse").when(forced, "force_refresh").otherwise("refresh")


def ttl_expired(seen: Column, now: Column, hours: float, inclusive: bool = True) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(seen)) / 3.6e9
    return seen.isNull() | (age >= hours if inclusive else age > hours)


def age_minutes(ts: Column, now: Column) -> Column:
    """Whole minutes, at least 0; null for no time."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 6e7))


# The signals of a candidate, and the profiles that weight them; signals without an entry weigh 0.7.
SCORING_SIGNALS = ["demand_strength", "serp_weakness", "content_gap", "faq_gap", "entity_gap", "serp_volatility", "competitor_similarity", "knowledge_strength",
                   "topic_authority_potential", "research_asset_availability", "long_tail_specificity", "provider_metric", "unknown_metric_penalty"]
SCORING_PROFILES = {
    "default": {"demand_strength": 1.2, "serp_weakness": 1.1, "content_gap": 1.0, "faq_gap": 0.8, "entity_gap": 0.8, "knowledge_strength": 1.0,
                "research_asset_availability": 0.9, "long_tail_specificity": 0.9, "unknown_metric_penalty": -0.6},
    "fallback_first": {"knowledge_strength": 1.3, "research_asset_availability": 1.2, "long_tail_specificity": 1.1, "unknown_metric_penalty": -0.2},
    "authority_building": {"topic_authority_potential": 1.4, "knowledge_strength": 1.2, "entity_gap": 1.1, "content_gap": 1.0},
    "quick_win": {"serp_weakness": 1.4, "demand_strength": 1.2, "provider_metric": 1.1, "competitor_similarity": -0.8},
}


def signal_weights(profile: str) -> dict[str, float]:
    return {name: SCORING_PROFILES[profile].get(name, 0.7) for name in SCORING_SIGNALS}


def research_hints(kinds: Column, no_metric: Column, sources: Column, weak_serp: Column) -> Column:
    """Codes of focused research, each followed by a comma: what is missing among a candidate's kinds of signals."""
    lacks = lambda name: ~F.array_contains(kinds, name)
    cases = {"missing_serp_pack": lacks("serp_weakness"), "missing_serp_intent_pack": lacks("content_gap") & lacks("faq_gap"), "missing_knowledge_pack": lacks("knowledge_strength"),
             "missing_provider_metrics": no_metric, "weak_source_diversity": sources <= 1, "verify_shallow_competitor_coverage": weak_serp}
    return F.concat(*[F.when(c, F.lit(f"{code},")).otherwise("") for code, c in cases.items()])
