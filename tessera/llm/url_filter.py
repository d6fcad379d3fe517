"""URL filter by link-graph propagation, in DataFrame functions only.

Longest-match rules decide first. For hosts that no rule settles, personalised PageRank runs over host edges (links of
the pages) until the ranks move by less than `tolerance` in all: trust flows from hosts whose rule-matched pages are mostly allowed, distrust flows along reversed links from
hosts whose rule-matched pages are mostly blocked. A host is blocked when its distrust exceeds both its trust and
`threshold` times the mean distrust of a uniform distribution. Mass of hosts without links is not redistributed.

Defined results: null urls and urls without "://" have empty host and path, no rule, and are allowed; null html has no
links; very long urls are read whole; of rules that fit the longest counts by host and path together, and no two of one
length fit one url; a host whose distrust equals its trust is allowed; repeated rows each get a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

# Host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
LINK = "(?i)(?:href|src)\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/\"'?#\\s>]+)"


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_ranks(hosts: DataFrame, edges: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-6, cut_every: int = 4) -> DataFrame:
    """hosts(host, trust_seed, distrust_seed), edges(src, dst, weight) -> hosts with trust and distrust."""
    hosts = cut(hosts)
    t, d, n = hosts.agg(F.sum("trust_seed"), F.sum("distrust_seed"), F.count(F.lit(1))).first()  # one row
    base = hosts.select("host", (F.col("trust_seed") / (t or 1.0)).alias("ts"), (F.col("distrust_seed") / (d or 1.0)).alias("ds"), F.lit(n).alias("n"))
    outs = edges.groupBy(F.col("src").alias("from")).agg(F.sum("weight").alias("out"))
    ins = edges.groupBy(F.col("dst").alias("from")).agg(F.sum("weight").alias("out"))
    forward = edges.join(outs, edges["src"] == outs["from"]).select(
        F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("weight") / F.col("out")).alias("p"), F.lit(True).alias("ahead"))
    backward = edges.join(ins, edges["dst"] == ins["from"]).select(
        F.col("dst").alias("from"), F.col("src").alias("to"), (F.col("weight") / F.col("out")).alias("p"), F.lit(False).alias("ahead"))
    flow = cut(forward.unionByName(backward))
    ranks = before = base.select("host", F.col("ts").alias("trust"), F.col("ds").alias("distrust"))
    for k in range(10_000):  # the tolerance ends it: after k rounds, what moves is at most damping ** k
        moved = (
            flow.join(ranks, flow["from"] == ranks["host"])
            .groupBy(F.col("to").alias("__to"))
            .agg(F.sum(F.when(F.col("ahead"), F.col("p") * F.col("trust")).otherwise(0.0)).alias("__t"),
                 F.sum(F.when(~F.col("ahead"), F.col("p") * F.col("distrust")).otherwise(0.0)).alias("__d"))
        )
        ranks = base.join(moved, base["host"] == moved["__to"], "left").select(
            "host", ((1 - damping) * F.col("ts") + damping * F.coalesce("__t", F.lit(0.0))).alias("trust"),
            ((1 - damping) * F.col("ds") + damping * F.coalesce("__d", F.lit(0.0))).alias("distrust"))
        if k % cut_every == cut_every - 1:
            ranks = cut(ranks)
            old = before.select(F.col("host").alias("h"), F.col("trust").alias("t"), F.col("distrust").alias("d"))
            moved = ranks.join(old, F.col("host") == F.col("h")).agg(F.sum(F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d")))).first()[0]
            before = ranks
            if not moved or moved < tolerance:
                break
    return ranks.join(base.select("host", "n"), "host")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, rules=RULES,
          threshold: float = 1.0, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the host's trust and distrust."""
    host, path = split_url(F.col(url_col))
    slim = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("__html"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    ruled = slim.drop("__html").withColumns({"rule": rule, "__v": verdict})
    links = (
        slim.where("host <> ''")
        .select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("__html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
        .select("src", F.translate("dst", string.ascii_uppercase, string.ascii_lowercase).alias("dst"))
        .where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    links = cut(links)
    own = ruled.where("host <> ''").groupBy("host").agg(
        F.sum((F.col("__v") == "allow").cast("double")).alias("a"), F.sum((F.col("__v") == "block").cast("double")).alias("b"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    seeds = own.select("host", F.when(a > b, a - b).otherwise(0.0).alias("trust_seed"), F.when(b > a, b - a).otherwise(0.0).alias("distrust_seed"))
    linked = links.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("trust_seed"), F.lit(0.0).alias("distrust_seed"))
    hosts = seeds.unionByName(linked).groupBy("host").agg(F.sum("trust_seed").alias("trust_seed"), F.sum("distrust_seed").alias("distrust_seed"))
    ranks = host_ranks(hosts, links, damping=damping, tolerance=tolerance)
    # a new expression as key: the join deals both sides out itself, and a hot host's pages can be split
    scored = ranks.select(F.concat("host", F.lit("")).alias("__host"), "trust", "distrust",
                          ((F.col("distrust") > F.col("trust")) & (F.col("distrust") * F.col("n") > threshold)).alias("__bad"))
    return ruled.join(scored, F.col("host") == F.col("__host"), "left").select(
        F.col("__id").alias(id_col), "host", "path", "rule",
        F.coalesce("__v", F.when(F.col("__bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust")
