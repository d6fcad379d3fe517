"""URLs, hosts and HTML as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import collapse


def host_of(url: Column) -> Column:
    """Lower-cased host name without port; null if there is none."""
    h = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def origin_of(url: Column) -> Column:
    """Lower-cased scheme, host and port as written; null if there is none."""
    o = F.lower(F.regexp_extract(F.regexp_replace(url, "://[^/?#@]*@", "://"), "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))
    return F.when(o != "", o)


def domain_of(url: Column) -> Column:
    return F.regexp_replace(host_of(url), "^www\\.", "")


def normalize_url(url: Column) -> Column:
    """http(s) only: lower-cased scheme and host, no trailing dot, default port or fragment, "/" for an empty path; null if invalid."""
    part = lambda i: F.regexp_extract(F.trim(url), "^(?i)(https?)://([^/?#:@\\s]+)(?::([0-9]+))?([^?#\\s]*)(\\?[^#\\s]*)?(?:#.*)?$", i)
    scheme, host, port, path, query = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), "\\.$", ""), part(3), part(4), part(5)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    rebuilt = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), query)
    return F.when(scheme != "", rebuilt)


def path_of(url: Column) -> Column:
    p = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def glob_to_regex(pattern: str) -> str:
    """`*` matches anything; of the other signs only . ^ and $ are taken literally."""
    return "^" + ".*".join(re.sub(r"[.^$]", lambda m: "\\" + m[0], part) for part in pattern.split("*")) + "$"


def path_matches(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_to_regex(p))
    return out


def host_matches(host: Column, rules: list[str], wildcard: bool = True) -> Column:
    """Exact hosts; with `wildcard`, "*.x" stands for strict subdomains of x."""
    out = F.lit(False)
    for r in rules:
        out = out | (host.endswith(r[1:]) if wildcard and r.startswith("*.") else host == F.lit(r))
    return out


def crawl_policy(url: Column, allowed: list[str], denied: list[str], include: list[str], exclude: list[str], wildcard: bool = True) -> Column:
    """The first rule that decides: invalid_url, host_denied, host_not_allowed, path_excluded, path_not_included, allowed.

    The wildcard form lets an empty allow-list pass every host; the exact form rejects then.
    """
    host, path = host_of(url), path_of(url)
    permitted = host_matches(host, allowed, wildcard) if allowed else F.lit(wildcard)
    return (
        F.when(host.isNull(), "invalid_url").when(host_matches(host, denied, wildcard), "host_denied").when(~permitted, "host_not_allowed")
        .when(path_matches(path, exclude), "path_excluded").when(F.lit(bool(include)) & ~path_matches(path, include), "path_not_included").otherwise("allowed")
    )


def is_unsafe_host(host: Column) -> Column:
    """Loopback, private, link-local and other addresses that a crawler must not fetch; null counts as unsafe."""
    octet = lambda i: F.try_element_at(F.split(host, "\\."), F.lit(i)).try_cast("int")
    v4 = host.rlike("^[0-9]{1,3}(\\.[0-9]{1,3}){3}$")
    a, b = octet(1), octet(2)
    private = (a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224))
    named = host.isin("localhost") | host.endswith(".localhost") | host.endswith(".local") | host.endswith(".internal")
    v6 = host.rlike("^\\[?(::1?|f[cd][0-9a-f]{2}:.*|fe80:.*)\\]?$")
    return F.coalesce((v4 & private) | named | v6, F.lit(True))


# Fixed values, in fixed order: the crawler's variant knows six entities, the extractor's five; both decode &amp; before &lt;.
ENTITIES_PLAIN = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
ENTITIES_EXTRACT = [("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def decode_entities(c: Column, table: list[tuple[str, str]] = ENTITIES_PLAIN) -> Column:
    for a, b in table:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def plain_text(html: Column) -> Column:
    """No scripts, styles and tags; entities decoded; white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>", " "), "(?is)<style[^>]*>.*?</style>", " ")
    return collapse(decode_entities(F.regexp_replace(bare, "(?s)<[^>]+>", " ")))


def page_title(html: Column) -> Column:
    t = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    out = collapse(decode_entities(F.regexp_replace(t, "(?s)<[^>]+>", " ")))
    return F.when(out != "", out)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or bare; null if there is none."""
    raw = F.regexp_extract(tag, f"(?is)\\s{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>\"']+)", 1)
    out = F.regexp_replace(raw, "^[\"']|[\"']$", "")
    return F.when(raw != "", out)


def html_lang(html: Column) -> Column:
    return attribute(F.regexp_extract(html, "(?is)<html[^>]*>", 0), "lang")


def meta_content(html: Column, name: str) -> Column:
    tag = F.regexp_extract(html, f"(?is)<meta[^>]*name\\s*=\\s*[\"']?{name}[\"']?[^>]*>", 0)
    return attribute(tag, "content")


def canonical_link(html: Column) -> Column:
    return attribute(F.regexp_extract(html, "(?is)<link[^>]*rel\\s*=\\s*[\"']?canonical[\"']?[^>]*>", 0), "href")


def anchors(html: Column) -> Column:
    """array<struct<href, anchor_text>> of all <a> elements in order."""
    whole = F.regexp_extract_all(html, F.lit("(?is)(<a\\s[^>]*>.*?</a>)"), F.lit(1))
    return F.transform(whole, lambda a: F.struct(
        attribute(F.regexp_extract(a, "(?is)^<a\\s[^>]*>", 0), "href").alias("href"),
        collapse(decode_entities(F.regexp_replace(a, "(?s)<[^>]+>", " "))).alias("anchor_text")))


def headings(html: Column) -> Column:
    """array<struct<level, text>> of h1..h6 in order."""
    whole = F.regexp_extract_all(html, F.lit("(?is)(<h[1-6][^>]*>.*?</h[1-6]>)"), F.lit(1))
    return F.transform(whole, lambda h: F.struct(
        F.substring(h, 3, 1).cast("int").alias("level"), collapse(decode_entities(F.regexp_replace(h, "(?s)<[^>]+>", " "))).alias("text")))


def utf16_length(c: Column) -> Column:
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def http_outcome(status: Column) -> Column:
    """Outcome of a fetch by status code."""
    return (F.when(status.between(200, 299), "succeeded").when(status.between(300, 399), "redirected")
            .when((status == 429) | (status >= 500), "failed_retryable").otherwise("failed_terminal"))
