"""DuckDB SQL of the training-data operators that SQL can express."""

from __future__ import annotations

import itertools

from tessera.llm import license_scan, url_filter

EXACT_DEDUP = r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS chars,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)"""

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINE_DEDUP = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    x AS (SELECT r, i, l[i] AS line, translate(trim(l[i], {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
    hot AS (SELECT key FROM x WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
    k AS (SELECT r, count(*) FILTER (WHERE hot.key IS NOT NULL) AS n, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '') AS kept
          FROM x LEFT JOIN hot ON hot.key = x.key GROUP BY r)
    SELECT doc_id, len(l)::BIGINT AS n_lines, n::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN k ON k.r = d.r"""


def audit_sql() -> str:
    """Masks have a bit for each failed filter, A = 1 to E = 16; a plan row is an order, a step, its filter's bit and the bits before it."""
    plan = ", ".join(f"('{o}', {k + 1}, {1 << 'ABCDE'.index(f)}, {sum(1 << 'ABCDE'.index(x) for x in o[:k])})"
                     for o in map("".join, itertools.permutations("ABCDE")) for k, f in enumerate(o))
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
    l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
    m AS (SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                 + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                 + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
    c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY 1, 2),
    s AS (SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE mask & (pre | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & pre = 0 AND mask & bit <> 0) AS removed,
                 sum(n) FILTER (WHERE mask & pre <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
                 sum(good) FILTER (WHERE mask & pre = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (WHERE mask & pre = 0 AND mask & bit <> 0) AS toxic_lost
          FROM c, (VALUES {plan}) p(filter_order, step, bit, pre) GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
           coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
           (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM s"""


def license_sql() -> str:
    rows = []
    for kind, listed in (("base", license_scan.BASE), ("method", license_scan.TEMPLATES)):
        for phrase, label in listed:
            w = phrase.split()
            rows += [f"('{kind}:{phrase}', '{kind}', '{label}', {len(w) - 2}, {i}, '{w[i]}', '{w[i + 1]}', '{w[i + 2]}')" for i in range(len(w) - 2)]
    return rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), chr(8490), chr(65533))), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
    g AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w),
    t(template, kind, label, grams, tpos, t0, t1, t2) AS (VALUES {', '.join(rows)}),
    hits AS (SELECT DISTINCT doc_id, template, kind, label, grams, tpos, i - 1 AS pos FROM g JOIN t ON w[i] = t0 AND w[i + 1] = t1 AND w[i + 2] = t2),
    d AS (SELECT doc_id, template, kind, label, grams, pos - tpos AS diagonal, list(DISTINCT tpos) AS seen, min(pos) AS first, max(pos) AS last FROM hits GROUP BY ALL),
    f AS (SELECT *, CASE WHEN kind = 'base' OR lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > 3 THEN 1 ELSE 0 END AS fresh
          FROM d WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM f),
    m AS (SELECT doc_id, kind, label, grams, len(list_distinct(flatten(list(seen)))) / grams::DOUBLE AS covered, min(first) AS first, max(last) AS last
          FROM n GROUP BY doc_id, template, kind, label, grams, island),
    v AS (SELECT * FROM m WHERE CASE WHEN kind = 'base' THEN covered = 1 ELSE covered >= 0.6 AND last - first + 1 <= 2 * (grams + 3) END),
    a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'base') AS n_base, min(first) FILTER (WHERE kind = 'base') AS first_word, max(first) FILTER (WHERE kind = 'base') AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE kind = 'base') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score
          FROM v GROUP BY doc_id)
    SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM w LEFT JOIN a ON a.doc_id = w.doc_id"""


def url_sql(rounds: int = 100, damping: float = 0.85) -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for h, p, _ in rules]
    rule = "CASE " + " ".join(f"{c}'{h}{p}'" for c, (h, p, _) in zip(fits, rules, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"{c}'{v}'" for c, (_, _, v) in zip(fits, rules, strict=True)) + " END"
    link = r"""(?i)(?:href|src)\s*=\s*["'']?\s*(?:https?:)?//([^/"''?#\s>]+)"""
    az = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, html, {az.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
    p AS (SELECT page_id, html, host, path, {rule} AS rule, {verdict} AS v FROM s),
    l AS (SELECT host AS src, {az.format('x')} AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS x FROM p WHERE host <> '')),
    edges AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM l WHERE src <> dst GROUP BY 1, 2),
    own AS (SELECT host, count(*) FILTER (WHERE v = 'allow') AS a, count(*) FILTER (WHERE v = 'block') AS b FROM p WHERE host <> '' GROUP BY 1),
    hosts AS (SELECT host, sum(t)::DOUBLE AS t, sum(d)::DOUBLE AS d FROM (SELECT host, greatest(a - b, 0) AS t, greatest(b - a, 0) AS d FROM own
              UNION ALL SELECT src, 0, 0 FROM edges UNION ALL SELECT dst, 0, 0 FROM edges) GROUP BY 1),
    base AS (SELECT host, t / coalesce(nullif((SELECT sum(t) FROM hosts), 0), 1) AS ts, d / coalesce(nullif((SELECT sum(d) FROM hosts), 0), 1) AS ds, (SELECT count(*) FROM hosts) AS n FROM hosts),
    flow AS (SELECT src AS "from", dst AS "to", weight / sum(weight) OVER (PARTITION BY src) AS p, true AS ahead FROM edges
             UNION ALL SELECT dst, src, weight / sum(weight) OVER (PARTITION BY dst), false FROM edges),
    r AS (SELECT 0 AS k, host, ts::DOUBLE AS trust, ds::DOUBLE AS distrust FROM base
          UNION ALL SELECT k, host, {1 - damping!r} * ts + {damping} * coalesce(t, 0), {1 - damping!r} * ds + {damping} * coalesce(d, 0) FROM
            (SELECT coalesce(m.k, (SELECT max(k) + 1 FROM r)) AS k, b.host, ts, ds, t, d FROM base b LEFT JOIN
              (SELECT "to" AS host, max(k) + 1 AS k, sum(CASE WHEN ahead THEN p * trust ELSE 0 END) AS t, sum(CASE WHEN ahead THEN 0 ELSE p * distrust END) AS d
               FROM flow JOIN r ON "from" = host GROUP BY 1) m ON m.host = b.host) WHERE k <= {rounds}),
    z AS (SELECT b.host, distrust > trust AND distrust * n > 1.0 AS bad FROM r JOIN base b ON b.host = r.host WHERE k = {rounds})
    SELECT page_id, p.host, path, rule, coalesce(v, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN z ON z.host = p.host"""
