"""Exact dedup, license scan and URL filter against brute force on small tables."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, license_scan, url_filter

TEXTS = [None, "", " \n", "a b", "ab", "a\tb\x0b", "abc", "x" * 30_000, "x" * 30_000 + " ", "ab", "é e", "ée", "\x1ca", "a", "same" * 40, "same" * 39 + "sam"]


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "en", f"kept{i}", 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, keep_id string, n_words int")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        first = min(range(len(members)), key=lambda k: members[k][:3])
        out += [(m[3], members[first][3], len(members), k == first, hashlib.sha256(norm.encode()).hexdigest()) for k, m in enumerate(members)]
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [1, 1 << 16])  # one word: nearly every row hits the bitmap
def test_exact_decisions(spark, words):
    texts, ids = TEXTS + ["ab", "zz"], [*range(len(TEXTS)), 3, None]
    got = exact_dedup.decisions(docs_of(spark, texts, ids), digest=True, filter_words=words)
    assert sorted(map(tuple, got.collect()), key=str) == brute(zip(ids, texts, strict=True))
    slim = exact_dedup.decisions(docs_of(spark, texts, ids), filter_words=words)
    assert sorted(map(tuple, slim.collect()), key=str) == sorted((r[:4] for r in brute(zip(ids, texts, strict=True))), key=str)


@pytest.mark.parametrize("words", [1, 1 << 16])
def test_exact_filter(spark, words):
    texts, ids = TEXTS + ["ab", "ab", None], [*range(len(TEXTS)), 3, 3, None]
    docs = docs_of(spark, texts, ids)
    got = exact_dedup.filter_documents(docs, filter_words=words)
    assert got.columns == docs.columns
    rows = brute(zip(ids, texts, strict=True))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({r[1] for r in rows})


def test_one_row_of_a_group_stays_where_ids_repeat(spark):
    rows = [("a b", 3), ("ab", 3), ("ab", 4), ("c", 5), ("c", 5), ("d ", 6), (" d", 6), ("e", None), ("e", None)]
    got = exact_dedup.decisions(docs_of(spark, [t for t, _ in rows], [i for _, i in rows]), digest=True).collect()
    assert sorted(map(tuple, got), key=str) == brute([(i, t) for t, i in rows]) and sum(r["kept"] for r in got) == 4


def test_exact_empty_table_and_skew(spark):
    assert exact_dedup.decisions(docs_of(spark, [])).count() == 0
    assert exact_dedup.filter_documents(docs_of(spark, [])).count() == 0
    many = docs_of(spark, ["hot copy"] * 500 + [f"t {i}" for i in range(100)])
    got = exact_dedup.decisions(many)
    assert got.where("kept").count() == 101 and got.agg(F.max("group_size")).first()[0] == 500


LICENSED = [
    None, "", "the MIT license", "Released UNDER the-MIT License. under the mit license", "Apache License, Version 2.0", "cc by nc; CC-BY-NC 4.0",
    "under the mitK license", "x " * 9000 + "cc by nc", "this work is licensed under the gnu general public license version 3",
    "Licensed under the very Apache License, Version 2.0, so", "by nc", "cc by", "éunder the mit license", "under the mit license_under",
]


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), found


def test_license_base(spark):
    docs = docs_of(spark, [*LICENSED, LICENSED[3]], [*range(len(LICENSED)), 3])
    got = license_scan.scan(docs).collect()
    assert len(got) == len(LICENSED) + 1
    for r in got:
        n, found = base_places(LICENSED[r["doc_id"]])
        at = [i for i, _ in found]
        want = (n, len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want, LICENSED[r["doc_id"]]
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[8] == "gpl-3" and "apache-2" in labels[9] and labels[10] == labels[2] == ""
    assert license_scan.scan(docs_of(spark, [])).count() == 0


def test_whole_license_texts(spark):
    mit, bsd = license_scan.MIT, license_scan.BSD_3
    texts = [f"x y z {mit} and on", bsd.replace("copyright holder", "University"), " ".join(mit.split()[:12]), mit.upper().replace(",", "\n"), "permission is hereby granted"]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert [got[i][0] for i in range(5)] == ["mit", "bsd", "", "mit", ""] and got[0][1] == 1


URLS = [
    None, "", "nothing", "http://a.com", "http://A.com/fr/x?y#z", "https://x.a.com/de/1", "http://example.org/es/2", "http://sub.example.org/en/1", "http://example.org/en/2",
    "ftp://badexample.org/es/", "http://org/", "http://x.net/fr/?://", "http://y.net#frag/de/", "://com/de/", "http://n.net/1",
]


def brute_rule(url):
    at = (url or "").find("://")
    rest = (url or "")[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule int")


def test_url_rules(spark):
    got = url_filter.judge(pages_of(spark, [(i, u, None, 1) for i, u in enumerate(URLS)])).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, rule, verdict = brute_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict in (None, r["verdict"]) and r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages_of(spark, [])).count() == 0


def test_url_propagation_matches_dense_iteration(spark):
    import numpy as np

    hosts = ["good.com", "bad.com", "near-good.net", "near-bad.net", "alone.net"]
    links = [(0, 2), (2, 0), (3, 1), (3, 2), (1, 3)]
    pages = [(0, "http://good.com/fr/", '<a href="http://near-good.net/x">'), (1, "http://bad.com/de/", "<a href='//near-bad.net'>"),
             (2, "http://near-good.net/", '<a HREF="https://good.com">'), (3, "http://near-bad.net/", '<a href=http://BAD.com><a href="http://near-good.net/y">'), (4, "http://alone.net/", "<a href='/own'>")]
    got = {r["host"]: r for r in url_filter.judge(pages_of(spark, [(*p, 1) for p in pages])).collect()}
    w = np.zeros((5, 5))
    for u, v in links:
        w[u, v] = 1
    out, back = w / np.maximum(w.sum(1, keepdims=True), 1), w.T / np.maximum(w.sum(0)[:, None], 1)
    t = t0 = np.eye(5)[0]
    d = d0 = np.eye(5)[1]
    for _ in range(200):
        t, d = 0.15 * t0 + 0.85 * t @ out, 0.15 * d0 + 0.85 * d @ back
    for i, h in enumerate(hosts):
        assert abs(got[h]["trust"] - t[i]) < 2e-6 and abs(got[h]["distrust"] - d[i]) < 2e-6
    assert [got[h]["verdict"] for h in hosts] == ["allow", "block", "allow", "block", "allow"]


def test_crc_fold_is_zlib(spark):
    from tessera.llm.common import fold

    got = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_url_trust_goes_down_a_long_chain(spark):
    """A chain of 30 hosts, and one host with a third of all pages."""
    pages = [(0, "http://seed.com/fr/", '<a href="http://h0.net/">', 1)] + [(k + 1, f"http://h{k}.net/", f'<a href="http://h{k + 1}.net/">', 1) for k in range(30)]
    pages += [(100 + k, f"http://h0.net/{k}", None, 1) for k in range(15)]
    got = {r["host"]: r["trust"] for r in url_filter.judge(pages_of(spark, pages)).collect()}
    assert all(abs(got[f"h{k}.net"] - 0.15 * 0.85 ** (k + 1)) < 1e-5 for k in range(30)) and got["h20.net"] > 0
