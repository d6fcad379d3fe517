"""robots.txt: groups, agents, ties, expiry."""

import datetime as dt

from tessera.operators import robots

T = dt.datetime(2024, 1, 1)
BODY = "Sitemap: x\nDisallow: /early\nUser-agent: A1\nUSER-AGENT:  b1 # two\nCrawl-delay: 3\nUser-agent: c1\nAllow: /x\nDisallow:\nUser-agent: d1\nDisallow: /d\nCrawl-delay: -1\n \nDisallow: /lost\nUser-agent: *\nno colon\nDisallow: /q?a\nCrawl-delay:\n"


def test_groups(spark):
    df = spark.createDataFrame([(1, BODY), (2, ""), (3, None), (4, "User-agent: *")], "k int, body string")
    got = {(r["k"], r["g"]): (r["agents"], [(x["type"], x["path"]) for x in r["rules"]], r["delay"]) for r in robots.groups(df, ["k"]).collect()}
    assert got == {(1, 1): (["a1", "b1", "c1"], [("allow", "/x")], 3.0), (1, 2): (["d1"], [("disallow", "/d")], None), (1, 3): (["*"], [("disallow", "/q?a")], 0.0), (4, 1): (["*"], [], None)}


def test_decisions(spark):
    at = lambda h: T + dt.timedelta(hours=h)
    bodies = [("http://a.com", at(0), 200, BODY), ("http://a.com", at(10), 200, "User-agent: bot\nAllow: /p\nDisallow: /p\nDisallow: /pq\n\nUser-agent: bo\nCrawl-delay: 7\nAllow: /pqr"), ("http://gone.com", at(0), 500, BODY)]
    table = spark.createDataFrame(bodies, "origin string, fetched_at timestamp, status int, body string")
    asked = [("http://a.com/q?a=1", 1, (False, "disallow: /q?a", 0.0)), ("HTTP://A.com/q", 1, (True, "no matching robots path rule", 0.0)), ("http://a.com/p", 10, (True, "allow: /p", 7.0)),
             ("http://a.com/pq#x", 11, (False, "disallow: /pq", 7.0)), ("http://a.com/pqr", 33, (True, "allow: /pqr", 7.0)), ("http://a.com/p", 34, (False, "robots unavailable", None)),
             ("http://a.com/p", -1, (False, "robots unavailable", None)), ("http://gone.com/d", 2, (True, "no matching robots group", None)), ("http://new.com/", 2, (False, "robots unavailable", None)),
             (None, 2, (False, "robots unavailable", None))]
    urls = spark.createDataFrame([(i, u, at(h)) for i, (u, h, _) in enumerate(asked)], "id int, url string, at timestamp")
    got = {r["id"]: tuple(r)[1:] for r in robots.decide(urls, table, "MyBot/2", ttl_seconds=86400, fail_closed=True).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(asked)}
    opened = robots.decide(urls, table, "MyBot/2", ttl_seconds=86400, fail_closed=False).where("evidence = 'robots unavailable'").collect()
    assert len(opened) == 4 and all(r["allowed"] for r in opened)
    assert robots.decide(urls, table, "x", ttl_seconds=1, fail_closed=True, respect=False).where("allowed").count() == len(asked)
