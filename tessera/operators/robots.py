"""robots.txt: bodies parsed into rule groups, and the decision for each url at its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import web

NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def groups(robots: DataFrame, by: list[str], body: str = "body") -> DataFrame:
    """robots(*by, body) -> *by, g, agents, rules (in the file's order), delay: a row per group of a body.

    Comments go; a blank line ends a group; a user-agent line opens one, or joins the agents of one that has no path rule yet;
    lines outside a group, and lines without a colon, mean nothing; the last valid crawl-delay of a group counts.
    """
    lines = robots.select(*by, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\\r?\\n")).alias("n", "raw"))
    line = _trim(F.substring_index("raw", "#", 1))
    field, value = F.lower(_trim(F.substring_index(line, ":", 1))), _trim(F.regexp_replace(line, "^[^:]*:", ""))
    kind = F.when(line == "", "blank").when(~line.contains(":"), "other").when(field.isin("user-agent", "allow", "disallow", "crawl-delay"), field).otherwise("other")
    at = Window.partitionBy(*by).orderBy("n")  # one body, of bounded size
    cut = lines.select(*by, "n", kind.alias("kind"), value.alias("value")).where("kind <> 'other'").withColumn("part", F.count_if(F.col("kind") == "blank").over(at))
    inside = Window.partitionBy(*by, "part").orderBy("n")
    told = F.last(F.when(F.col("kind").isin("user-agent", "allow", "disallow"), F.col("kind")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("kind") == "user-agent") & F.coalesce(told != "user-agent", F.lit(True))
    cut = cut.withColumn("opens", opens).withColumn("open", F.count_if("opens").over(inside)).withColumn("g", F.count_if("opens").over(at)).where("open > 0 and kind <> 'blank'")
    seconds = F.when(F.col("value") == "", 0.0).when(F.col("value").rlike(NUMBER), F.col("value").try_cast("double"))
    delay = F.when((F.col("kind") == "crawl-delay") & (seconds >= 0), seconds)
    of = lambda cond, what: F.array_sort(F.collect_list(F.when(cond, F.struct("n", what))))
    rule = F.col("kind").isin("allow", "disallow") & (F.col("value") != "")
    found = cut.groupBy(*by, "g").agg(of(F.col("kind") == "user-agent", F.lower("value").alias("v")).alias("a"), of(rule, F.struct(F.col("kind").alias("type"), F.col("value").alias("path")).alias("v")).alias("r"),
                                      F.max_by(delay, F.when(delay.isNotNull(), F.col("n"))).alias("delay"))
    return found.select(*by, "g", F.transform("a", lambda x: x["v"]).alias("agents"), F.transform("r", lambda x: x["v"]).alias("rules"), "delay")


def decide(urls: DataFrame, robots: DataFrame, user_agent: str, *, ttl_seconds: int, fail_closed: bool, respect: bool = True) -> DataFrame:
    """urls(id, url, at) with allowed, evidence and delay by robots(origin, fetched_at, status, body).

    A url is judged by the newest body of its origin that was fetched by then and has not expired; without one robots are
    unavailable, and `fail_closed` tells what that means. A status other than 2xx stands for an empty body. Groups whose
    agent is part of the user agent count, else those of *; of the rules that the path and query start with the longest wins,
    the earlier one on a tie; an empty path says nothing. Each body meets urls once, as one short list of rules.
    """
    if not respect:
        return urls.select("id", F.lit(True).alias("allowed"), F.lit("robots disabled by policy").alias("evidence"), F.lit(None).cast("double").alias("delay"))
    by, agent = ["origin", "fetched_at"], F.lit(user_agent.lower())
    following = F.lead("fetched_at").over(Window.partitionBy("origin").orderBy("fetched_at"))
    expires = F.col("fetched_at") + F.expr(f"interval {ttl_seconds} seconds")
    valid = robots.withColumn("until", F.least(expires, F.coalesce(following, expires)))
    every = groups(valid.where("status between 200 and 299"), by)
    own, star = F.exists("agents", lambda a: F.contains(agent, a)), F.array_contains("agents", "*")
    chosen = every.withColumn("own", own).where(own | star).withColumn("any", F.bool_or("own").over(Window.partitionBy(*by))).where("own or not any")
    packed = chosen.groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("g", "rules"))), lambda x: x["rules"])).alias("rules"),
                                     F.min_by("delay", F.when(F.col("delay").isNotNull(), F.col("g"))).alias("delay"))
    sources = valid.select(*by, "until").join(packed, by, "left").withColumnRenamed("origin", "__origin")
    path = F.concat(web.path_of(F.col("url")), F.regexp_extract("url", "^[^?#]*(\\?[^#]*)?", 1))
    asked = urls.select("id", "url", "at", web.origin_of(F.col("url")).alias("origin"), path.alias("path"))
    met = asked.join(sources, (F.col("origin") == F.col("__origin")) & (F.col("at") >= F.col("fetched_at")) & (F.col("at") < F.col("until")), "left")
    fitting = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.aggregate(fitting, F.lit(None).cast("struct<type:string,path:string>"), lambda a, r: F.when(a.isNull() | (F.length(r["path"]) > F.length(a["path"])), r).otherwise(a))
    met = met.withColumn("best", best)
    evidence = (F.when(F.col("fetched_at").isNull(), "robots unavailable").when(F.col("rules").isNull(), "no matching robots group")
                .when(F.col("best").isNull(), "no matching robots path rule").otherwise(F.concat("best.type", F.lit(": "), "best.path")))
    allowed = F.when(F.col("fetched_at").isNull(), F.lit(not fail_closed)).otherwise(F.coalesce(F.col("best.type") == "allow", F.lit(True)))
    return met.select("id", allowed.alias("allowed"), evidence.alias("evidence"), "delay")
