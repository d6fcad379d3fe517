"""Joins, groupings, ranks and set operations that the engine's plans share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.sources.shared import staged


def where_given(df: DataFrame, **equal) -> DataFrame:
    """Filters only by the arguments that are given (not None); a list means membership, an empty list no rows."""
    preds = [F.col(k).isin(v) if isinstance(v, (list, tuple)) and v else F.lit(False) if isinstance(v, (list, tuple)) else F.col(k) == v
             for k, v in equal.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def in_list(df: DataFrame, column: str, values: list, most: int = 200) -> DataFrame:
    """Rows whose key is in a list: literals for short lists, a semi-join for long ones, nothing for none."""
    if not values:
        return df.limit(0)
    if len(values) <= most:
        return df.where(F.col(column).isin(values))
    keys = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} {df.schema[column].dataType.simpleString()}")
    return df.join(keys, column, "left_semi")


def matches_or_neutral(column: Column, value) -> Column:
    """The value, or no value; None asks for no value only."""
    return column.isNull() if value is None else (column == value) | column.isNull()


def backlog(source: DataFrame, done: DataFrame, on: list[str], status: str, retryable: list[str]) -> DataFrame:
    """Rows of source without a finished row in done: absent, or with a status that may be retried."""
    d = done.select(*on, F.col(status).alias("__status"), F.lit(True).alias("__there"))
    return source.join(d, on, "left").where(F.col("__there").isNull() | F.col("__status").isin(retryable)).drop("__status", "__there")


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def top_k(df: DataFrame, order: list, k: int, rank: str) -> DataFrame:
    """The first k rows, numbered from 1; each task keeps k rows before they meet, so the numbering sees k rows only."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return latest(df, keys, [F.col(seq).asc()])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], merge: list[str]) -> DataFrame:
    """Rows by key: new ones are added; of known ones only the listed columns change."""
    e, i = existing.alias("e"), incoming.alias("i")
    on = reduce(lambda a, b: a & b, [F.col(f"e.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys])
    e1, i1 = e.withColumn("__e", F.lit(True)).alias("e"), i.withColumn("__i", F.lit(True)).alias("i")
    columns = []
    for c in existing.columns:
        new, old = F.col(f"i.{c}"), F.col(f"e.{c}")
        take_new = F.col("i.__i").isNotNull() if c in merge else F.col("e.__e").isNull()
        columns.append(F.when(take_new, new).otherwise(old).alias(c))
    return e1.join(i1, on, "full_outer").select(*columns)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Existing rows and the incoming ones with new keys (the first of each)."""
    fresh = incoming.join(existing.select(*keys).distinct(), keys, "left_anti")
    fresh = first_wins(fresh, keys, seq) if seq else fresh.dropDuplicates(keys)
    return existing.unionByName(fresh.select(*existing.columns))


def append_receipts(existing: DataFrame, incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """incoming with a receipt: malformed (no key), duplicate (known, or repeated in the batch), accepted."""
    known = existing.select(F.col(key).alias("__k")).distinct().withColumn("__known", F.lit(True))
    n = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    out = incoming.withColumn("__n", n).join(known, F.col(key) == F.col("__k"), "left")
    receipt = F.when(F.col(key).isNull(), "malformed").when(F.col("__known") | (F.col("__n") > 1), "duplicate").otherwise("accepted")
    return out.withColumn("receipt", receipt).drop("__n", "__k", "__known")


def guarded_update(table: DataFrame, commands: DataFrame, key: str, status: str) -> DataFrame:
    """commands(key, expected, next) -> applied or conflict for each, with the resulting status."""
    t = table.select(F.col(key), F.col(status).alias("__now"))
    ok = F.coalesce(F.col("__now") == F.col("expected"), F.lit(False))
    return commands.join(t, key, "left").select(key, F.when(ok, "applied").otherwise("conflict").alias("outcome"), F.when(ok, F.col("next")).otherwise(F.col("__now")).alias("status"))


def replace_partitions(df: DataFrame, path: str, column: str) -> None:
    """Replaces the partitions that df holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def batches(df: DataFrame, order: list[str], size: int, by: list[str]) -> DataFrame:
    """Numbers rows in batches of `size` within each key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def diversity_factor(df: DataFrame, key: Column, seq: list[Column]) -> DataFrame:
    """1/k for the k-th row of a key in arrival order."""
    return df.withColumn("diversity", F.lit(1.0) / F.row_number().over(Window.partitionBy(key).orderBy(*seq)))


def merge_by_hash(df: DataFrame, key: str, score: str, seq: str) -> DataFrame:
    """One row per key: the best-scoring row's id (earliest on ties), the highest score, how many merged, and the first arrival."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(seq)))
    return df.groupBy(key).agg(F.max(score).alias(score), best[seq].alias("base"), F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("merged"))


def rank_with_ties(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """The top rows of each key; `ambiguous` if more than one shares the top score."""
    w = Window.partitionBy(*by)
    top = df.withColumn("__top", F.rank().over(w.orderBy(F.col(score).desc()))).where(F.col("__top") == 1).drop("__top")
    return top.withColumn("outcome", F.when(F.count(F.lit(1)).over(w) > 1, "ambiguous").otherwise("resolved"))


def change_of(df: DataFrame, entry: str, order: list[str], content: str, status: str, success: str = "succeeded") -> DataFrame:
    """changed, unchanged or unknown against the entry's previous success."""
    ok = df.where(F.col(status) == success)
    before = F.lag(content).over(Window.partitionBy(entry).orderBy(*order))
    return ok.withColumn("change", F.when(before.isNull(), "unknown").when(before == F.col(content), "unchanged").otherwise("changed"))


def failure_streaks(df: DataFrame, entry: str, order: list[str], status: str, most: int = 5) -> DataFrame:
    """Failures in a row since the entry's last success; the most-th retryable one, or any other failure, is terminal."""
    w = Window.partitionBy(entry).orderBy(*order)
    run = df.withColumn("__run", F.sum(F.when(F.col(status) == "succeeded", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(entry, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum(F.when(F.col(status) == "failed_retryable", 1).otherwise(0)).over(inside)
    out = run.withColumn("failures", streak)
    return out.withColumn("next_status", F.when(F.col(status) == "succeeded", "succeeded").when(F.col(status) != "failed_retryable", "failed_terminal")
                          .when(F.col("failures") >= most, "failed_terminal").otherwise("failed_retryable")).drop("__run")


def upper_median(column: str) -> Column:
    """sorted[floor(n / 2)] as an exact aggregate: counts of distinct values are merged, no group is gathered."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def sessions(df: DataFrame, key: str, at: Column, gap_seconds: int) -> DataFrame:
    """Numbers each key's sessions: a gap longer than gap_seconds starts a new one."""
    w = Window.partitionBy(key).orderBy("__at")
    fresh = F.when((F.unix_micros("__at") - F.unix_micros(F.lag("__at").over(w))) <= gap_seconds * 1_000_000, 0).otherwise(1)
    return df.withColumn("__at", at).withColumn("__new", fresh).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new", "__at")


GRAM = 3


def contained(texts: DataFrame, terms: DataFrame, a: str, b: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Distinct pairs of texts(a) and terms(b) in which the term occurs in the text, as equi-joins; with `carry`, a pair for every
    row of texts, which keeps these columns.

    Texts are filed by their distinct character grams, of three characters or of as many as shorter terms have. A term is
    looked up by one gram only, the one that the fewest texts hold, and not at all if some gram of it occurs nowhere; what
    is found is then compared. Texts travel as hashes until that comparison. Work grows with the length of the texts.
    """
    t = terms.select(b).where(F.length(b) > 0).distinct()
    size = F.least(F.length(b), F.lit(GRAM))
    sizes = [r["n"] for r in t.select(size.alias("n")).distinct().orderBy("n").collect()]  # three at most
    if not sizes:
        return texts.select(a, *carry).join(terms.select(b), F.lit(False))
    # all grams by one look ahead of each position; one that begins within a pair of surrogates is found alike in texts and terms
    of = lambda c, n: F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))

    rows = texts.select(a, *carry).where(F.col(a).isNotNull())
    named = (rows if carry else rows.distinct()).select("*", F.xxhash64(a).alias("__h"), F.xxhash64(F.lit(1), a).alias("__g"))
    filed = named.select("__h", "__g", F.explode(F.array_distinct(F.concat(*[of(F.col(a), n) for n in sizes]))).alias("__gram"))
    own = F.coalesce(*[F.when(size == n, of(F.col(b), n)) for n in sizes])
    grams = staged(t.select(b, F.explode(F.array_distinct(own)).alias("__gram")))
    often = filed.join(grams.select(F.col("__gram").alias("__t")).distinct(), F.col("__gram") == F.col("__t"), "left_semi").groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    probes = grams.join(often, "__gram", "left").groupBy(b).agg(F.min(F.struct("__n", "__gram")).alias("__rarest"), F.count_if(F.col("__n").isNull()).alias("__unseen"))
    probes = staged(probes.where("__unseen = 0").select(b, F.col("__rarest.__gram").alias("__gram")))
    found = filed.join(probes, "__gram").select("__h", "__g", b)
    found = found.distinct() if carry else found  # copies of a text name it again
    return found.join(named, ["__h", "__g"]).where(F.contains(F.col(a), F.col(b))).select(a, b, *carry)


def contains_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs in which one text contains the other."""
    return contained(left, right, a, b).unionByName(contained(right, left, b, a)).distinct()


def combinations(dimensions: dict[str, DataFrame], key: str, links: str, cap: int) -> DataFrame:
    """One row per choice from each dimension(key, links) whose members are compatible in pairs (they share a link): a
    column for each dimension, at most cap rows, in the order of the columns.

    Members of one link each are cut before they are joined: of a dimension a link keeps its first members only, as many as
    the first `cap` rows of the link can need, given how many the later dimensions contribute. So a link passes on about
    `cap` rows however large its dimensions are. With three dimensions or more and members of several links, choices may
    hold together by different links, and all of them are compared.
    """
    names = list(dimensions)
    if len(names) > 2 and any((d.agg(F.max(F.size(F.array_distinct(links)))).first()[0] or 0) > 1 for d in dimensions.values()):
        return _overlapping(dimensions, key, links).orderBy(*names).limit(cap)
    kept = {}
    for name, d in dimensions.items():
        one = d.select(F.col(key).alias(name), F.explode(links).alias("__link")).where(F.col("__link").isNotNull()).distinct()
        nth = F.row_number().over(Window.partitionBy("__link").orderBy(name))
        kept[name] = one.withColumn(f"__n_{name}", nth).where(F.col(f"__n_{name}") <= cap)  # cut before the shuffle, too
    sizes = reduce(lambda x, y: x.join(y, "__link"), [kept[n].groupBy("__link").agg(F.count(F.lit(1)).alias(f"__size_{n}")) for n in names])
    out = sizes
    for k, name in enumerate(names):
        later = reduce(lambda x, n: F.least(F.lit(cap), x * F.col(f"__size_{n}")), names[k + 1:], F.lit(1).cast("long"))
        out = out.join(kept[name], "__link").where((F.col(f"__n_{name}") - 1) * later < cap)
    return out.select(*names).distinct().orderBy(*names).limit(cap)


def _overlapping(dimensions: dict[str, DataFrame], key: str, links: str) -> DataFrame:
    out, chosen = None, list(dimensions)
    for n, (name, d) in enumerate(dimensions.items()):
        one = d.select(F.col(key).alias(name), F.col(links).alias(f"__{name}"))
        if out is None:
            out = one
            continue
        right = one.withColumn("__link", F.explode(F.array_distinct(f"__{name}")))
        out = out.withColumn("__l", F.explode(F.array_distinct(f"__{chosen[0]}"))).join(right, F.col("__l") == F.col("__link")).drop("__l", "__link")
        out = out.where(reduce(lambda x, y: x & y, [F.arrays_overlap(f"__{c}", f"__{name}") for c in chosen[1:n]], F.lit(True))).distinct()
    return out.select(*chosen).distinct()


def score_candidates(signals: DataFrame) -> DataFrame:
    """signals(candidate, pos, known, value, confidence, source, seq) -> one row per candidate and profile: score, band,
    degraded, confidence, the five strongest signals, research hints and a page type. pos numbers the kinds of signals.
    Signals are dealt once, by candidate, and copied for no profile: a candidate's row holds the sums of every profile, and of
    each kind the five strongest signals on either side of zero, since no profile can name more of one kind."""
    kinds = F.array(*[F.lit(n) for n in scoring.SCORING_SIGNALS])
    weights = {p: F.array(*[F.lit(w) for w in scoring.signal_weights(p).values()]) for p in scoring.SCORING_PROFILES}
    near = Window.partitionBy("candidate", "pos", F.col("value") > 0).orderBy(F.desc(F.abs("value")), "seq")
    c = signals.select("candidate", "pos", "known", "value", scoring.confidence_rank(F.col("confidence")).alias("rank"), "source", "seq").repartition("candidate")
    c = c.withColumn("k", F.row_number().over(near)).withColumn("name", F.get(kinds, F.col("pos")))
    is_ = lambda n: F.col("name") == n
    sums = [x for p, w in weights.items() for x in (F.sum(F.col("value") * F.get(w, F.col("pos"))).alias(f"x_{p}"), F.sum(F.abs(F.get(w, F.col("pos")))).alias(f"y_{p}"))]
    g = c.groupBy("candidate").agg(
        *sums, F.bool_or(~F.col("known")).alias("degraded"), F.avg("rank").alias("rank"), F.collect_set("name").alias("kinds"), F.min("source").alias("one_source"), F.max("source").alias("other_source"),
        F.bool_or(is_("unknown_metric_penalty") | is_("provider_metric") & ~F.col("known")).alias("no_metric"),
        F.bool_or(is_("serp_weakness") & F.col("known") & (F.col("value") < 35)).alias("weak_serp"), F.coalesce(F.max(F.when(is_("faq_gap"), F.col("value"))), F.lit(-1.0)).alias("faq"),
        F.collect_list(F.when((F.col("k") <= 5) & (F.col("value") != 0), F.struct("value", "pos", "seq"))).alias("near"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.col(f"x_{p}").alias("x"), F.col(f"y_{p}").alias("y"), w.alias("w")) for p, w in weights.items()]))
    g = g.withColumn("p", each).select("*", "p.profile", "p.x", "p.y", "p.w").drop("p", *[f"{v}_{p}" for p in weights for v in "xy"])
    helps = F.filter("near", lambda t: t["value"] * F.get("w", t["pos"]) > 0)
    top = F.slice(F.array_sort(F.transform(helps, lambda t: F.struct((-(t["value"] * F.get("w", t["pos"]))).alias("minus"), t["pos"].alias("pos"), t["seq"].alias("seq")))), 1, 5)
    sure, sources = scoring.confidence_band(F.col("rank")), F.when(F.col("one_source") < F.col("other_source"), 2).otherwise(1)
    g = g.withColumn("score", scoring.clamp(scoring.js_round(F.round(F.col("x") / F.col("y"), 9)), 0, 100).cast("int"))
    return g.select(
        "candidate", "profile", "score", scoring.score_band(F.col("score")).alias("band"), "degraded", F.when(F.col("degraded"), scoring.downgrade(sure)).otherwise(sure).alias("confidence"),
        F.array_join(F.transform(top, lambda t: F.get(kinds, t["pos"])), ",").alias("rationale"), scoring.research_hints(F.col("kinds"), F.col("no_metric"), sources, F.col("weak_serp")).alias("hints"),
        scoring.page_type(F.lit(None).cast("string"), F.col("faq"), F.lit(""), F.lit(False)).alias("page_type"))
