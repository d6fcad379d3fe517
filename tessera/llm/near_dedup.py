"""Near-dedup with ProbMinHash signatures, banding, verification and connected components.

Texts are lower-cased and cut into words (runs of letters, digits and underscores; runs of non-space where a text has
none of these); shingles are five consecutive words, weighted by their count (all words where there are fewer). In a
ProbMinHash signature each shingle is a Poisson process with its weight as rate; its arrivals fall on random registers
and each register keeps the shingle of the first arrival. Arrivals are drawn in rounds, and a shingle stops as soon as
its time passes the latest first arrival of all registers. Two signatures agree in a register with the probability
Jaccard similarity of the weighted shingles, and with all weights 1 with their plain Jaccard similarity. A text that
repeats a shingle is filed in the bands of both signatures, so that either reading of a link has its search.

Texts with the same words form one node, so copies are never paired. In each band bucket all nodes are compared with the
bucket's smallest node (its leader); verified pairs are links, links give components. Buckets in which other members
still lie in different components are then worked through exactly, in blocks of bounded size, comparing only nodes of
different components; blocks of the bucket's most frequent component are not paired with each other. Verification computes the similarity from the shingles: a link needs 0.8 or more in probability
Jaccard, or in plain Jaccard, of the shingles.

With 24 bands of 5 registers a pair of similarity 0.8, in either reading, shares a bucket with probability 0.9999, one of 0.9 with 1 - 1e-9.

Defined results: null text counts as empty; texts without any word are alike only if they are equal after deleting white
space; very long texts are used whole; class_id is the smallest doc_id of the class (null ids last), and the kept row is
the one with that id (one row only, if it is repeated). Other columns are not read (`classes`) or pass through unchanged
(`filter_documents`). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, fresh, maybe_in, release

WORDS = re.compile(r"\w+")
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
GOLDEN, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hash of a word, kept until there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = value
        return value


_HASHES = _Hashes()


def words(text: str) -> list[str]:
    text = text.lower()
    return WORDS.findall(text) or ["".join(text.split())] * bool(text.strip())


def shingles(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Sorted distinct shingle hashes, their counts, and a 16-byte key of the word sequence."""
    w = words(text)
    key = hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    if not w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), key
    get = _HASHES.__getitem__
    h = np.fromiter(map(get, w), np.uint64, len(w))
    n = min(SHINGLE, len(h))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        s = mix(s * GOLDEN + h[i:len(h) - n + 1 + i])
    values, counts = np.unique(s, return_counts=True)
    return values, counts.astype(np.int32), key


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """ProbMinHash signatures, one row for each weighted set (zeros for empty ones)."""
    rows = len(sets)
    sig, least = np.zeros(rows * registers, np.uint64), np.full(rows * registers, np.inf)
    if not sum(len(v) for v, _ in sets):
        return sig.reshape(rows, registers)
    doc = np.repeat(np.arange(rows), [len(v) for v, _ in sets])
    item = np.concatenate([v for v, _ in sets])
    rate = np.concatenate([c for _, c in sets]).astype(np.float64)
    time, drawn = np.zeros(len(item)), 0
    while len(item):
        block = 1 if len(item) > 20_000 else 8
        for _ in range(block):
            r = mix(item + np.uint64(drawn * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log1p(-((r >> np.uint64(11)) * 2.0**-53)) / rate
            at = doc * registers + ((mix(r) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(least, at, time)
            won = least[at] == time
            sig[at[won]] = item[won]
            drawn += 1
        going = time < least.reshape(rows, registers).max(1)[doc]
        doc, item, rate, time = doc[going], item[going], rate[going], time[going]
    return sig.reshape(rows, registers)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard of two weighted sets (sorted distinct hashes and weights)."""
    if not len(a) or not len(b):
        return (1.0, 1.0) if len(a) == len(b) else (0.0, 0.0)
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    plain = len(both) / (len(a) + len(b) - len(both))
    if not len(both):
        return 0.0, 0.0
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = float(wa.sum() - wa[ia].sum()), float(wb.sum() - wb[ib].sum())
    ratios, times = np.unique(y / x, return_counts=True)
    # for a common shingle with weights (u, v): 1 / sum over all d of max(a_d / u, b_d / v)
    total = 0.0
    for t, n in zip(ratios, times, strict=True):
        rest = np.maximum(x * t, y).sum() + only_a * t + only_b
        chosen = y / x == t
        total += float((y[chosen] / rest).sum())
    return total, plain


def linked(a, wa, b, wb, threshold: float) -> bool:
    """Whether either reading reaches the threshold.

    Set sizes bound plain Jaccard only. The probability Jaccard is at most the smaller share of weight in common shingles.
    """
    if len(a) and len(b) and min(len(a), len(b)) < (threshold - 1e-9) * max(len(a), len(b)):
        _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        if min(wa[ia].sum() / wa.sum(), wb[ib].sum() / wb.sum()) < threshold - 1e-9:
            return False
    return max(similarity(a, wa, b, wb)) >= threshold - 1e-12


def overlaps(sets: list[tuple[np.ndarray, np.ndarray]], often: int = 24, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs: the number of common shingles, and the share of the first set's weight that lies in them.

    Shingles of fewer than `often` sets are counted pair by pair, the others by matrix products.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(v) for v, _ in sets])
    share = np.concatenate([c / c.sum() for _, c in sets])
    repeats = any(len(c) and c.max() > 1 for _, c in sets)
    _, at, times = np.unique(np.concatenate([v for v, _ in sets]), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    starts = np.cumsum(times) - times
    common, mass = np.zeros(n * n), np.zeros(n * n)
    for k in range(2, often):
        same = starts[times == k]
        if not len(same):
            continue
        place = order[same[:, None] + np.arange(k)]
        docs, shares = owner[place], share[place]
        p, q = np.nonzero(~np.eye(k, dtype=bool))
        pairs = (docs[:, p] * n + docs[:, q]).ravel()
        common += np.bincount(pairs, minlength=n * n)
        if repeats:
            mass += np.bincount(pairs, shares[:, p].ravel(), minlength=n * n)
    common, mass = common.reshape(n, n), mass.reshape(n, n)
    many = np.cumsum(times >= often) - 1
    keep = np.flatnonzero(times[at] >= often)
    col, who, part = many[at[keep]], owner[keep], share[keep].astype(np.float32)
    by = np.argsort(col, kind="stable")
    col, who, part = col[by], who[by], part[by]
    for c in range(0, int(many[-1]) + 1 if len(many) else 0, columns):
        i, j = np.searchsorted(col, (c, c + columns))
        width = min(columns, int(many[-1]) + 1 - c)
        has = np.zeros((n, width), np.float32)
        has[who[i:j], col[i:j] - c] = 1
        common += has @ has.T
        if repeats:
            weighted = np.zeros((n, width), np.float32)
            weighted[who[i:j], col[i:j] - c] = part[i:j]
            mass += weighted @ has.T
    if not repeats:
        mass = common / np.array([max(len(v), 1) for v, _ in sets])[:, None]
    return common, mass


def may_be_linked(sets: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Two boolean matrices. The first is false only for pairs that cannot reach the threshold in either reading; the second
    is true for pairs that surely reach it.

    Plain Jaccard follows from the common shingles. The probability Jaccard is at most the smaller share of weight in common
    shingles, and the same as plain Jaccard for two sets without repeated shingles.
    """
    size = np.array([len(v) for v, _ in sets])
    once = np.array([not len(c) or c.max() == 1 for _, c in sets])
    common, mass = overlaps(sets)
    sure = common >= (threshold - 1e-12) * (size[:, None] + size - common)
    return sure | (np.minimum(mass, mass.T) >= threshold - 1e-3) & ~(once[:, None] & once), sure


def _signed(slim: DataFrame, bands: int, rows: int) -> DataFrame:
    """slim(__nd_id, __nd_hash, __nd_text) -> id, hash, key, bands (array of long: distinct buckets of both signatures).

    Without repeated shingles both signatures are the same; with some there are up to two buckets per band.
    """

    def buckets(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        sig = signatures(sets, bands * rows).reshape(len(sets), bands, rows)
        h = np.zeros((len(sets), bands), np.uint64)
        for r in range(rows):
            h = mix(h * GOLDEN + sig[:, :, r])
        return mix(h + np.arange(bands, dtype=np.uint64)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                cut_up = [shingles(t) for t in part.column(2).to_pylist()]
                found = list(buckets([(v, c) for v, c, _ in cut_up]))
                repeats = [i for i, (_, c, _) in enumerate(cut_up) if len(c) and c.max() > 1]
                for i, plain in zip(repeats, buckets([(cut_up[i][0], np.ones_like(cut_up[i][1])) for i in repeats]), strict=True):
                    found[i] = np.union1d(found[i], plain)
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([x for _, _, x in cut_up], pa.binary()), pa.array([len(v) for v, _, _ in cut_up], pa.int32()), flat],
                    ["__nd_id", "__nd_hash", "key", "size", "bands"])
        _HASHES.clear()
        release()

    kind = slim.schema["__nd_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"__nd_id {kind}, __nd_hash long, key binary, size int, bands array<long>")


def _sets(slim: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes, counts) of the nodes(node, __nd_id, __nd_hash) given; only their texts are shuffled."""
    near = maybe_in(slim, F.col("__nd_hash"), nodes, F.col("__nd_hash"), "__nd_maybe").where("__nd_maybe").drop("__nd_maybe")
    n = nodes.select("node", F.col("__nd_id").alias("__i"), F.col("__nd_hash").alias("__h"))
    texts = near.join(n, (near["__nd_hash"] == n["__h"]) & near["__nd_id"].eqNullSafe(n["__i"])).select("node", "__nd_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                got = [shingles(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v, _, _ in got], pa.binary()), pa.array([c.tobytes() for _, c, _ in got], pa.binary())],
                                                 ["node", "hashes", "counts"])
        _HASHES.clear()
        release()

    return texts.mapInArrow(run, "node long, hashes binary, counts binary").dropDuplicates(["node"])


def _arrays(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int32)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs(u, v) whose sets are alike."""
    a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    b = sets.select(F.col("node").alias("v"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):  # both sets of a pair become objects, so few pairs at a time
                part = batch.slice(k, 512)
                u, v, ha, ca, hb, cb = (part.column(n).to_pylist() for n in ("u", "v", "ha", "ca", "hb", "cb"))
                good = [i for i in range(len(u)) if linked(*_arrays(ha[i], ca[i]), *_arrays(hb[i], cb[i]), threshold)]
                yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in good], pa.int64()), pa.array([v[i] for i in good], pa.int64())], ["u", "v"])
        release()

    return pairs.join(a, "u").join(b, "v").mapInArrow(run, "u long, v long")


HOT = 4096


def _dealt(rows: DataFrame, keyed: DataFrame, total: int) -> DataFrame:
    """rows(bucket, ...) joined with keyed(bucket, n, ...), n being the rows of a bucket, `total` of all.

    Buckets with more than 1 / HOT of all rows number HOT at most: they are broadcast, so that their rows stay spread.
    """
    hot = F.col("n") > total / HOT
    right = keyed.withColumnRenamed("bucket", "__b")
    by = F.col("bucket") == F.col("__b")
    cold = right.where(~hot).withColumn("__b", fresh(F.col("__b")))
    return rows.join(F.broadcast(right.where(hot)), by).drop("__b").unionByName(rows.join(cold, by).drop("__b"))


def _unsettled(members: DataFrame, block: int) -> DataFrame:
    """members(bucket, node, label): buckets with several labels, their size n, their most frequent label (main), and the
    numbers of blocks for nodes with that label and for the others."""
    per = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    first = F.max(F.struct("k", "label")).alias("first")
    found = per.groupBy("bucket").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("labels"), first).where("labels > 1")
    blocks = lambda rows: F.ceil(rows / block).cast("int")
    return found.select("bucket", "n", F.col("first.label").alias("main"), blocks(F.col("first.k")).alias("mains"), blocks(F.col("n") - F.col("first.k")).alias("minors"))


def _within_blocks(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """placed(bucket, node, label, main, mains, minors): links between nodes of different labels in a bucket.

    A task compares two blocks at most; blocks of the bucket's main label are not compared with each other.
    """
    minor = F.col("label") != F.col("main")
    at = F.when(minor, F.col("mains") + F.pmod(F.xxhash64("node"), F.col("minors"))).otherwise(F.pmod(F.xxhash64("node"), F.col("mains"))).cast("int")
    others = F.sequence(F.when(minor, 0).otherwise(F.col("mains")), F.col("mains") + F.col("minors") - 1)
    tasks = placed.withColumn("at", at).withColumn("other", F.explode(others)).select(
        "bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "node", "label", "at")

    def run(pdf):
        import pandas as pd

        root = {x: x for x in pdf["label"]}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        rows = [(r.node, r.label, r.at, *_arrays(r.hashes, r.counts)) for r in pdf.itertuples()]
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        found = []
        labels, places = pdf["label"].to_numpy(), pdf["at"].to_numpy()
        may, sure = may_be_linked([(h, c) for *_, h, c in rows], threshold)
        may &= (labels[:, None] != labels) & ((places[:, None] != places) | (i == j))
        for p, q in zip(*np.nonzero(np.triu(may, 1)), strict=True):
            (u, lu, _, a, wa), (v, lv, _, b, wb) = rows[p], rows[q]
            if find(lu) != find(lv) and (sure[p, q] or linked(a, wa, b, wb, threshold)):
                root[find(lu)] = find(lv)
                found.append((u, v))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return tasks.join(sets, "node").groupBy("bucket", "i", "j").applyInPandas(run, "u long, v long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
            block: int = 512) -> DataFrame:
    """One row per document: id, class_id, class_size, kept (and __nd_hash, a hash of the text, with which a row is found again)."""
    slim = docs.select(F.col(id_col).alias("__nd_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__nd_hash"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("__nd_text"))
    signed = cut(_signed(slim, bands, rows).withColumn("uid", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("__nd_id").isNull().alias("no_id"), F.col("__nd_id").alias("id"), F.col("uid"), F.col("__nd_hash").alias("hash")))
    nodes = cut(signed.groupBy("key").agg(first.alias("f"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
                .select("key", F.col("f.uid").alias("node"), F.col("f.id").alias("__nd_id"), F.col("f.hash").alias("__nd_hash"), "size", "bands", "copies"))
    placed = nodes.where("size > 0").select("node", F.explode("bands").alias("bucket"))
    leaders = cut(placed.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n"))
                  .where("leader < last").select("bucket", "leader", "n"))
    total = leaders.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = cut(_dealt(placed, leaders, total).drop("n"))
    pairs = cut(members.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct())
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = cut(_sets(slim, nodes.join(wanted, "node").select("node", "__nd_id", "__nd_hash")))
    links = cut(_verified(pairs, sets, threshold))
    labels = components(links)
    open_members = members.where("node <> leader").join(labels.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "bucket", "node", "leader", F.coalesce("label", "node").alias("label"))
    open_members = cut(open_members.select("bucket", "node", "label"))
    rest = cut(_dealt(open_members, cut(_unsettled(open_members, block)), total))
    more = cut(_within_blocks(rest, sets, threshold).distinct())
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    node_labels = nodes.select("key", "node").join(labels.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "key", F.coalesce("label", "node").alias("label"))
    labelled = signed.select("__nd_id", "__nd_hash", "uid", "key").join(node_labels, "key")
    best = F.min(F.struct(F.col("__nd_id").isNull().alias("no_id"), F.col("__nd_id").alias("id"), F.col("uid")))
    heads = labelled.groupBy("label").agg(best.alias("best"), F.count(F.lit(1)).alias("class_size")).select(fresh(F.col("label")).alias("l"), "best", "class_size")
    return labelled.join(heads, F.col("label") == F.col("l")).select(
        F.col("__nd_id").alias(id_col), F.col("best.id").alias("class_id"), "class_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "__nd_hash")


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class, all columns as they were. Only texts of classes of two or more are shuffled."""
    found = cut(classes(docs, id_col, text_col, **options).where("class_size > 1").withColumnRenamed(id_col, "__nd_i"))
    hashed = docs.withColumn("__nd_row", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    flagged = maybe_in(hashed, F.col("__nd_row"), found, F.col("__nd_hash"), "__nd_maybe")
    possible = flagged.where("__nd_maybe")
    known = found.groupBy("__nd_i", "__nd_hash").agg(F.max("kept").alias("__nd_kept"))
    judged = possible.join(known, (F.col("__nd_row") == F.col("__nd_hash")) & F.col(id_col).eqNullSafe(F.col("__nd_i")), "left")
    alone = judged.where("__nd_kept is null").select(*docs.columns)
    heads = judged.where("__nd_kept").withColumn("__nd_k", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).dropDuplicates(["__nd_k", "__nd_row"]).select(*docs.columns)
    return flagged.where(~F.col("__nd_maybe")).select(*docs.columns).unionByName(alone).unionByName(heads)
