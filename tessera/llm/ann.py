"""Approximate nearest neighbours with a permutation index.

Pivots are a bounded sample of the vectors (`pivots` rows with the smallest hash of their id). Each vector is represented
by its `prefix` nearest pivots in order; blocks of the index post their vectors in one inverted file per pivot. A query
gathers the posting lists of its own nearest pivots, ranks what it meets by the footrule distance of the two orders
(absent pivots count as position prefix + 1), and the best `least` or, if that is more, the best `share` of all, each block
its part, are reranked by the exact inner product in double precision. For inner products of vectors of different length, vectors get one more component for the index
that makes all lengths equal. Identical vectors are searched once and expanded afterwards (their smallest ids suffice).
Queries meet the index in blocks of bounded size; no row is skipped. Between blocks, vectors and their pivots travel as
bytes, and an index block is sent once for each `query_block` queries.

The work is (queries x vectors) / pivots x prefix^2 additions in numpy, so with a query set that grows with the table it
grows faster than the table. Vectors without clusters, whose neighbours are hardly nearer than the rest, need a share of
all rows as candidates for a recall of 0.9; with clusters a smaller `share` does.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; vectors of different
lengths have no inner product, so each length is searched by itself; rows with a null id take no part; a row that repeats
an id and a vector counts once; ties go to the smaller id; fewer candidates than k give fewer rows; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))
    return v.withColumn("vec", F.transform("vec", lambda x: x + 0.0)).dropDuplicates(["id", "vec"])  # -0.0 becomes 0.0


def _augmented(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1, keepdims=True), 0))])


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int, longest: float | None) -> np.ndarray:
    """The nearest pivots of each row of x in order; `longest` None for queries, whose extra component is 0."""
    a = np.hstack([x, np.zeros((len(x), 1))]) if longest is None else _augmented(x, longest)
    near = a @ pivots.T
    top = np.argpartition(-near, min(prefix, near.shape[1]) - 1, axis=1)[:, :prefix]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


class Block:
    """Inverted files of one block of the index."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, order: np.ndarray, pivots: int):
        self.ids, self.x, self.prefix = ids, x, order.shape[1]
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.start = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.row, self.place = (by // self.prefix).astype(np.int32), (by % self.prefix).astype(np.int16)

    def search(self, q: np.ndarray, order: np.ndarray, most: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the block and inner products of the k best of the `most` nearest by footrule."""
        lists = [slice(self.start[p], self.start[p + 1]) for p in order]
        rows = np.concatenate([self.row[s] for s in lists])
        # footrule = constant - 2 * sum over common pivots of (prefix - max(place, place))
        gain = np.concatenate([self.prefix - np.maximum(self.place[s], np.int16(i)) for i, s in enumerate(lists)])
        score = np.bincount(rows, gain, minlength=len(self.ids))
        near = np.argpartition(-score, most - 1)[:most] if most < len(score) else np.arange(len(score))
        rough = self.x[near] @ q
        if len(near) > 4 * k:  # the final order is taken from sums that do not depend on a row's place
            near = near[np.argpartition(-rough, 2 * k)[:2 * k]]
            near = near[np.argsort(near)]
        exact = (self.x[near] * q).sum(1)
        best = np.lexsort((self.ids[near], -exact))[:k]
        return near[best], exact[best]


def search(vectors: DataFrame, queries, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 20, pivots: int = 512, prefix: int = 64,
           share: float = 0.16, least: int = 256, index_block: int = 16384, query_block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id satisfies `queries` (id column -> boolean)."""
    valid = cut(_valid(vectors, id_col, vec_col))
    lengths = [r["d"] for r in valid.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect()]
    found = [_search(valid.where(F.size("vec") == d), queries, k, pivots, prefix, share, least, index_block, query_block) for d in lengths]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return functools.reduce(DataFrame.unionByName, found) if found else empty


def _search(valid: DataFrame, queries, k: int, pivots: int, prefix: int, share: float, least: int, index_block: int, query_block: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = valid.sparkSession
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    reps = cut(valid.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
               .select(F.get("ids", F.lit(0)).alias("rep"), "vec", "ids"))
    asked = cut(valid.where(queries(F.col("id"))).join(reps.select("vec", "rep"), "vec").select(F.col("id").alias("query_id"), "rep", "vec"))
    total, longest2 = reps.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    distinct = asked.dropDuplicates(["rep"]).select("rep", "vec")
    n_queries = distinct.count()
    longest = float(np.sqrt(longest2))
    chosen = reps.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(pivots).collect()
    p = _augmented(np.array([r["vec"] for r in sorted(chosen, key=lambda r: r["rep"])]), longest)
    sent = spark.sparkContext.broadcast(p)
    index_blocks, query_blocks = -(-total // index_block), max(1, -(-n_queries // query_block))
    wanted_share = min(max(share, least / total), 1.0)

    def ordered(of_queries: bool):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    x = np.ascontiguousarray(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
                    o = orders(x, sent.value, prefix, None if of_queries else longest).astype(np.int16)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in o], pa.binary())], ["rep", "x", "places"])

        return run

    schema = "rep long, x binary, places binary"
    block = lambda n: F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = reps.select("rep", "vec").mapInArrow(ordered(False), schema).withColumn("ib", block(index_blocks)).withColumn("qb", every(query_blocks))
    wanted = distinct.mapInArrow(ordered(True), schema).withColumn("qb", block(query_blocks)).withColumn("ib", every(index_blocks))

    def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = len(pdf)
        return pdf["rep"].to_numpy(), np.frombuffer(b"".join(pdf["x"]), np.float64).reshape(rows, -1), np.frombuffer(b"".join(pdf["places"]), np.int16).reshape(rows, -1)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "rep": [], "score": []})
        b = Block(*arrays(left.sort_values("rep")), len(sent.value))
        asking, q, order = arrays(right)
        found = [b.search(v, o, int(np.ceil(wanted_share * len(left))), k + 1) for v, o in zip(q, order, strict=True)]
        return pd.DataFrame({
            "query": np.repeat(asking, [len(at) for at, _ in found]),
            "rep": b.ids[np.concatenate([at for at, _ in found])], "score": np.concatenate([x for _, x in found])})

    hits = index.groupBy("ib", "qb").cogroup(wanted.groupBy("ib", "qb")).applyInPandas(meet, "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    rows = hits.join(reps.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    rows = asked.select("query_id", "rep").join(rows, F.col("rep") == F.col("query")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
