"""LM scoring with a hashed maximum-entropy model, class-factored.

p(token | history) = p(class | history) * p(slot | class, history) * p(token | slot). The most frequent tokens have a class
each, the end of a text has one, and all other tokens are dealt to `ENDINGS` classes by their ending; within such a class
tokens are dealt to `SLOTS` slots by their hash. Both of the first factors are softmaxes over hashed features of the
history: the word before, the word before that (a skip) and the pair of both for the class; the word before and the skip
for the slot, hashed within the class. The last factor is the token's share of its slot's training tokens. Each class keeps
a share for unknown tokens by the Good-Turing estimate (tokens seen once / all tokens), and "an unknown token of this class"
is one event, without a slot, so probabilities sum to one.

Training: exact token counts of all training texts; then two gradient updates over all training texts, each a sum over
tasks. At weights of zero the expected count of (feature, outcome) is known without a pass, so the first update needs only
the observed counts, which are integers; its step is `SHARE` of the log ratio of both. The second takes observed minus
expected counts at the new weights, scaled by the expected ones. No update depends on the order of texts or on partitions
(sums of expected counts do in their last digits, about 1e-7). Scoring runs in numpy batches.

A token is known by a 64-bit number: a hash, the lowest bits of which are its ending's class. Counts of the most frequent
tokens (at most `head` of them, all with a count over some bound) are broadcast, 16 bytes each; rarer ones, of which none
can hold a large share of the tokens, are joined with their counts in Spark. This is the plan at every size.

Defined results: A-Z is lower-cased; tokens are runs outside [\\x20\\x09-\\x0D] and one end per text; null text counts as
empty (its end alone); very long texts are read whole, in chunks cut at white space; among tokens of equal count the
smaller number is the more frequent one; documents with a null id belong to the training side; repeated rows each count
and get a row; without training texts all counts are 0. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, fold, release

TOP, ENDINGS, SLOTS = 15, 32, 32  # powers of two: endings and slots are bits of a token's number
CLASSES = TOP + ENDINGS + 1
END_CLASS = CLASSES - 1
END = np.uint64(0xE4D0F7E275A1C600)
BUCKETS, SLOT_BUCKETS = 1 << 15, 1 << 10  # rows of weights: of classes; of the slots of one class
CHUNK, BLOCK, TASK_TOKENS = 1 << 18, 512, 1 << 22
PRIOR, SHARE, RATE, CALM = 100.0, 0.6, 0.5, 400.0
LOG10 = float(np.log(10.0))
MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
FIRST, SECOND = np.uint32(0x51ED270B), np.uint32(0x2545F491)  # stand for the words before a text

SOLID = np.ones(256, bool)
SOLID[[0x20, *range(9, 14)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = np.where(SOLID, LOWER.astype(np.uint64) + np.uint64(1), np.uint64(0))  # white space adds nothing to a sum
PLAIN = np.ones(256, bool)  # bytes that are not signs at a word's end
PLAIN[list(b".,;:!?|#$%&*")] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PLACES = 1 << 12
FACTORS = mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of the tokens raw[start:end]; between them is white space."""
    value = VALUES.take(raw)
    at = np.arange(len(raw), dtype=np.int32)
    place = at[starts[0]:] - np.repeat(starts.astype(np.int32), np.diff(starts, append=len(raw)))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value[starts[0]:] * FACTORS.take(place & np.int32(PLACES - 1)), out=sums[starts[0] + 1:])
    h = sums[ends] - sums[starts]
    sizes = ends - starts
    if sizes.max() > PLACES:  # factors come again: bind each byte to its round as well
        np.cumsum(value[starts[0]:] * mix((place // PLACES).astype(np.uint64)), out=sums[starts[0] + 1:])
        h += sums[ends] - sums[starts]
    h = mix(h + sizes.astype(np.uint64))
    last = ends - 1  # of the bytes before any signs
    signs = np.flatnonzero(~PLAIN.take(raw[last]))
    for _ in range(8):
        if not len(signs):
            break
        last[signs] -= 1
        signs = signs[(last[signs] >= starts[signs]) & ~PLAIN.take(raw[last[signs]])]
    if len(signs):
        last[signs] = np.maximum.accumulate(np.where(PLAIN.take(raw), at, np.int32(-1)))[last[signs]]
    code = np.zeros(len(starts), np.uint32)
    for k in range(3):
        i = last - k
        code = code * np.uint32(257) + np.where(i >= starts, LOWER.take(raw[np.maximum(i, 0)]), 0).astype(np.uint32)
    kind = ((code * MULT[1]) >> np.uint32(16)) & np.uint32(ENDINGS - 1)
    return (h & ~np.uint64(ENDINGS - 1)) | kind.astype(np.uint64)


@dataclass
class Chunk:
    """Consecutive tokens: their numbers, the row of each one's text in the batch, and the codes of the two words before."""

    ids: np.ndarray
    docs: np.ndarray
    one: np.ndarray
    two: np.ndarray


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """The tokens of a column of texts without nulls, in chunks of about `size` bytes; texts are cut at white space only."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    begin, stop = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    a = doc = 0
    carried = FIRST, SECOND
    while doc < len(stop):
        b = min(a + size, len(raw))
        if b < len(raw):
            whole = int(np.searchsorted(stop, b, "right"))
            if whole > doc and stop[whole - 1] > a:
                b = int(stop[whole - 1])
            else:  # inside a long text: up to the next white space
                while b < stop[doc] and SOLID[raw[b:b + 4096][:stop[doc] - b]].all():
                    b = min(b + 4096, int(stop[doc]))
                if b < stop[doc]:
                    b += int(np.argmin(SOLID[raw[b:b + 4096]]))
        until = int(np.searchsorted(stop, b, "right"))
        inside = a > begin[doc]
        chunk = _chunk(raw[a:b], a, stop, doc, until, carried if inside else (FIRST, SECOND))
        if len(chunk.ids):
            carried = np.uint32(chunk.ids[-1] >> np.uint64(32)), chunk.one[-1]
            yield chunk
        a, doc = b, until


def _chunk(raw: np.ndarray, at: int, stop: np.ndarray, doc: int, until: int, carried: tuple) -> Chunk:
    """raw: bytes from position `at`; the texts from doc to until - 1 end in it."""
    solid = SOLID.take(raw)
    edges = (stop[doc:until] - at)
    new, old = solid.copy(), solid.copy()
    new[1:] &= ~solid[:-1]
    old[:-1] &= ~solid[1:]
    inner = edges[(edges > 0) & (edges < len(raw))]
    new[inner] = solid[inner]
    old[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(new), np.flatnonzero(old) + 1
    text = np.searchsorted(stop, starts + at, "right")
    n, closing = len(starts), np.arange(doc, until)
    ids, docs = np.empty(n + len(closing), np.uint64), np.empty(n + len(closing), np.int64)
    place = np.searchsorted(text, closing, "right") + np.arange(len(closing))
    is_end = np.zeros(len(ids), bool)
    is_end[place] = True
    ids[place], docs[place] = END, closing
    if n:
        ids[~is_end] = numbers(raw, starts, ends)
        docs[~is_end] = text
    code = (ids >> np.uint64(32)).astype(np.uint32)
    one, two = np.empty_like(code), np.empty_like(code)
    if len(ids):
        after = np.flatnonzero(is_end[:-1]) + 1  # the first of each next text
        one[1:], one[0] = code[:-1], carried[0]
        one[after] = FIRST
        two[1:], two[0] = one[:-1], carried[1]
        two[after] = SECOND
    return Chunk(ids, docs, one, two)


class Classes:
    """The class of each token; tokens beyond the frequent ones also have a slot."""

    def __init__(self, top: list[int]):
        self.top = np.array(top, np.uint64)
        self.bits = next(k for k in range(16, 64) if len(set((self.top & np.uint64((1 << k) - 1)).tolist())) == len(top)) if top else 16
        self.table = np.zeros(1 << self.bits, np.uint8)
        self.table[(self.top & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = np.arange(1, len(top) + 1)

    def of(self, ids: np.ndarray) -> np.ndarray:
        y = (TOP + (ids & np.uint64(ENDINGS - 1))).astype(np.int64)
        maybe = self.table[(ids & np.uint64((1 << self.bits) - 1)).astype(np.int64)]
        at = np.flatnonzero(maybe)
        k = maybe[at].astype(np.int64) - 1
        same = self.top[k] == ids[at]
        y[at[same]] = k[same]
        y[ids == END] = END_CLASS
        return y


def slots(ids: np.ndarray) -> np.ndarray:
    return ((ids >> np.uint64(5)) & np.uint64(SLOTS - 1)).astype(np.int64)


def class_rows(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Rows of weights of the features of each history."""
    mixed = lambda x: (((x ^ (x >> np.uint32(15))) * MULT[1]) >> np.uint32(32 - 15)).astype(np.uint16)
    return [mixed(one * MULT[0] + np.uint32(1)), mixed(two * MULT[0] + np.uint32(7)), mixed(one * MULT[2] ^ two * MULT[0])]


def slot_rows(one: np.ndarray, two: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
    """Rows of weights of the features within the class TOP + kind."""
    mixed = lambda x: (((x ^ (x >> np.uint32(13))) * MULT[2]) >> np.uint32(32 - 10)).astype(np.uint16)
    base = (kind * SLOT_BUCKETS).astype(np.uint16)
    return [base + mixed(one * MULT[1] + np.uint32(3)), base + mixed(two * MULT[1] + np.uint32(11))]


class Model:
    """Weights of both softmaxes: constants, and a row for each hashed feature. They are small enough to need no scaling before exp()."""

    def __init__(self, classes: Classes, constant: np.ndarray, slot_constant: np.ndarray, w: np.ndarray | None = None, v: np.ndarray | None = None):
        self.classes, self.b, self.c = classes, constant.astype(np.float32), slot_constant.astype(np.float32)
        self.w = np.zeros((BUCKETS, CLASSES), np.float32) if w is None else w.astype(np.float32)
        self.v = np.zeros((ENDINGS * SLOT_BUCKETS, SLOTS), np.float32) if v is None else v.astype(np.float32)

    def class_sums(self, rows: list[np.ndarray]) -> np.ndarray:
        z = self.w.take(rows[0], axis=0)
        for r in rows[1:]:
            z += self.w.take(r, axis=0)
        z += self.b
        return z

    def slot_sums(self, rows: list[np.ndarray], kind: np.ndarray) -> np.ndarray:
        z = self.c.take(kind, axis=0)
        for r in rows:
            z += self.v.take(r, axis=0)
        return z

    def log_probabilities(self, c: Chunk, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its class, ln p(class | history) and ln p(slot | class, history)."""
        y, s = self.classes.of(c.ids), slots(c.ids)
        p, inside = np.empty(len(y)), np.zeros(len(y))

        def chosen(z: np.ndarray, k: np.ndarray) -> np.ndarray:
            mine = z[np.arange(len(z)), k].astype(np.float64)
            return mine - np.log(np.einsum("ij->i", np.exp(z, out=z)).astype(np.float64))

        for i in range(0, len(y), block):  # stays in the processor's cache
            part = slice(i, i + block)
            p[part] = chosen(self.class_sums(class_rows(c.one[part], c.two[part])), y[part])
            wide = np.flatnonzero((y[part] >= TOP) & (y[part] < END_CLASS))
            kind = y[part][wide] - TOP
            inside[i + wide] = chosen(self.slot_sums(slot_rows(c.one[part][wide], c.two[part][wide], kind), kind), s[part][wide])
        return y, p, inside


def softmax(z: np.ndarray) -> np.ndarray:
    np.exp(z, out=z)
    z *= (1 / np.einsum("ij->i", z))[:, None]
    return z


def _add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray, rounds: int = 4) -> None:
    """total[rows] += values, for repeated rows too: the first few of each row at once in turn, then the sums of the others."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order].astype(np.int64)
    at = np.arange(len(rows))
    turn = at - np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), at, 0))
    for k in range(rounds):
        now = np.flatnonzero(turn == k)
        if not len(now):
            return
        r = ordered[now]
        sums = total.take(r, axis=0)
        sums += values.take(order[now], axis=0)
        total[r] = sums
    rest = np.flatnonzero(turn >= rounds)
    if len(rest):
        r = ordered[rest]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        total[r[first]] += np.add.reduceat(values.take(order[rest], axis=0), first, axis=0)


def count_tokens(docs: DataFrame, text_col: str, flush: int = 1 << 22) -> DataFrame:
    """(id long, c long) over all texts, the end of a text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            ids, c = np.unique(np.concatenate(seen), return_counts=True)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(c.astype(np.int64))], ["id", "c"])

        waiting = 0
        for b in batches:
            for c in chunks(b.column(0)):
                seen.append(c.ids)
                waiting += len(c.ids)
                if waiting > flush:
                    yield rows()
                    waiting = 0
        if seen:
            yield rows()
        release()

    return docs.select(_text(text_col)).mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))


def _text(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")


def _summed(docs: DataFrame, text_col: str, tokens: int, collect: Callable[[np.ndarray, np.ndarray, Chunk], None], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """collect(class sums, slot sums, chunk) over all chunks of all texts, added up over the tasks.

    Tasks send blocks of rows; every adding task holds one sum of each block, whatever the number of tasks. Small partitions
    are read together, so that what is sent (two matrices a task) stays in proportion to the `tokens` that are read.
    """
    docs = docs.coalesce(max(-(-tokens // TASK_TOKENS), docs.sparkSession.sparkContext.defaultParallelism))
    shapes = (BUCKETS, CLASSES), (ENDINGS * SLOT_BUCKETS, SLOTS)
    wide = np.int64 if kind is np.int32 else np.float64
    split = BUCKETS // BLOCK
    schema = "block int, salt int, data binary"

    def blocks(sums: list[np.ndarray], salt: int) -> pa.RecordBatch:
        data = [x[i:i + BLOCK].astype(kind).tobytes() for x in sums for i in range(0, len(x), BLOCK)]
        return pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int32()), pa.array([salt] * len(data), pa.int32()), pa.array(data, pa.binary())], ["block", "salt", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % 16
        near, sums, met, new = [np.zeros(s, kind) for s in shapes], [np.zeros(s, wide) for s in shapes], 0, 0

        def settle() -> None:
            for x, y in zip(sums, near, strict=True):
                x += y
                y[:] = 0

        for b in batches:
            for c in chunks(b.column(0)):
                collect(*near, c)
                met, new = met + len(c.ids), new + len(c.ids)
                if new > 1 << 20:
                    settle()
                    new = 0
                if met >= 1 << 30:  # what is sent has 32 bits
                    settle()
                    yield blocks(sums, salt)
                    sums, met, new = [np.zeros(s, wide) for s in shapes], 0, 0
        if met:
            settle()
            yield blocks(sums, salt)
        release()

    def add(read: type, write: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for k, s, d in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    x = np.frombuffer(d, read).astype(write)
                    total[k, s] = total[k, s] + x if (k, s) in total else x
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([s for _, s in total], pa.int32()),
                                                  pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "salt", "data"])

        return run

    parts = docs.select(_text(text_col)).mapInArrow(run, schema).repartition("block", "salt").mapInArrow(add(kind, wide), schema)
    got = parts.withColumn("salt", F.lit(0)).repartition("block").mapInArrow(add(wide, wide), schema).collect()  # two matrices of a fixed size
    out = [np.zeros(s, wide) for s in shapes]
    for r in got:
        which, k = divmod(r["block"], split)
        out[which][k * BLOCK:(k + 1) * BLOCK] = np.frombuffer(bytes(r["data"]), wide).reshape(BLOCK, -1)
    return out[0], out[1]


def observe(classes: Classes) -> Callable[[np.ndarray, np.ndarray, Chunk], None]:
    """Counts of (feature, outcome)."""

    def collect(n: np.ndarray, m: np.ndarray, c: Chunk) -> None:
        y = classes.of(c.ids)
        one = np.int32(1)
        for r in class_rows(c.one, c.two):
            np.add.at(n.reshape(-1), r * np.int64(CLASSES) + y, one)
        wide = np.flatnonzero((y >= TOP) & (y < END_CLASS))
        s = slots(c.ids[wide])
        for r in slot_rows(c.one[wide], c.two[wide], y[wide] - TOP):
            np.add.at(m.reshape(-1), r * np.int64(SLOTS) + s, one)

    return collect


def expect(model: Model, block: int = 4096) -> Callable[[np.ndarray, np.ndarray, Chunk], None]:
    """Expected counts of (feature, outcome) under the model."""

    def collect(n: np.ndarray, m: np.ndarray, c: Chunk) -> None:
        y = model.classes.of(c.ids)
        for i in range(0, len(y), block):
            one, two, k = c.one[i:i + block], c.two[i:i + block], y[i:i + block]
            rows = class_rows(one, two)
            p = softmax(model.class_sums(rows))
            for r in rows:
                _add_rows(n, r, p)
            wide = np.flatnonzero((k >= TOP) & (k < END_CLASS))
            if len(wide):
                kind = k[wide] - TOP
                rows = slot_rows(one[wide], two[wide], kind)
                p = softmax(model.slot_sums(rows, kind))
                for r in rows:
                    _add_rows(m, r, p)

    return collect


def first_update(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """From zero weights: `SHARE` of the log ratio of observed and expected counts, both with a prior of PRIOR tokens."""
    return SHARE * np.log((n + PRIOR * p) / ((n.sum(1, keepdims=True) + PRIOR) * p))


def second_update(n: np.ndarray, e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The gradient, observed minus expected counts, scaled by the expected ones."""
    return np.clip(RATE * (n - e) / (e + CALM * p + 20.0), -1, 1)


def train(docs: DataFrame, text_col: str, classes: Classes, leaves: np.ndarray) -> Model:
    """leaves: training tokens of each leaf, see leaf_of()."""
    by_class, by_slot = _leaf_sums(leaves)
    p = (by_class + 0.5) / (by_class + 0.5).sum()
    q = (by_slot + 0.5) / (by_slot + 0.5).sum(1, keepdims=True)
    q_rows = np.repeat(q, SLOT_BUCKETS, axis=0)
    n, m = _summed(docs, text_col, int(leaves.sum()), observe(classes), np.int32)
    model = Model(classes, np.log(p), np.log(q), first_update(n, p), first_update(m, q_rows))
    e, f = _summed(docs, text_col, int(leaves.sum()), expect(model), np.float32)
    return Model(classes, np.log(p), np.log(q), model.w + second_update(n, e, p), model.v + second_update(m, f, q_rows))


LEAVES = TOP + 1 + ENDINGS * SLOTS


def leaf_of(ids: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The frequent tokens' classes, the end, then every slot of every ending."""
    return np.where(y < TOP, y, np.where(y == END_CLASS, TOP, TOP + 1 + (y - TOP) * SLOTS + slots(ids)))


def _leaf_sums(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by_slot = leaves[TOP + 1:].reshape(ENDINGS, SLOTS)
    return np.concatenate([leaves[:TOP], by_slot.sum(1), leaves[TOP:TOP + 1]]).astype(float), by_slot.astype(float)


def leaf_totals(counts: DataFrame, classes: Classes) -> np.ndarray:
    """For each leaf: tokens, and tokens seen once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LEAVES, 2), np.int64)
        for b in batches:
            ids, c = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            leaf = leaf_of(ids, classes.of(ids))
            np.add.at(total[:, 0], leaf, c)
            np.add.at(total[:, 1], leaf[c == 1], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEAVES), pa.int64()), pa.array(total[:, 0]), pa.array(total[:, 1])], ["k", "n", "once"])

    out = np.zeros((LEAVES, 2), np.int64)
    for r in counts.select("id", "c").mapInArrow(run, "k long, n long, once long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect():
        out[r["k"]] = r["n"], r["once"]
    return out


class Leaves:
    """Beside the class's and the slot's, the last factors: known[leaf] + ln(count) for known tokens; for others, whose slot
    does not count, unknown[leaf]."""

    def __init__(self, totals: np.ndarray):
        n = totals[:, 0].astype(float)
        by_class, once = (x.sum(1) for x in (n[TOP + 1:].reshape(ENDINGS, SLOTS), totals[TOP + 1:, 1].reshape(ENDINGS, SLOTS)))
        fresh = np.where(by_class > 0, np.minimum((once + 0.5) / (by_class + 1), 0.5), 1.0)
        fresh = np.concatenate([np.zeros(TOP + 1), np.repeat(fresh, SLOTS)])  # frequent tokens and the end are known
        single = np.arange(LEAVES) <= TOP
        with np.errstate(divide="ignore"):
            self.known = np.where(single | (n == 0), 0.0, np.log1p(-np.where(n > 0, fresh, 0.0)) - np.log(np.maximum(n, 1)))
            self.unknown = np.where(single, 0.0, np.log(fresh))


class Counts:
    """An open hash table from numbers to counts."""

    def __init__(self, ids: np.ndarray, c: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(ids)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.c, self.used = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, bool)
        at, left = (ids >> self.shift).astype(np.int64), np.arange(len(ids))
        while len(left):
            slot, first = np.unique(at[left], return_index=True)
            free = ~self.used[slot]
            put = left[first[free]]
            self.keys[slot[free]], self.c[slot[free]], self.used[slot[free]] = ids[put], c[put], True
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + self.used[at[left]]) & (size - 1)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Counts; -1 for numbers that are not in the table."""
        at = (ids >> self.shift).astype(np.int64)
        out = np.where(self.used[at] & (self.keys[at] == ids), self.c[at], -1)
        left = np.flatnonzero((out < 0) & self.used[at])
        while len(left):
            at[left] = (at[left] + 1) & (len(self.c) - 1)
            here = at[left]
            same = self.used[here] & (self.keys[here] == ids[left])
            out[left[same]] = self.c[here[same]]
            left = left[self.used[here] & ~same]
        return out


_TABLES: dict[str, Counts] = {}  # of a worker process: the last one in use


def _head(counts: DataFrame, most: int) -> DataFrame:
    """The tokens with a count over a bound, `most` at most."""
    level = F.floor(F.log2("c") * 8).cast("int")
    bound, total = 0, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # at most 512 levels
        total += r["n"]
        if total > most:
            bound = r["level"] + 1
            break
    return counts.where(level >= bound)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, modulus: int = 5, held: int = 1, head: int = 1 << 19) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    training = docs.where(fold(id_col, modulus) != held)
    counts = cut(count_tokens(training, text_col))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end = int(END.view(np.int64))
    classes = Classes([r["id"] % (1 << 64) for r in counts.where(F.col("id") != end).orderBy(F.desc("c"), "id").limit(TOP).collect()])
    totals = leaf_totals(counts, classes)
    model, leaves = train(training, text_col, classes, totals[:, 0]), Leaves(totals)
    frequent = _head(counts, head).toArrow()  # at most `head` rows of 16 bytes
    sent = spark.sparkContext.broadcast((model, leaves, frequent.column(0).to_numpy().view(np.uint64), frequent.column(1).to_numpy()))
    number = uuid.uuid4().hex
    whole = 0.5 * (v + 1) + n
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "held_out", "uid", "n_tokens", "n_known", "base", "score", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, leaves, ids, cs = sent.value
        if number not in _TABLES:
            _TABLES.clear()
            _TABLES[number] = Counts(ids, cs)
        table = _TABLES[number]
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                b = batch.slice(k, 1024)
                out = np.zeros((4, b.num_rows))
                rare_ids, rare_leaves, rare_slots, rare_docs = [], [], [], []
                for c in chunks(b.column(3)):
                    y, p, slot = model.log_probabilities(c)
                    leaf, count = leaf_of(c.ids, y), table.of(c.ids)
                    known = count >= 0
                    some = np.maximum(count, 1)
                    inside = np.where(leaf <= TOP, 0.0, slot + leaves.known[leaf] + np.log(some))
                    base = np.log10((some + 0.5) / whole)
                    for i, x in enumerate((np.ones(len(y)), known, np.where(known, base, 0.0), p + np.where(known, inside, 0.0))):
                        out[i] += np.bincount(c.docs, x, b.num_rows)
                    rare = np.flatnonzero(~known)
                    rare_ids.append(c.ids[rare])
                    rare_leaves.append(leaf[rare])
                    rare_slots.append(slot[rare])
                    rare_docs.append(c.docs[rare])
                ends = np.cumsum(np.concatenate([[0], np.bincount(np.concatenate(rare_docs), minlength=b.num_rows)]))
                rows = pa.StructArray.from_arrays([pa.array(np.concatenate(rare_ids).view(np.int64)), pa.array(np.concatenate(rare_leaves).astype(np.int32)),
                                                   pa.array(np.concatenate(rare_slots))], ["id", "leaf", "slot"])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(out[2]),
                                                  pa.array(out[3]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names)
        release()

    slim = docs.select(F.col(id_col).alias("id"), (fold(id_col, modulus) == held).alias("held_out"), F.monotonically_increasing_id().alias("uid"), _text(text_col))
    scored = cut(slim.mapInArrow(run, f"id {kind}, held_out boolean, uid long, n_tokens long, n_known long, base double, score double, rare array<struct<id:long,leaf:int,slot:double>>"))
    terms = spark.createDataFrame([(i, float(leaves.known[i]), float(leaves.unknown[i])) for i in range(LEAVES)], "leaf int, known double, unknown double")
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.id", "r.leaf", "r.slot").join(counts, "id", "left").join(F.broadcast(terms), "leaf")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy(F.col("uid").alias("u")).agg(
        F.sum((c > 0).cast("long")).alias("more"), F.sum(F.log10((c + 0.5) / F.lit(float(whole)))).alias("rare_base"),
        F.sum(F.when(F.col("leaf") <= TOP, 0.0).when(c > 0, F.col("slot") + F.log("c") + F.col("known")).otherwise(F.col("unknown"))).alias("rare_score"))
    zero = F.lit(0.0)
    return scored.drop("rare").join(sums, F.col("uid") == F.col("u"), "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"), ((F.col("score") + F.coalesce("rare_score", zero)) / LOG10).alias("score"))
