"""Language ID with a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, kernel ridge regression.

A text's features are the presence (not the count) of its character n-grams, n = 1..`max_n`, hashed to `buckets`. The
kernel of two texts is the normalised number of n-grams that both hold. A long text would fill the buckets: it is cut
into even, consecutive chunks of at most `CHUNK` characters, which together hold all its n-grams, and counts as the mean
of its chunks, as training text, as landmark and in scoring. Landmark texts span a Nystroem map, on which
one-versus-rest ridge regression is solved (`landmarks` of them, or two for each language if that is more); texts are scored in batches by matrix products. The fit uses at most
`per_label` training texts of each language, those with the smallest hash of their id; the sample is collected as bit
vectors (buckets / 8 bytes a text) or means of chunks (two bytes a bucket), never as texts.

Defined results: null texts and texts without a letter are `und` with score 0; training rows need a language, a letter
and a fold other than the held-out one; if no language can be learned, everything is `und`. Repeated rows each get a
row; null ids fall into fold 0; other columns are not read; among equal margins the first language in alphabetical order
is taken; very long texts are read whole; an empty table gives an empty result. The number of languages is taken to be
bounded: the driver holds the sample of every one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fold, release, unused

UNDETERMINED = "und"
CHUNK = 1024
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def presence(texts: list[str], buckets: int, max_n: int) -> np.ndarray:
    """uint8 matrix: which hashed n-grams each text holds."""
    out = np.zeros((len(texts), buckets), np.uint8)
    for row, t in zip(out, texts, strict=True):
        _mark(t, row, max_n)
    return out


def _mark(text: str, row: np.ndarray, max_n: int) -> None:
    """Sets the places of the text's n-grams to 1."""
    shift = np.uint32(32 - (len(row) - 1).bit_length())
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max_n + 1):
        if len(c) < n:
            break
        h = (h[:len(c) - n + 1] ^ c[n - 1:]) * MULTIPLIERS[0] + np.uint32(n)
        row[(h * MULTIPLIERS[n]) >> shift] = 1


def chunks(text: str, max_n: int) -> list[str]:
    """Consecutive parts of even length; each also holds the start of the next, so that no n-gram is lost."""
    parts = max(-(-len(text) // CHUNK), 1)
    ends = [len(text) * k // parts for k in range(parts + 1)]
    return [text[a:b + max_n - 1] for a, b in zip(ends, ends[1:])] if parts > 1 else [text]


def vectors(texts: list[str], buckets: int, max_n: int, block: int = 256) -> np.ndarray:
    """float32 matrix: the mean of the unit presence vectors of each text's chunks."""
    out = np.zeros((len(texts), buckets), np.float32)
    cut_up = [(i, c) for i, t in enumerate(texts) for c in chunks(t, max_n)]
    share = 1 / np.maximum(np.bincount([i for i, _ in cut_up], minlength=len(texts)), 1)
    for k in range(0, len(cut_up), block):
        at = np.array([i for i, _ in cut_up[k:k + block]])
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        x = unit(presence([c for _, c in cut_up[k:k + block]], buckets, max_n))
        out[at[first]] += np.add.reduceat(x, first, axis=0)
    return out * share[:, None].astype(np.float32)


class Model:
    def __init__(self, landmarks: np.ndarray, weights: np.ndarray, labels: list[str]):
        self.landmarks, self.weights, self.labels = landmarks, weights, labels
        self.by_gram = landmarks.T @ weights  # what each n-gram adds to the margins: the kernel is linear in the presence vectors

    def margins(self, x: np.ndarray) -> np.ndarray:
        """x: vectors() of the texts."""
        return x @ self.landmarks.T @ self.weights

    def score(self, texts: list[str], max_n: int, block: int = 256) -> np.ndarray:
        """The margins of texts: sparse presence vectors, a block of chunks at a time, times the n-grams' margins."""
        out = np.zeros((len(texts), len(self.labels)))
        cut_up = [(i, c) for i, t in enumerate(texts) for c in chunks(t, max_n)]
        share = 1 / np.maximum(np.bincount([i for i, _ in cut_up], minlength=len(texts)), 1)
        row = np.zeros(len(self.by_gram), np.uint8)
        for k in range(0, len(cut_up), block):
            found = []
            for _, c in cut_up[k:k + block]:
                _mark(c, row, max_n)
                found.append(np.flatnonzero(row))
                row[found[-1]] = 0
            sizes = np.array([len(f) for f in found])
            sums = np.add.reduceat(self.by_gram[np.concatenate(found)], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
            np.add.at(out, [i for i, _ in cut_up[k:k + block]], sums)
        return out * share[:, None]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    return unit(x) @ landmarks.T


def fit(x: np.ndarray, labels: list[str], *, landmarks: int = 192, ridge: float = 1e-3) -> Model:
    """x: vectors() of the sample. Landmarks are taken from the labels in turn."""
    names = sorted(set(labels))
    y = np.array([[1.0 if name == label else -1.0 for name in names] for label in labels])
    turn: dict[str, int] = {}
    order = sorted(range(len(labels)), key=lambda i: (turn.setdefault(labels[i], 0), turn.update({labels[i]: turn[labels[i]] + 1}) or labels[i]))
    marks = x[order[:max(landmarks, 2 * len(names))]]  # every label has some
    k_mm = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ marks.T).astype(np.float64) @ root
    balance = np.array([1.0 / labels.count(label) for label in names])[np.argmax(y, 1)] * len(labels) / len(names)
    a = (phi * balance[:, None]).T @ phi + ridge * len(labels) * np.eye(phi.shape[1])
    w = np.linalg.solve(a, (phi * balance[:, None]).T @ y)
    return Model(marks, (root @ w).astype(np.float32), names)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, modulus: int = 4, held: int = 2,
          per_label: int = 500, buckets: int = 1 << 13, max_n: int = 4, landmarks: int = 192) -> Model | None:
    """Fits on at most `per_label` texts of each language outside the held-out fold."""
    rows = docs.where((fold(id_col, modulus) != held) & F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col), F.lit("")).rlike("\\p{L}"))
    first = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("h", "id"))
    chosen = (  # in two steps: 8 parts of each language, then at most 8 * per_label rows of it
        rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h")).withColumn("part", F.col("h").bitwiseAND(F.lit(7)))
        .withColumn("n", first("part")).where(F.col("n") <= per_label)
        .withColumn("n", first()).where(F.col("n") <= per_label).select("id", "n").dropDuplicates(["id"])
    )
    sample = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.packbits(presence([t], buckets, max_n)[0]).tobytes() if len(t) <= CHUNK else vectors([t], buckets, max_n)[0].astype(np.float16).tobytes()
                      for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(packed, pa.binary()), b.column(3)], ["lang", "bits", "n"])

    got = sample.select("id", "lang", "text", "n").mapInArrow(run, "lang string, bits binary, n int").collect()
    if not got:
        return None
    got = sorted(got, key=lambda r: (r["n"], r["lang"], r["bits"]))
    x = np.zeros((len(got), buckets), np.float32)
    for row, r in zip(x, got, strict=True):
        b = bytes(r["bits"])
        row[:] = np.frombuffer(b, np.float16) if len(b) == 2 * buckets else unit(np.unpackbits(np.frombuffer(b, np.uint8))[None])[0]
    return fit(x, [r["lang"] for r in got], landmarks=landmarks)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = 1 << 13, max_n: int = 4,
            keep: bool = False) -> DataFrame:
    """id, lang_pred, score; with `keep` every column of docs and two more, the same under unused names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    has_letter = F.coalesce(F.col(text_col), F.lit("")).rlike("\\p{L}")
    if keep:
        slim = docs.select("*", F.when(has_letter, F.col(text_col)).alias(unused(docs, "__text")))
        names = docs.columns
        schema = docs.select(*names)
        out = unused(docs, "__lang_pred"), unused(docs, "__score")
    else:
        slim = docs.select(F.col(id_col), F.when(has_letter, F.col(text_col)).alias("__text"))
        names = [id_col]
        schema = docs.select(id_col)
        out = "lang_pred", "score"
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    result = StructType([*schema.schema.fields, StructField(out[0], StringType()), StructField(out[1], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = part.column(part.num_columns - 1).to_pylist()
                langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                real = [i for i, t in enumerate(texts) if t is not None]
                if m is not None and real:
                    margins = m.score([texts[i] for i in real], max_n)
                    soft = np.exp(4 * (margins - margins.max(1, keepdims=True)))
                    soft /= soft.sum(1, keepdims=True)
                    for i, best, p in zip(real, margins.argmax(1), soft.max(1), strict=True):
                        langs[i], scores[i] = m.labels[best], float(p)
                cols = [part.column(j) for j in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, *out])
        release()

    return slim.mapInArrow(run, result)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, modulus: int = 4, held: int = 2) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    model = train(docs, id_col, text_col, lang_col, modulus=modulus, held=held)
    return predict(docs, model, id_col, text_col).select(id_col, (fold(id_col, modulus) == held).alias("held_out"), "lang_pred", "score")


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, least: float = 0.3) -> DataFrame:
    """docs without those whose language cannot be told: no letter, or a score below `least`."""
    model = train(docs, id_col, text_col, lang_col)
    scored = predict(docs, model, id_col, text_col, keep=True)
    lang, score = scored.columns[-2:]
    return scored.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(*docs.columns)
