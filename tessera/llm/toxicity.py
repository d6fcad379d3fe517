"""Toxicity with a learned lexicon: Levenshtein automata over a lexicon trie, and context-window scores.

Lexicon: words of toxic training texts that occur in at least `least` different contexts (pairs of neighbouring words,
counted by sketches that do not fill up, so that copies of a text count once) and at `ratio` times the rate of other training texts or more; a
rate is a word's share of all contexts of the class, for other texts plus three standard errors, which matter only while
a word is rare. Chance must not explain it either: were the texts that hold the word toxic as often as all texts are, so few
clean ones among them would have to be so unlikely (Chernoff's bound) that over all candidate words `chance` of a word is
expected. So a word that no clean text holds needs the more toxic texts the more of all texts are toxic, and ordinary words
do not enter however large the vocabulary. Different texts are counted, by small sketches. All words that pass are taken; if
they are more than `most_terms`, the labels do not mark words and training stops with an error before anything is sent. A word is looked up by
running its Levenshtein automaton (one error, bit-parallel) along the trie of the lexicon; digits and signs that stand
for letters are also tried as letters. All words under `ratio` that the automaton would catch form a stop list. Each hit
is abusive, reported or quoted: quotation marks on both sides, double or single, or else words of reporting, within a
window of `window` words. Counts of exact and misspelled hits of the three kinds, and their density, enter a logistic regression, fitted
on at most `fit_rows` training rows (those with the smallest hash of their id); lexicon counts use all training rows.

Defined results: null text counts as empty; empty texts get the score of a text without hits; without training labels
of both kinds, or where no word tells them apart, every score is 0; a score of exactly 0.5 counts as toxic; label rows with a null id or label are not used; a repeated label row counts once, and if an id has
different labels the largest counts. Repeated documents each get a row; other columns pass through or are not read; very
long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import cut, fold, maybe_in, release, unused

WORDS = re.compile(r"\w+(?:[@$!*]+\w+)*")
SQL_WORDS = "[\\p{L}\\p{N}_]+(?:[@$!*]+[\\p{L}\\p{N}_]+)*"
LETTERS = str.maketrans("013457@$!", "oieastasi")
QUOTES = re.compile("[\"“”„«»]")
OPENING, CLOSING = re.compile(r"(?<!\w)['‘‚’‹›](?=\w)"), re.compile(r"(?<=[^\W_])['’‘›‹](?!\w)|(?<=[.,;:!?])['’‘›‹](?!\w)")  # not apostrophes
# Words that report speech or mention a term.
REPORTING = frozenset("said says called calls quoted quote quotes wrote writes term word phrase slur insult insults reported according dit mot sagte wort dijo palabra".split())
SHORTEST = 4


class Trie:
    """Terms, searched with Levenshtein automata of at most one error."""

    def __init__(self, terms):
        self.root: dict = {}
        self.exact = frozenset(terms)
        self.heads, self.tails = set(), set()
        for t in self.exact:
            if len(t) < SHORTEST:
                continue
            node = self.root
            for ch in t:
                node = node.setdefault(ch, {})
            node[""] = t
            half = len(t) // 2
            self.heads.add(t[:half])
            self.tails.add(t[half:])
        self.head_sizes = sorted({len(h) for h in self.heads})
        self.tail_sizes = sorted({len(h) for h in self.tails})

    def near(self, word: str) -> str | None:
        """A term within one insertion, deletion or substitution, or None."""
        n = len(word)
        if n < SHORTEST - 1 or not (any(word[:k] in self.heads for k in self.head_sizes) or any(word[-k:] in self.tails for k in self.tail_sizes)):
            return None  # one error leaves the first or the second half of a term whole
        masks: dict[str, int] = {}
        for i, ch in enumerate(word):
            masks[ch] = masks.get(ch, 0) | 1 << i
        goal, full = 1 << n, (1 << n + 1) - 1
        stack = [(self.root, 1, 3)]
        while stack:
            node, zero, one = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    if (zero | one) & goal:
                        return child
                    continue
                m = masks.get(ch, 0)
                z = (zero & m) << 1
                o = ((one & m) << 1 | zero << 1 | zero | z << 1) & full
                if z | o:
                    stack.append((child, z, o))
        return None


class Lexicon:
    def __init__(self, terms: list[str], stop: list[str]):
        self.trie, self.stop, self.seen = Trie(terms), frozenset(stop), {}

    def kind(self, word: str) -> int:
        """0 none, 1 exact, 2 misspelled."""
        k = self.seen.get(word)
        if k is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            k = self.seen[word] = self._kind(word)
        return k

    def _kind(self, word: str) -> int:
        if word in self.trie.exact:
            return 1
        if word in self.stop:
            return 0
        plain = word.translate(LETTERS)
        return 2 if plain in self.trie.exact or self.trie.near(word) or plain != word and self.trie.near(plain) else 0


FEATURES = 8


def features(text: str, lexicon: Lexicon, window: int) -> list[float]:
    """log counts of exact abusive, quoted and reported hits, of misspelled ones; density; whether there is an abusive hit."""
    low = text.lower()
    words = WORDS.findall(low)
    kind = lexicon.kind
    hits = {w for w in set(words) if kind(w)}
    out = [0.0] * FEATURES
    if not hits:
        return out
    spans = [m for m in WORDS.finditer(low)]
    counts = [0.0] * 6
    for i, w in enumerate(words):
        if w in hits:
            a, b = max(0, i - window), min(len(words) - 1, i + window)
            start, end = spans[a - 1].end() if a else 0, spans[b + 1].start() if b + 1 < len(words) else len(low)
            here, after = spans[i].start(), spans[i].end()
            quoted = QUOTES.search(low, start, here) and QUOTES.search(low, after, end) or OPENING.search(low, start, here + 1) and CLOSING.search(low, after, end)
            context = 1 if quoted else 2 if REPORTING.intersection(words[a:b + 1]) else 0
            counts[3 * (kind(w) - 1) + context] += 1
    out[:6] = [float(np.log1p(c)) for c in counts]
    out[6] = 100.0 * sum(counts) / len(words) / (1 + 100.0 * sum(counts) / len(words))
    out[7] = float(counts[0] + counts[3] > 0)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * 10)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        w -= np.linalg.solve(h, x.T @ (p - y) + penalty * w)
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None, window: int):
        self.lexicon, self.weights, self.window = lexicon, weights, window

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        z = float(np.dot(self.weights[:-1], features(text, self.lexicon, self.window)) + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _surprise(bad: Column, clean: Column, share: float) -> Column:
    """-log of a bound of the chance that so few of bad + clean texts are clean if each is with chance `share`; 0 where they are not few."""
    n = bad + clean
    x = clean / n
    part = lambda at, of: F.when(at > 0, at * F.log(at / F.lit(of))).otherwise(0.0)
    return F.when((n > 0) & (x < share), n * (part(x, share) + part(1 - x, 1 - share))).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, modulus: int = 5, held: int = 0,
          least: int = 4, ratio: float = 20.0, chance: float = 0.5, most_terms: int = 200_000, fit_rows: int = 20000, window: int = 6) -> Model:
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, modulus) != held)).groupBy(F.col(id_col).alias("__id")).agg(
        (F.max(label_col) > 0).alias("bad"))
    marks = cut(marks)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = maybe_in(rows, F.col("id"), marks, F.col("__id"), "maybe").where("maybe")  # other texts are not shuffled
    rows = rows.join(marks.hint("merge"), F.col("id") == F.col("__id")).select("id", "text", "bad")  # one plan at every size
    cut_up = rows.select("bad", F.regexp_extract_all(F.lower("text"), F.lit(SQL_WORDS), F.lit(0)).alias("w"), F.xxhash64("text").alias("doc")).where(F.size("w") > 0)
    placed = cut_up.select("bad", "w", "doc", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("i"))  # -1 stands for the text itself: the empty word
    word, context = F.when(F.col("i") < 0, "").otherwise(F.get("w", "i")), F.xxhash64(F.coalesce(F.get("w", F.col("i") - 1), F.lit("")), F.coalesce(F.get("w", F.col("i") + 1), F.lit("")))
    seen = placed.select("bad", "doc", word.alias("word"), F.when(F.col("i") < 0, F.col("doc")).otherwise(context).alias("context"))
    count = lambda of, what, error: F.approx_count_distinct(F.when(of, F.col(what)), error)
    stats = cut(seen.groupBy("word").agg(count(F.col("bad"), "context", 0.05).alias("bad"), count(~F.col("bad"), "context", 0.05).alias("clean"),
                                         count(F.col("bad"), "doc", 0.2).alias("bad_texts"), count(~F.col("bad"), "doc", 0.2).alias("clean_texts")))
    texts = stats.where("word = ''").select("bad", "clean").first() or (0, 0)
    stats = stats.where("word <> ''")
    all_bad, all_clean, tested = stats.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0)), F.count(F.when(F.col("bad") >= least, 1))).first()
    bad_rate, clean_rate = F.col("bad") / F.lit(float(max(all_bad, 1))), F.col("clean") / F.lit(float(max(all_clean, 1)))
    most = (F.col("clean") + 3 * F.sqrt("clean")) / F.lit(float(max(all_clean, 1)))  # clean rate within three standard errors
    surprise = _surprise(F.col("bad_texts"), F.col("clean_texts"), (texts[1] + 0.5) / (texts[0] + texts[1] + 1.0))
    chosen = stats.where((F.col("bad") >= least) & (bad_rate >= ratio * most) & (surprise >= float(np.log(max(tested, 1) / chance)))).orderBy("word")
    if (found := chosen.count()) > most_terms:
        raise ValueError(f"{found} words tell toxic texts from others, more than most_terms = {most_terms}: these labels do not mark words")
    lexicon = [r["word"] for r in chosen.select("word").collect()]
    trie = Lexicon(lexicon, [])

    def caught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [trie.kind(w) == 2 for w in b.column(0).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    harmless = stats.where((F.col("clean") > 0) & (ratio * clean_rate > bad_rate)).select("word").mapInArrow(caught, "word string")
    stop = [r["word"] for r in harmless.collect()]
    known = Lexicon(lexicon, stop)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, known, window) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "bad"])

    picked = marks.select("__id", "bad").orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("__id"))
    got = sample.select("text", "bad").mapInArrow(measure, "x array<double>, bad boolean").collect()
    y = np.array([float(r["bad"]) for r in got])
    weights = logistic(np.array([r["x"] for r in got]), y) if lexicon and 0 < y.sum() < len(y) else None  # without terms nothing tells texts apart, whatever their share
    return Model(known, weights, window)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, the score, and the name of that column."""
    name = unused(docs, "__tox")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            s = [m.score(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names)
        m.lexicon.seen.clear()
        release()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())])), name


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, modulus: int = 5,
                    held: int = 0, **options) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, label_col, modulus=modulus, held=held, **options)
    out, tox = scored(docs.select(id_col, text_col), model, text_col)
    return out.select(id_col, (fold(id_col, modulus) == held).alias("held_out"), F.col(tox).alias("score"), (F.col(tox) >= 0.5).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, threshold: float = 0.5,
                     **options) -> DataFrame:
    """docs that are not toxic, all columns as they were."""
    model = train(docs, labels, id_col, text_col, label_col, **options)
    out, tox = scored(docs, model, text_col)
    return out.where(F.col(tox) < threshold).select(*docs.columns)
