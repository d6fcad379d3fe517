"""Hierarchical packing: tiers of context sizes, gaps of long windows filled from shorter tiers, balanced step groups.

Each partition packs its own documents in one pass, without a shuffle. A document's tokens that fill whole windows of
the largest tier leave at once; the rest is routed to the smallest tier that holds it. When `queue` rests wait, or at
the end, each tier is packed, the longest first: a window is opened with the longest rest of its tier, its gap is filled
from the longest rests of the same or shorter tiers that fit, and what is still open by cutting one more rest. So windows
are full. Only the last few of a partition differ: the tokens left are cut into tiers, the largest first, and fewer tokens
than the smallest tier, if any, make one window that is padded. Tiers must be powers of two. Windows are numbered by
partition, and `step` groups a partition's windows so that all groups but the last hold about `step_tokens` tokens.

Defined results: null text counts as empty, its document is the end token alone; very long documents are cut; rests of one
length are taken in the order in which they came; repeated rows are packed each; null ids are kept; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import characters
from tessera.llm.common import release

CACHE, CACHED_CHARS = 150_000, 64
CUTS = re.compile("[^ \t-\r]+")  # the tokenizer drops white space and never joins across it
OTHER_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space to str.split(), not to the tokenizer
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+"


class Tokenizer:
    """Token ids of texts; each run of non-space is encoded once and kept in a bounded cache of two generations.

    A word's merges are made by tiktoken's byte-pair core, which is much faster than the tokenizer's own: the mark of a
    word's end becomes the byte 0xFF, which UTF-8 never has. This needs ids in the order of merges and the usual
    normalisation and pattern of such files; for any other file, and for runs with a character that the library may class
    or normalise otherwise than Python, the tokenizers library encodes each run.
    """

    def __init__(self, path: str, odd: frozenset[str] | None = None):
        import json

        import regex

        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.path, self.core, self.library = path, None, None
        self.odd = characters.odd_characters(path) if odd is None else odd
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
        pre = json.dumps(spec.get("pre_tokenizer"))
        if (spec["model"].get("end_of_word_suffix") == "</w>" and json.dumps(WORDS.replace("\\p{L}+", "[\\p{L}]+").replace("|\\p{N}|", "|[\\p{N}]|")) in pre
                and [n["type"] for n in spec["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
                and all(vocab.get("".join(m if isinstance(m, list) else m.split(" "))) == 512 + i for i, m in enumerate(merges))):
            import tiktoken

            from tessera.llm.byte_bpe import byte_characters

            byte = {c: bytes([b]) for b, c in enumerate(byte_characters())}
            ranks = {}
            for piece, i in vocab.items():
                end = piece.endswith("</w>")
                body = piece[:-4] if end else piece
                if i < 512 + len(merges):
                    ranks[b"".join(byte[c] for c in body) + b"\xff" * end] = i
            self.numbers = list(range(max(ranks.values()) + 1))  # shared int objects
            self.core = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.words = regex.compile(WORDS)
            self.special = [t["content"] for t in spec["added_tokens"]]

    def _by_library(self, run: str) -> tuple[int, ...]:
        if self.library is None:
            from tokenizers import Tokenizer as Load

            self.library = Load.from_file(self.path)
        return tuple(self.library.encode(run, add_special_tokens=False).ids)

    def _encode(self, run: str) -> tuple[int, ...]:
        if (ids := self.old.get(run)) is None:
            if self.core is None or "<|" in run and any(s in run for s in self.special) or not (run.isascii() or self.odd.isdisjoint(run)):
                ids = self._by_library(run)
            else:
                low = run if run.isascii() else unicodedata.normalize("NFC", run)
                low = low.lower() if "\u03a3" not in low else "".join(c.lower() for c in low)
                piece, number = self.core.encode_single_piece, self.numbers
                parts = [low] if low.isalpha() else self.words.findall(low)
                ids = tuple([number[i] for w in parts for i in piece(w.encode() + b"\xff")])
        if len(run) <= CACHED_CHARS:
            if len(self.young) >= CACHE:
                self.young, self.old = {}, self.young
            self.young[run] = ids
        return ids

    def forget(self) -> None:
        """Empties the cache at the end of a task: the worker process may serve other operators next."""
        self.young, self.old = {}, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            runs = CUTS.findall(t) if any(c in t for c in OTHER_SEPARATORS) else t.split()
            get, make = self.young.get, self._encode
            out.append(np.fromiter(itertools.chain.from_iterable([get(r) or make(r) for r in runs]), np.uint32))
        return out


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str, odd: frozenset[str]) -> Tokenizer:
    """One tokenizer for each worker process, without threads of its own."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = Tokenizer(path, odd)
    return _TOKENIZERS[path]


class Packer:
    """Piece: (doc, start, ids, doc_tokens). Yields windows as lists of pieces."""

    def __init__(self, tiers: list[int], queue: int):
        self.tiers, self.size, self.queue = tiers, tiers[-1], queue
        self.waiting: dict[int, deque] = defaultdict(deque)  # length -> pieces
        self.lengths: list[int] = []  # sorted, of the pieces that wait; a tier is a range of it
        self.count = self.tokens = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        n, at = len(ids), 0
        while n - at >= self.size:
            yield [(doc, at, ids[at:at + self.size], n)]
            at += self.size
        if at < n:
            self._wait((doc, at, ids[at:], n))
        if self.count >= self.queue:
            yield from self._pack_tiers()

    def end(self) -> Iterator[list]:
        """Everything that waits: whole windows, then the tiers that the tokens left still fill, then one short window."""
        yield from self._pack_tiers()
        while self.count:
            yield self._fill(next((t for t in reversed(self.tiers) if t <= self.tokens), self.tokens))

    def _pack_tiers(self) -> Iterator[list]:
        """From the longest tier on: a window is opened by a piece of its own tier."""
        for shorter, tier in reversed(list(zip([0, *self.tiers], self.tiers, strict=False))):
            while self.tokens >= tier and (k := bisect.bisect_right(self.lengths, tier)) and self.lengths[k - 1] > shorter:
                yield self._fill(tier)

    def _wait(self, piece: tuple) -> None:
        k = len(piece[2])
        if k not in self.waiting:
            bisect.insort(self.lengths, k)
        self.waiting[k].append(piece)
        self.count, self.tokens = self.count + 1, self.tokens + k

    def _take(self, most: int) -> tuple | None:
        """The longest piece of at most `most` tokens."""
        at = bisect.bisect_right(self.lengths, most)
        if not at:
            return None
        k = self.lengths[at - 1]
        piece = self.waiting[k].popleft()
        if not self.waiting[k]:
            del self.lengths[at - 1], self.waiting[k]
        self.count, self.tokens = self.count - 1, self.tokens - k
        return piece

    def _fill(self, size: int) -> list:
        """One full window: the longest pieces that fit, of this tier or shorter ones, then the start of another."""
        window, room = [], size
        while room and (piece := self._take(room)):
            window.append(piece)
            room -= len(piece[2])
        if room:
            doc, at, ids, n = self._take(self.size)
            window.append((doc, at, ids[:room], n))
            self._wait((doc, at + room, ids[room:], n))
        return window


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, tiers: tuple[int, ...] = (256, 512, 1024, 2048),
         end_id: int = 1, queue: int = 4096, step_tokens: int = 1 << 19, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step (and ids)."""
    sizes = sorted(tiers)
    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind, odd = docs.schema[id_col].dataType, characters.odd_characters(path)
    schema = f"{id_col} {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokenizer(path, odd), Packer(sizes, queue)
        base, made, tokens = TaskContext.get().partitionId() << 36, 0, 0
        id_type = None
        rows: list[tuple] = []

        def number(window: list) -> None:
            nonlocal made, tokens
            at, total = 0, sum(len(p[2]) for p in window)
            tier = next(t for t in sizes if total <= t)
            for doc, start, ids, n in window:
                row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, base + made, at, tier, (base >> 4) + tokens // step_tokens)
                rows.append((*row, ids.tolist()) if with_ids else row)
                at += len(ids)
            made, tokens = made + 1, tokens + total

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
                rows.clear()

        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step", *["ids"] * with_ids]
        for b in batches:
            id_type = b.schema.field(0).type
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    for window in packer.add(doc, np.append(ids, np.uint32(end_id))):
                        number(window)
                yield from flush()
        for window in packer.end():
            number(window)
        yield from flush()
        encode.forget()
        release()

    return slim.mapInArrow(run, schema)
