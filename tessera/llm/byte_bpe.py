"""Byte-level BPE by a sentencepiece BPE model that is serialised directly from a rank file.

Each token's bytes are mapped to printable characters (one per byte), and the piece scores the negative rank, so that
sentencepiece's best-scoring merge is the lowest-ranked merge. Normalisation is the identity. Texts are cut into
pre-tokens with the given pattern, each pre-token is encoded separately, and decoding maps ids back to bytes. Cuts are made
as tiktoken makes them: a character that its Unicode tables class otherwise than Python's is matched by a stand-in. Beyond
the ASCII range, the pattern may tell characters apart as letters, numbers and white space only.

Texts are cut before every run of white space first; no match of the pattern runs from a non-space into white space, so
each cut can be encoded by itself, and a cache of short cuts (two generations of at most `CACHE` entries) saves work.

Defined results: null text counts as empty; an empty text has no ids; very long texts are encoded whole. Repeated rows
each get a row; null ids are kept; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import characters
from tessera.llm.common import release

CACHE, CACHED_CHARS = 150_000, 64
# White space as the pattern language's \s has it (the Unicode property White_Space).
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CUTS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else from U+0100 on."""
    spare = itertools.count(0x100)
    return [chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One protobuf field: integers as varints, floats as fixed32, the rest length-delimited."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model (type BPE) whose piece ids are the ranks; unknown and unused ids follow the last rank."""
    chars, size = byte_characters(), max(ranks.values()) + 1
    by_rank = {r: t for t, r in ranks.items()}
    out = []
    for r in range(size):
        if r in by_rank:
            out.append(_field(1, _field(1, "".join(chars[b] for b in by_rank[r])) + _field(2, float(-r))))
        else:  # a gap in the ranks: a piece that never matches
            out.append(_field(1, _field(1, f"\u2581gap{r}") + _field(2, float(-r)) + _field(3, 5)))
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size)  # model_type BPE, vocab_size, unk_id
    trainer += b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # no bos, eos, pad: -1
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """encode(text) -> ids, decode(ids) -> bytes."""

    def __init__(self, path: str, pattern: str, stand_ins: dict[int, str] | None = None):
        import regex
        import sentencepiece

        self.stand_ins = characters.stand_ins() if stand_ins is None else stand_ins
        self.odd = frozenset(map(chr, self.stand_ins))
        ranks = read_ranks(path)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.pieces[r] = t
        self.numbers = list(range(len(self.pieces)))  # shared int objects
        self.pre = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def pre_tokens(self, cut: str) -> list[str]:
        if cut.isascii() or self.odd.isdisjoint(cut):
            return self.pre.findall(cut)
        return [cut[m.start():m.end()] for m in self.pre.finditer(cut.translate(self.stand_ins))]

    def _learn(self, cuts: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of new cuts: all their pre-tokens go to the model in one call."""
        pre = [self.pre_tokens(c) for c in cuts]
        flat = [x.encode().decode("latin-1").translate(self.table) for p in pre for x in p]
        encoded = iter(self.model.encode(flat, num_threads=1) if flat else [])
        number = self.numbers
        return {c: tuple([number[i] for _ in p for i in next(encoded)]) for c, p in zip(cuts, pre, strict=True)}

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        cuts = [CUTS.findall(t) for t in texts]
        young, old = self.young, self.old
        new = list(set(itertools.chain.from_iterable(cuts)) - young.keys())
        again = {c: old[c] for c in new if c in old}
        learned = self._learn([c for c in new if c not in again]) | again
        get = lambda c: young.get(c) or learned[c]
        out = [list(itertools.chain.from_iterable(map(get, c))) for c in cuts]
        if len(young) + len(learned) > CACHE:
            self.young, self.old = {}, young
        self.young.update((c, i) for c, i in learned.items() if len(c) <= CACHED_CHARS)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def forget(self) -> None:
        """Empties the cache at the end of a task: the worker process may serve other operators next."""
        self.young, self.old = {}, {}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str, stand_ins: dict[int, str]) -> Codec:
    """One codec for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern, stand_ins)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and token ids (array of int) of each document."""
    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    stand_ins = characters.stand_ins()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, stand_ins)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = c.encode_many(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])
        c.forget()
        release()

    return slim.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded bytes of each row; null ids count as none."""
    slim = encoded.select(F.col(id_col), F.col(ids_col).alias("__ids"))
    stand_ins = characters.stand_ins()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, stand_ins)
        for b in batches:
            data = [c.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    return slim.mapInArrow(run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, data binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes each text, then decodes its ids, in one pass."""
    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    stand_ins = characters.stand_ins()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, stand_ins)
        names = [str(i) for i in range(len(c.pieces))]
        for b in batches:
            n, ids_sha, decoded_sha = [], [], []
            for k in range(0, b.num_rows, 128):
                for ids in c.encode_many(b.column(1).slice(k, 128).to_pylist()):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                                             [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()
        release()

    return slim.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
