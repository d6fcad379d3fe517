"""The few functions that need Python, as Arrow-batched pandas UDFs: NFKC, URL resolution, embeddings."""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from urllib.parse import urljoin, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def arrow_function(kind: str):
    """A pandas UDF that is made when it is first used: there may be no session at import."""
    def wrap(f):
        return functools.wraps(f)(lambda *columns: F.pandas_udf(f, kind)(*columns))

    return wrap


@arrow_function("string")
def nfkc_lower(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).lower())


def _resolve(base, href):
    try:
        out = urljoin(base, href)
        return out if urlsplit(out).scheme in ("http", "https") else None
    except (TypeError, ValueError):
        return None


@arrow_function("string")
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else _resolve(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def hash_embedding(text: str | None, dimensions: int) -> list[float]:
    """A deterministic unit vector of the hashed words; zeros for no words."""
    v = np.zeros(dimensions)
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        v[h % dimensions] += 1.0 if h >> 32 & 1 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embedder(dimensions: int):
    """An embedding provider for tests: the port is any UDF from text to array<float>."""
    @arrow_function("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hash_embedding(x, dimensions))

    return embed


class ProviderUnavailable(Exception):
    """The provider cannot be reached; the chunk may be tried again."""


def embedding_outcomes(dimensions: int, refuses=lambda key: False, breaks=lambda key: False):
    """A test provider that may refuse or break: a UDF (key, text) -> status (embedded, failed, provider_unavailable), vector.

    Vectors of another length than `dimensions` count as failed.
    """
    def provide(key, text: str) -> list[float]:
        if refuses(key):
            raise ProviderUnavailable(key)
        return hash_embedding(text, dimensions - 1 if breaks(key) else dimensions)

    def outcome(key, text: str) -> tuple:
        try:
            vector = provide(key, text)
        except ProviderUnavailable:
            return "provider_unavailable", None
        return ("embedded", vector) if len(vector) == dimensions else ("failed", None)

    @F.pandas_udf("status string, vector array<float>")
    def embed(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([outcome(k, t) for k, t in zip(keys, texts, strict=True)], columns=["status", "vector"])

    return embed
