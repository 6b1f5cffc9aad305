"""Vectors as arrays of floats."""

from __future__ import annotations

import hashlib
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """Of length one; zeros stay."""
    return F.transform(a, lambda x: x / F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0)))


def repair(v: Column, dim: int, tolerance: float = 1e-3) -> Column:
    """``dim`` finite numbers of length one: padded or cut, NaN and infinities as 0, scaled if the length is off."""
    inf = float("inf")
    full = F.slice(F.concat(doubles(F.coalesce(v, F.array().cast("array<float>"))), F.array_repeat(F.lit(0.0), dim)), 1, dim)
    finite = F.transform(full, lambda x: F.when(x.isNull() | F.isnan(x) | (x == inf) | (x == -inf), 0.0).otherwise(x))
    # an array of one keeps the list from being made again for each use
    fixed = F.transform(F.array(finite), lambda a: F.when((norm(a) > 0) & (F.abs(norm(a) - 1) > tolerance), F.transform(a, lambda x: x / norm(a))).otherwise(a))
    return fixed[0]


class _Places(dict):
    """Place and sign of each word, 2 * place + (1 if positive): hashed once while it is remembered."""

    def __init__(self, dim: int, most: int = 300_000):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        self[word] = out = h % self.dim * 2 + (h >> 63)
        return out


@cache
def _places(dim: int) -> _Places:
    """A worker's own, for all of its tasks."""
    return _Places(dim)


def hashed_terms(texts: list, dim: int) -> np.ndarray:
    """A row for each text: signed hashed term counts, of length one; zeros for a text without words."""
    words = [(t or "").lower().split() for t in texts]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    at = np.fromiter(map(_places(dim).__getitem__, chain.from_iterable(words)), np.int64, len(row))
    v = np.bincount(row * dim + (at >> 1), (at & 1) * 2.0 - 1, minlength=len(words) * dim).reshape(len(words), dim)
    n = np.sqrt((v * v).sum(axis=1).astype(np.float32))[:, None]  # sums of whole numbers
    return v.astype(np.float32) / np.where(n > 0, n, np.float32(1))


def hashing_embedder(dim: int = 256):
    """A default embedder without a model: signed hashed term counts, of length one (Arrow).

    Any ``pandas_udf`` or ``arrow_udf`` from strings to arrays of floats can stand in its place. Its attribute ``rows``, a function of
    a list of texts, spares vectors the way through a column where texts are scored at once; others need none.
    """

    @arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        parts = [hashed_terms(texts.slice(lo, 512).to_pylist(), dim) for lo in range(0, len(texts), 512)]
        flat = np.concatenate([np.zeros((0, dim), np.float32), *parts]).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(flat))

    embed.rows = partial(hashed_terms, dim=dim)
    return embed
