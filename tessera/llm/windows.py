"""Hashes of all word windows of a batch of texts, in numpy over the Arrow buffers.

Words are runs of bytes other than the six ASCII white-space ones. A word's hash is a polynomial of
its bytes and a window's a polynomial of its words' mixed hashes, both taken as differences of
running sums modulo 2^64, so the cost doesn't depend on the window's length. (Words long enough for
such a polynomial to be degenerate are hashed by BLAKE2 instead.)
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LONG = 512
_U = np.uint64


def _odd(seed: int) -> np.uint64:
    return _U(int.from_bytes(hashlib.blake2b(b"p%d" % seed, digest_size=8).digest(), "little") | 1)


def _table(seed: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(b"%d.%d" % (seed, b), digest_size=8).digest() for b in range(256)), dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(p: np.uint64, n: int) -> np.ndarray:
    """p^0 .. p^(n-1), kept for the next call."""
    if len(_POWERS.get(int(p), ())) < n:
        out = np.full(max(n, 1 << 16), p, dtype=np.uint64)
        out[0] = 1
        _POWERS[int(p)] = np.cumprod(out, dtype=np.uint64, out=out)
    return _POWERS[int(p)][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finalizer of MurmurHash3)."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row starts (n + 1 offsets); null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Polynomial:
    """64-bit hashes of byte runs [first, last) of a buffer."""

    def __init__(self, seed: int):
        self.table, self.p = _table(seed), _odd(seed)
        self.p_inv = _U(pow(int(self.p), -1, 1 << 64))

    def sums(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums and what a run's difference of them is multiplied with, for each place of a buffer and its end."""
        run = np.zeros(len(data) + 1, dtype=np.uint64)
        np.take(self.table, data, out=run[1:], mode="clip")
        run[1:] *= _powers(self.p, len(data))
        np.cumsum(run, out=run)
        return run, _powers(self.p_inv, len(data) + 1)

    def __call__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        run, inverse = self.sums(data)
        h = (run[last] - run[first]) * inverse[first]
        for i in np.flatnonzero(last - first > _LONG):
            h[i] = int.from_bytes(hashlib.blake2b(data[first[i] : last[i]].tobytes(), digest_size=8, salt=int(self.p).to_bytes(8, "little")).digest(), "little")
        return mix(h)


@dataclass
class Windows:
    """The windows of a batch in order: their rows, word positions and hashes."""

    row: np.ndarray
    pos: np.ndarray
    hashes: list[np.ndarray]


class Hasher:
    def __init__(self, size: int, seeds: tuple[int, ...] = (1,)):
        self.size = size
        self.of = [(Polynomial(s), _odd(s + 1000)) for s in seeds]

    def __call__(self, column: pa.Array) -> Windows:
        data, starts = texts(column)
        none = Windows(np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in self.of])
        if not len(data):
            return none
        word = ~SPACE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        cuts = starts[(starts > 0) & (starts < len(data))]  # a text's first byte begins a word, the byte before it ends one
        begins[cuts] |= word[cuts]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        ends[cuts - 1] |= word[cuts - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        counts = np.diff(np.searchsorted(first, starts))
        n = np.maximum(counts - self.size + 1, 0)
        total = int(n.sum())
        if not total:
            return none
        row = np.repeat(np.arange(len(n)), n)
        pos = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        at = pos + np.repeat(np.cumsum(counts) - counts, n)  # the window's first word
        hashes = []
        for word_hash, q in self.of:
            w = word_hash(data, first, last)
            run = np.zeros(len(w) + 1, dtype=np.uint64)
            np.cumsum(w * _powers(q, len(w)), out=run[1:])
            hashes.append(mix((run[at + self.size] - run[at]) * _powers(_U(pow(int(q), -1, 1 << 64)), len(w) + 1)[at]))
        return Windows(row, pos, hashes)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Parts of a batch with about ``most`` bytes of text each (a longer text is a part of its own)."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-2))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(int(lo), int(hi - lo))
