"""An FM-index over words, in numpy: one is built for each shard of training text.

The text is a sequence of symbols: 0 ends it, 1 separates, from 2 on there is one for each word of
the query set (other words are separators; a run of them is one). Nothing that a phrase can match is
left out. Suffixes are sorted by packed words first and then by doubling only where ties remain.
The Burrows-Wheeler transform is held in a wavelet matrix, whose ranks drive the backward search of
all phrases at once; every ``sample``-th text position is kept, and an occurrence is located by
walking back to one.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 1


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of the suffixes of ``text``, whose last symbol is 0 and unique."""
    n = len(text)
    k = max(1, 62 // bits)  # symbols in one key
    key = np.zeros(n, dtype=np.int64)
    for j in range(k):
        key <<= bits
        key[: max(n - j, 0)] |= text[j:]
    sa = np.argsort(key, kind="stable")
    new = np.empty(n, dtype=bool)
    new[0] = True
    ordered = key[sa]
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    del key, ordered
    first = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n)))  # a group's rank is its first place
    while len(first) < n:
        size = np.diff(np.append(first, n))
        tied = np.repeat(size > 1, size)
        at = np.flatnonzero(tied)  # places whose order is open; groups stay together
        pos = sa[at]
        group = rank[pos]
        after = rank[np.minimum(pos + k, n - 1)]
        order = np.lexsort((after, group))
        pos, group, after = pos[order], group[order], after[order]
        sa[at] = pos
        opens = np.empty(len(at), dtype=bool)
        opens[0] = True
        opens[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        starts = np.flatnonzero(opens)
        rank[pos] = np.repeat(at[starts], np.diff(np.append(starts, len(at))))
        first = np.union1d(first, at[starts])
        k *= 2
    return sa


class WaveletMatrix:
    """Ranks and accesses over a sequence of symbols below 2 ** bits, for arrays of queries."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        s = symbols
        for level in range(bits - 1, -1, -1):
            b = (s >> level) & 1
            run = np.zeros(len(s) + 1, dtype=np.int32)
            np.cumsum(b, out=run[1:])
            self.ones.append(run)
            self.zeros.append(len(s) - int(run[-1]))
            one = b.astype(bool)
            s = np.concatenate([s[~one], s[one]])
        # where each symbol's block starts after the last level
        self.base = np.zeros(1 << bits, dtype=np.int64)
        count = np.bincount(s, minlength=1 << bits)
        order = np.zeros(1, dtype=np.int64)  # symbols by their reversed bits, as the levels leave them
        for _ in range(bits):
            order = np.concatenate([2 * order, 2 * order + 1])
        self.base[order] = np.concatenate([[0], np.cumsum(count[order])[:-1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is in the first ``at`` places."""
        for k, (run, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = run[at]
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + up, at - up)
        return at - self.base[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and their ranks before them."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for run, zeros in zip(self.ones, self.zeros, strict=True):
            up = run[at]
            one = run[at + 1] > up
            symbol = symbol << 1 | one
            at = np.where(one, zeros + up, at - up)
        return symbol, at - self.base[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        self.n, bits = len(text), max(1, (symbols - 1).bit_length())
        sa = suffix_array(text, bits)
        self.wavelet = WaveletMatrix(text[sa - 1], bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        self.kept = np.zeros(self.n + 1, dtype=np.int32)
        marks = sa % sample == 0
        np.cumsum(marks, out=self.kept[1:])
        self.samples = sa[marks]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long phrases (rows): the range of suffixes of each."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: back by LF steps to the next sampled one."""
        out = np.full(len(rows), -1, dtype=np.int64)
        at, live, steps = rows.astype(np.int64), np.arange(len(rows)), 0
        while len(live):
            done = self.kept[at + 1] > self.kept[at]
            out[live[done]] = self.samples[self.kept[at[done]]] + steps
            live, at = live[~done], at[~done]
            symbol, rank = self.wavelet.access(at)
            at = self.before[symbol] + rank
            steps += 1
        return out
