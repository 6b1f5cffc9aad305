"""Edit ratios, 0 to 100: how much of two strings is a common subsequence.

``ratio`` is 200 x LCS / (length + length). ``best_window`` is the greatest ratio of the shorter string to a
window of the longer one that is as long, or is cut off by an end. ``word_score`` takes the ratio of words of
like length, or nine tenths of the best window where one is half as long again. ``token_set`` compares what two
texts' sorted words share and don't share; ``window_token_set`` is 100 where they share a word.

The length of the common subsequence comes from bit-parallel addition (a bit for each character of one
string, a step for each of the other): for words, in numpy over all pairs of an Arrow batch at once; for
longer strings, with integers of any size.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

_U = np.uint64
WORD = 64  # longest string of a vectorized comparison
# The score that makes two tokens equal, by the token's length; what a wider gate gives way; a word's score to be corrected
TOKEN_SCORES, GATE_EASE, TYPO_SCORE = ((14, 88), (10, 85), (4, 80)), 2, 88
SENTENCE_SCORE, SENTENCE_RANGE = 70, (60, 90)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def _windows(n: int, m: int) -> Iterable[tuple[int, int]]:
    """Windows of n in m characters: whole ones, then those cut off by an end."""
    yield from ((i, i + n) for i in range(m - n + 1))
    yield from ((0, i) for i in range(1, n))
    yield from ((m - i, m) for i in range(1, n))


def best_window(a: str, b: str) -> float:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    known = set(a)
    best = 0.0
    for lo, hi in _windows(len(a), len(b)):
        # a best window begins and ends with a character of ``a``, or does no better than one that does
        if b[hi - 1] in known or b[lo] in known:
            best = max(best, ratio(a, b[lo:hi]))
    return best


def word_score(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    whole = ratio(a, b)
    if max(len(a), len(b)) < 1.5 * min(len(a), len(b)):
        return whole
    return max(whole, best_window(a, b) * (0.9 if max(len(a), len(b)) <= 8 * min(len(a), len(b)) else 0.6))


def token_set(a: str, b: str) -> float:
    """Of the shared words, and these with each side's rest, the two most alike."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = " ".join(filter(None, [both, *sorted(x - y)])), " ".join(filter(None, [both, *sorted(y - x)]))
    return max([ratio(left, right), *(ratio(both, s) for s in (left, right) if both)])


def window_token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    return 100.0 if x & y else best_window(" ".join(sorted(x - y)), " ".join(sorted(y - x)))


# Batches ---------------------------------------------------------------------------------------------


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, longest) code points, filled up with zeros, and lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(size.max(initial=1))), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def word_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``ratio`` of pairs of strings of at most ``WORD`` characters."""
    if not a:
        return np.zeros(0)
    (x, n), (y, m) = _points(a), _points(b)
    bit = _U(1) << np.arange(x.shape[1], dtype=_U)
    inside = np.where(n >= WORD, ~_U(0), (_U(1) << np.minimum(n, WORD - 1).astype(_U)) - _U(1))
    v = inside.copy()
    for j in range(y.shape[1]):
        on = ((x == y[:, j : j + 1]) * bit).sum(axis=1, dtype=_U)
        u = np.where(j < m, v & on, _U(0))
        v = ((v + u) | (v - u)) & inside
    common = n - np.bitwise_count(v).astype(np.int64)
    return 200.0 * common / np.maximum(n + m, 1)


def word_scores(a: list[str], b: list[str]) -> np.ndarray:
    """``word_score`` of pairs. Pairs that even a best window can't lift to a threshold are scored like others."""
    fits = np.array([0 < len(x) <= WORD and 0 < len(y) <= WORD for x, y in zip(a, b, strict=True)], bool)
    out = np.zeros(len(a))
    at = np.flatnonzero(fits)
    out[at] = word_ratios([a[i] for i in at], [b[i] for i in at])
    n, m = (np.fromiter(map(len, s), np.int64, len(s)) for s in (a, b))
    for i in np.flatnonzero(~fits | (np.maximum(n, m) >= 1.5 * np.minimum(n, m))):
        out[i] = word_score(a[i], b[i])
    return out


def least_score(n: int, ease: int = 0) -> int:
    """The score that makes a token of ``n`` characters equal to another; over 100, so never, for short ones."""
    return next((s for least, s in TOKEN_SCORES if n >= least), 101 + ease) - ease


def _near(query: list[str], doc: list[str], ease: int, pairs_at_once: int = 1 << 16) -> int:
    """Tokens of ``query`` that ``doc`` has, or has one like. A token is alike only if the characters' counts allow it."""
    have, hits = set(doc), 0
    open_ = [t for t in query if t not in have and least_score(len(t), ease) <= 100]
    hits += sum(t in have for t in query)
    for t in open_:
        least = least_score(len(t), ease)
        # the ratio is at most 200 x shorter / sum; beyond half as long again, the best window counts
        fits = [d for d in doc if max(len(t), len(d)) >= 1.5 * min(len(t), len(d)) or 200 * min(len(t), len(d)) >= least * (len(t) + len(d))]
        if any((word_scores([t] * len(part), part) >= least).any() for part in (fits[i : i + pairs_at_once] for i in range(0, len(fits), pairs_at_once))):
            hits += 1
    return hits


def overlap(query: Column, doc: Column, ease: int = 0) -> Column:
    """Share of the query's tokens (an array) that the document's tokens have or are alike to; 0 without any.

    ``ease`` lowers the thresholds, for gates that ask for two signals (GATE_EASE)."""

    @F.pandas_udf(DoubleType())
    def share(q: pd.Series, d: pd.Series) -> pd.Series:
        none: list[str] = []
        return pd.Series([0.0 if x is None or not len(x) else _near(list(x), none if y is None else list(y), ease) / len(x) for x, y in zip(q, d, strict=True)])

    return share(query, doc)


@F.pandas_udf(DoubleType())
def word_score_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """``word_score`` of two columns; 0 for nulls."""
    return pd.Series(word_scores(a.fillna("").tolist(), b.fillna("").tolist()))


@F.pandas_udf(BooleanType())
def sentence_found(sentence: pd.Series, sources: pd.Series) -> pd.Series:
    """Whether a source's ``window_token_set`` score reaches the sentence's threshold: stricter for short ones, milder for long ones."""
    low, high = SENTENCE_RANGE

    def one(s: str, pool) -> bool:
        least = max(low, min(high, SENTENCE_SCORE + (10 if len(s) < 80 else -5 if len(s) > 200 else 0)))
        return any(window_token_set(s, x) >= least for x in pool)

    return pd.Series([s is not None and p is not None and one(s, p) for s, p in zip(sentence, sources, strict=True)])
