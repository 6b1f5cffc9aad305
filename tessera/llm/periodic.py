"""Runs (maximal repetitions) in the words of each text, by Karp-Miller-Rosenberg naming.

Level 0 names the words, equal words alike; level k + 1 names blocks of 2^(k+1) words by the pair of
their halves' names, found by sorting pairs. Only blocks whose halves both recur take part in a
sort: the name of any other block occurs once. So texts without repeats stop at a low level.

The longest common extension of two places goes down the levels: where the names of a level agree
both places advance by its block, and each level is tried once. It extends backwards over the
blocks that end at the places.

Candidates: in a run of period p and length L there are L - p >= max(p, ``least`` - p) places x in a
row whose word equals that at x + p. A grid of that step less the probe's width plus one has a
place whose whole probe (a block of ``PROBE`` words) lies among them. So for each p the
grid's places whose block at x has the name of the block at x + p are all that need extending;
harmonic sums bound the grids by n log n. Documents of a slice stand one after the other, the
longest first, each ended by a word of its own, so that a grid covers only documents long enough for p.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .windows import slices

LEAST = 12
_PROBE = 2  # level of the probe's names: blocks of four words
_CHUNK = 1 << 21  # grid places in memory at a time


class Names:
    """Names of all blocks of 2^k words; a block that reaches beyond the end has a name of its own."""

    def __init__(self, words: np.ndarray, least_levels: int = _PROBE + 1):
        """``words``: names of level 0 from 0 on; equal words of one document alike, words of others apart."""
        n = self.size = len(words)
        now = words.astype(np.int64)
        self.levels = [now]
        while True:
            k = len(self.levels) - 1
            counts = np.bincount(now, minlength=1)
            again = counts[now] > 1
            if not again.any() and k + 1 >= least_levels:
                break
            span = 1 << k
            both = np.zeros(n, bool)
            both[: max(n - span, 0)] = again[: max(n - span, 0)] & again[span:]
            at = np.flatnonzero(both)
            pairs, name = np.unique(now[at] * np.int64(len(counts)) + now[at + span], return_inverse=True)
            new = np.empty(n, np.int64)
            new[at] = name
            rest = np.flatnonzero(~both)
            new[rest] = len(pairs) + np.arange(len(rest))
            self.levels.append(new)
            now = new

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j (i < j) on."""
        i, j = i.copy(), j.copy()
        from_ = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            name, inside = self.levels[k], np.minimum(j, self.size - 1)
            step = np.where((j < self.size) & (name[np.minimum(i, self.size - 1)] == name[inside]), 1 << k, 0)
            i += step
            j += step
        return i - from_

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before i and j (i < j)."""
        i, j = i.copy(), j.copy()
        from_ = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            name, span = self.levels[k], 1 << k
            step = np.where((i >= span) & (name[np.maximum(i - span, 0)] == name[np.maximum(j - span, 0)]), span, 0)
            i -= step
            j -= step
        return from_ - i


def _grids(sizes: np.ndarray, starts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of all grids, some at a time; ``sizes`` descend."""
    longest = int(sizes[0]) if len(sizes) else 0
    if longest < least:
        return
    p = np.arange(1, longest // 2 + 1)
    fit = np.searchsorted(-sizes, -np.maximum(2 * p, least), side="right")  # documents that can have a run of period p
    reach = starts[fit]  # where the first that is too short begins
    step = np.maximum(p, least - p) - (1 << _PROBE) + 1
    counts = -(-reach // step)
    lo = 0
    while lo < len(p):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(counts[lo:]), _CHUNK, side="right")))
        n = counts[lo:hi]
        of = np.repeat(np.arange(lo, hi), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        for a in range(0, len(of), _CHUNK):
            yield k[a : a + _CHUNK] * step[of[a : a + _CHUNK]], p[of[a : a + _CHUNK]]
        lo = hi


def runs_of(docs: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each document, given as its words' names (equal words alike), its runs (start, length, period) by start, then period.

    A run is a stretch of words with smallest period q and a length of ``least`` and 2q or more that
    can't be extended with that period. ``least`` is at least 9, so that a grid's step is positive.
    """
    order = sorted(range(len(docs)), key=lambda d: -len(docs[d]))
    sizes = np.array([len(docs[d]) for d in order], np.int64)
    out = [np.zeros((0, 3), np.int64) for _ in docs]
    if not len(sizes) or sizes[0] < least:
        return out
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.empty(int(starts[-1]), np.int64)
    base = 0
    for d, s in zip(order, starts[:-1], strict=True):
        own = docs[d]
        words[s : s + len(own)] = own + base
        base += int(own.max()) + 1 if len(own) else 0
        words[s + len(own)] = base
        base += 1
    names = Names(words)
    probe, found = names.levels[_PROBE], np.zeros((0, 3), np.int64)
    for x, p in _grids(sizes, starts, least):
        y = x + p
        at = np.flatnonzero(probe[x] == probe[np.minimum(y, names.size - 1)])
        at = at[y[at] < names.size]
        if not len(at):
            continue
        x, y, p = x[at], y[at], p[at]
        begins = x - names.backward(x, y)
        ends = y + names.forward(x, y)
        good = ends - begins >= np.maximum(2 * p, least)
        # one (start, end) is found from several grid places, and with multiples of its period: the smallest stays
        found = np.concatenate([found, np.stack([begins, ends, p], axis=1)[good]])
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])] if len(found) else found
    of = np.searchsorted(starts, found[:, 0], side="right") - 1
    for d in np.unique(of):
        own = found[of == d]
        own = np.stack([own[:, 0] - starts[d], own[:, 1] - own[:, 0], own[:, 2]], axis=1)
        out[order[d]] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return out


def _named(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


_RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in part.column(1)]
                runs = runs_of([_named(w) for w in texts], least)
                kept = []
                for words, own in zip(texts, runs, strict=True):
                    if len(own):
                        stay = np.ones(len(words), bool)
                        for s, n, q in own:
                            stay[s + q : s + n] = False
                        words = [words[i] for i in np.flatnonzero(stay)]
                    kept.append(b" ".join(words))
                flat = np.concatenate(runs)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(_RUN)))
                n = pa.array([len(w) for w in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

    return run


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, text) for every row: its runs by start, then period, and its words joined by one
    space without those that a run contains after its first period.

    No shuffle; rows are judged by themselves, whatever their ids. Null and empty texts have no words
    and no runs and come out empty. A slice of about 1 MB of text is worked on at once; a longer text
    is a slice of its own and takes 8 bytes of memory a word for each level, about as many levels as
    its longest repeated stretch has binary digits.
    """
    small_batches(docs.sparkSession)
    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"CAST(`{text_col}` AS STRING) AS text")
    return rows.mapInArrow(_found(least), _RESULT)
