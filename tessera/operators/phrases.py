"""Words and phrases of many queries at once, found in rows of tokens.

The phrases of a block of queries make a trie over 64-bit hashes; rows go through it in numpy, a step for each word
of the longest phrase, so a row is read once, however many queries there are. What is met is added up by query
within the task: no occurrence, and no pair of query and row that fails, is ever a row of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Pairs of a hit and a group that has it, held at once.
HELD = 1 << 21


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, grp, alt, out, i, term): words of web-search queries. A query wants one alternative of each group.

    Words stand for themselves, "phrases" for words in a row, ``or`` joins alternatives into a group, ``-``
    excludes. Pieces without a token are left out.
    """
    items = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r'(?U)-?"[^"]+"|-?[\w]+'), 0)
    q = queries.select("query_id", F.posexplode(items).alias("alt", "item"))
    order = W.partitionBy("query_id").orderBy("alt")
    q = q.withColumn("linked", F.lag("item").over(order) == "or").where("item <> 'or'")
    q = q.withColumn("grp", F.sum(F.when(F.coalesce("linked", F.lit(False)), 0).otherwise(1)).over(order))
    words = T.all_tokens(F.regexp_replace("item", '^-|"', ""))
    return q.select("query_id", "grp", "alt", F.startswith("item", F.lit("-")).alias("out"), F.posexplode(F.transform(words, lambda t: F.xxhash64(t))).alias("i", "term"))


def wanted(words: DataFrame) -> DataFrame:
    """(query_id, alts, h): the distinct alternatives (grp, out, terms) of ``words`` (as ``parsed`` makes them), and their terms.

    Queries that only exclude want nothing and are left out."""
    of = F.transform(F.array_sort(F.collect_list(F.struct("i", "term"))), lambda x: x.term)
    each = words.groupBy("query_id", "grp", "alt", "out").agg(of.alias("terms"))
    q = each.groupBy("query_id").agg(F.collect_set(F.struct("grp", "out", "terms")).alias("alts"), F.flatten(F.collect_list("terms")).alias("h"))
    return q.where(F.exists("alts", lambda a: ~a.out))


class Phrases:
    """The alternatives of a block of queries (each r["alts"]), numbered; wanted groups are numbered query by query."""

    def __init__(self, block: list):
        self.terms = np.unique(np.array([t for r in block for a in r["alts"] for t in a["terms"]], np.int64))
        spots = {int(t): i for i, t in enumerate(self.terms)}
        steps: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}  # state to phrase
        groups: list[list[int]] = []  # by phrase; excluding queries count from -1 down
        self.starts, self.sizes, self.local = [], [], []
        n = 0
        for number, r in enumerate(block):
            names = sorted({a["grp"] for a in r["alts"] if not a["out"]})
            self.starts.append(n)
            self.sizes.append(len(names))
            self.local += range(len(names))
            for a in r["alts"]:
                at = 0
                for t in a["terms"]:
                    at = steps.setdefault((at, spots[t]), len(steps) + 1)
                if at not in ends:
                    ends[at] = len(groups)
                    groups.append([])
                groups[ends[at]].append(-1 - number if a["out"] else n + names.index(a["grp"]))
            n += len(names)
        self.starts, self.sizes, self.local = np.array(self.starts, np.int64), np.array(self.sizes, np.int64), np.array(self.local, np.int64)
        self.query = np.repeat(np.arange(len(block)), self.sizes)  # of each wanted group
        self.phrase = np.full(len(steps) + 1, -1)
        self.phrase[list(ends)] = list(ends.values())
        keys = np.array([s * len(self.terms) + w for s, w in steps], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.array(list(steps.values()), np.int64)[order]
        self.first = np.append(0, np.cumsum([len(g) for g in groups])).astype(np.int64)
        self.groups = np.array([x for g in groups for x in g], np.int64)

    def found(self, h: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the last word, phrase, words) of all occurrences in tokens that are ordered by row, then place."""
        spot = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[spot] == h
        at = np.flatnonzero(known)
        state, out, words = np.zeros(len(at), np.int64), [], 1
        while len(at):
            key = state * len(self.terms) + spot[at]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[i] == key
            at, state = at[good], self.targets[i[good]]
            hit = self.phrase[state] >= 0
            out.append((at[hit], self.phrase[state[hit]], np.full(hit.sum(), words)))
            at, state = at[at + 1 < len(h)], state[at + 1 < len(h)]
            on = known[at + 1] & (row[at + 1] == row[at]) & (place[at + 1] == place[at] + 1)
            at, state, words = at[on] + 1, state[on], words + 1
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def spread(self, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``phrase``, group) of each phrase and group that has it."""
        n = self.first[phrase + 1] - self.first[phrase]
        of = np.repeat(np.arange(len(phrase)), n)
        return of, self.groups[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[phrase], n)]

    def parts(self, row: np.ndarray, phrase: np.ndarray, rows: int, most: int = 256) -> Iterator[tuple[int, int]]:
        """Ranges of at most ``most`` rows, whose hits have about HELD groups together (a row at least)."""
        cost = np.append(0, np.cumsum(np.bincount(row, self.first[phrase + 1] - self.first[phrase], minlength=rows)))
        lo = 0
        while lo < rows:
            hi = max(lo + 1, min(lo + most, rows, int(np.searchsorted(cost, cost[lo] + HELD, side="right")) - 1))
            yield lo, hi
            lo = hi

    def satisfied(self, row: np.ndarray, phrase: np.ndarray, rows: int) -> np.ndarray:
        """(rows x queries) Whether a row has all wanted groups of a query and no excluded one, by its hits."""
        met = np.zeros((rows, len(self.query)), bool)
        bad = np.zeros((rows, len(self.sizes)), bool)
        key = np.unique(row * (len(self.first) - 1) + phrase)
        row, phrase = key // (len(self.first) - 1), key % (len(self.first) - 1)
        of, group = self.spread(phrase)
        out = group < 0
        met[row[of[~out]], group[~out]] = True
        bad[row[of[out]], -1 - group[out]] = True
        return (np.add.reduceat(met, self.starts, axis=1, dtype=np.int64) == self.sizes) & ~bad
