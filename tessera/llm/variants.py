"""Spelling variants by full neighbourhood generation.

``vocabulary`` counts the lower-cased letter runs of all texts. ``neighbours`` emits, for each word,
all distinct strings that one deletion, replacement or insertion over the observed alphabet makes of
it, and hash-joins them to the vocabulary: what meets is one edit apart, so no distance is computed.
``grouped`` takes each word's commonest near word as its form and follows forms to the last.

A word of 8 letters has about 900 neighbours over an alphabet of 50, nearly all of them no word. So
a merged bit map of the vocabulary's hashes (a Bloom filter, two bits a word) stands before the join:
an edit changes a polynomial hash by a term or two, so a neighbour's hash costs one addition, and only
neighbours whose bits are set become strings and are shuffled. The map has no false negatives: it
loses no pair, and those that it lets through in vain find no partner in the join.

The map has about ``BITS_A_WORD`` bits for each word of the vocabulary and 2^``max_bits`` at most;
a vocabulary beyond that fills it up, and more neighbours go to the join, with the same result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmap
from .common import Table, small_batches
from .windows import mix

_U = np.uint64
BITS_A_WORD = 24

#: Letters A-Z and U+00C0 to U+00FF by their Latin-1 bytes; A-Z become small, all else parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def letter_runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, as Latin-1: a byte for each code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


#: What a run of a document becomes: (document id, run) to a run, or None where it stays.
Change = Callable[[int | None, list[bytes]], dict[bytes, bytes]]


def rare_deletions(doc_id: int | None, runs: list[bytes]) -> dict[bytes, bytes]:
    """One letter off the runs whose crc32 with the document's id is divisible by 97 (misspellings with a known cause)."""
    if doc_id is None:
        return {}
    seed, crc, out = zlib.crc32(b"%d:" % doc_id), zlib.crc32, {}
    for w in runs:
        h = crc(w if w.isascii() else w.decode("latin-1").encode(), seed)
        if h % 97 == 0:
            at = h % len(w)
            out[w] = w[:at] + w[at + 1 :]
    return out


def _counts(change: Change | None, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, n = [w.decode("latin-1") for w in seen], np.fromiter(seen.values(), np.int64, len(seen))
            seen.clear()
            for at in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + (1 << 16)], pa.string()), pa.array(n[at : at + (1 << 16)])], ["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                if not text:
                    continue
                runs = letter_runs(text)
                seen.update(runs)
                changed = change(i, list(set(runs))) if change else None
                if changed:
                    own = Counter(runs)
                    for w, new in changed.items():
                        seen[w] -= own[w]
                        seen[new] += own[w]
                if len(seen) >= held:
                    yield from out()
        if seen:
            yield from out()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, change: Change | None = None, held: int = 400_000) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points that occur ``least_count`` times or more, with their counts.

    A task counts up to about ``held`` words before it hands them on, so a frequent word is a few
    rows for each task. Null and empty texts have no words; repeated rows count again; ``change``
    can replace the runs of a document before they are counted (rows with a null id keep theirs).
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    each = rows.mapInArrow(_counts(change, held), "word string, n long").where(F.length("word") >= least_length)
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class _Hash:
    """Polynomial hashes of rows of code points, and of what one edit makes of them."""

    P = _U(0x9E3779B97F4A7C15)

    @staticmethod
    def letter(c: np.ndarray) -> np.ndarray:
        return mix(c.astype(np.uint64) + _U(0x1234567))

    def __init__(self, longest: int):
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(longest + 2, self.P, np.uint64))

    def words(self, c: np.ndarray) -> np.ndarray:
        """Of an (m, length) array."""
        return (self.letter(c) * self.powers[: c.shape[1]]).sum(axis=1, dtype=np.uint64)

    def edits(self, c: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """("delete", (m, length)), ("replace", (m, length, letters)), ("insert", (m, length + 1, letters))."""
        m, n = c.shape
        p = self.powers
        h = self.letter(c)
        term = h * p[:n]
        zero = np.zeros((m, 1), np.uint64)
        before = np.concatenate([zero, np.cumsum(term, axis=1, dtype=np.uint64)], axis=1)  # (m, n + 1): letters [0, i)
        shifted = np.concatenate([zero, np.cumsum(h * p[1 : n + 1], axis=1, dtype=np.uint64)], axis=1)  # each letter one place later
        left = np.concatenate([zero, np.cumsum(h[:, 1:] * p[: n - 1], axis=1, dtype=np.uint64)], axis=1)  # letters [1, i + 1), one place earlier
        yield "delete", before[:, :n] + (left[:, n - 1 : n] - left)
        a = self.letter(alphabet)
        yield "replace", (before[:, n:] - term)[:, :, None] + p[:n, None] * a
        yield "insert", (before + (shifted[:, n:] - shifted))[:, :, None] + p[: n + 1, None] * a


def _cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash: separate fields of it, as ``bits`` is 32 at most."""
    return h >> _U(64 - bits), h & _U((1 << bits) - 1)


def _points(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words by length: (their places, an (m, length) array of code points)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.frombuffer("".join(words[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)


def _map_of(words: DataFrame, bits: int) -> np.ndarray:
    """The merged bit map: 2^bits bits, bounded by ``max_bits``."""

    def cells(b: pa.RecordBatch) -> np.ndarray:
        found = [x for _, c in _points([w for w in b.column(0).to_pylist() if w]) for x in _cells(mix(_Hash(c.shape[1]).words(c)), bits)]
        return np.concatenate(found or [np.zeros(0, np.uint64)])

    return bitmap.merged(words.select("word"), bits, cells)


def _utf8(c: np.ndarray) -> pa.Array:
    """Strings of an (m, length) array of code points."""
    m, n = c.shape
    whole = np.ascontiguousarray(c.astype(np.uint32)).tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([whole[i : i + n] for i in range(0, m * n, n)], pa.string())


def edited(c: np.ndarray, kind: str, at: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Row by row, the edit of ``kind`` at place ``at`` (of, or before, the letter there) with ``letter``."""
    m, n = c.shape
    if kind == "replace":
        out = c.copy()
        out[np.arange(m), at] = letter
        return out
    size = n - 1 if kind == "delete" else n + 1
    place = np.arange(size)
    if kind == "delete":
        return np.take_along_axis(c, place + (place >= at[:, None]), axis=1)
    out = np.take_along_axis(c, np.minimum(place - (place > at[:, None]), n - 1), axis=1)
    out[np.arange(m), at] = letter
    return out


def _neighbours(bits: int, shared, alphabet: list[int], room: int = 1 << 22):
    """Rows (near, word): the distinct neighbours of each word whose bits are set; ``room`` hashes in memory at a time."""
    letters = np.array(alphabet, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            words = b.column(0).to_pylist()
            for at, c in _points(words):
                n = c.shape[1]
                hashes, step = _Hash(n), max(1, room // (n * max(len(letters), 1) + 1))
                for lo in range(0, len(at), step):
                    part, of = c[lo : lo + step], at[lo : lo + step]
                    for kind, h in hashes.edits(part, letters):
                        h = mix(h)
                        hit = np.nonzero(bitmap.has(known, _cells(h, bits)[0]))
                        both = np.flatnonzero(bitmap.has(known, _cells(h[hit], bits)[1]))
                        hit = [x[both] for x in hit]
                        row, place = hit[0], hit[1]
                        letter = letters[hit[2]] if len(hit) > 2 else np.zeros(len(row), np.uint32)
                        if kind == "replace":
                            keep = part[row, place] != letter
                        else:  # of equal results in a stretch of equal letters, the first
                            keep = (place == 0) | (part[row, np.maximum(place - 1, 0)] != (part[row, np.minimum(place, n - 1)] if kind == "delete" else letter))
                        row, place, letter = row[keep], place[keep], letter[keep]
                        if len(row) and (kind != "delete" or n > 1):
                            yield pa.RecordBatch.from_arrays([_utf8(edited(part[row], kind, place, letter)), pa.array([words[i] for i in of[row]], pa.string())], ["near", "word"])

    return run


def neighbours(spark: SparkSession, words: DataFrame, max_bits: int = 30) -> DataFrame:
    """(word, near, near_n): each word of ``words`` (word, n; words are distinct and not null) with each word that is one edit apart.

    Every pair comes twice, once for either word. The observed alphabet is the code points that occur
    in ``words``; a word of another length by one shares all its letters but one with its neighbour.
    """
    letters = [r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().limit(1 << 21).collect()]  # code points: at most 1.1 million
    count = words.count()
    bits = min(max_bits, max(19, math.ceil(math.log2(max(count, 1) * BITS_A_WORD))))
    shared = spark.sparkContext.broadcast(_map_of(words, bits))
    # a partition for about 20,000 words: a word is a thousand hashes
    tasks = max(spark.sparkContext.defaultParallelism, min(count // 20_000, 100_000))
    made = words.select("word").repartition(tasks).mapInArrow(_neighbours(bits, shared, sorted(map(ord, letters))), "near string, word string")
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return made.join(known, "near").select("word", "near", "near_n")


def last_forms(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(word, root): the last word that ``links`` (word, form) lead to; no word may lead back to itself.

    Each round follows twice as many links by a self-join; a chain of n links takes log2 n rounds,
    each a table in the shared folder.
    """
    now = Table(spark, links.select("word", F.col("form").alias("root")), "forms")
    while True:
        up = now.df.select(F.col("word").alias("root"), F.col("root").alias("above"))
        new = Table(spark, now.df.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "forms")
        moved = new.df.where("moved").limit(1).count()
        now.drop()
        now = new
        now.df = new.df.select("word", "root")
        if not moved:
            return now.df


def grouped(spark: SparkSession, words: DataFrame, ratio: int = 2, **kw) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (word, n).

    The form is the near word with the greatest count (ties: the smallest in code-point order), if
    that count is at least ``ratio`` times the word's own; counts grow along a chain of forms, so
    chains end after log(n) links. A word without near words has n_near 0, no form, and itself as
    root. An empty table gives an empty result. ``ratio`` is at least 2.
    """
    words = Table(spark, words.select("word", "n"), "vocabulary").df
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near"))).alias("best")
    near = neighbours(spark, words, **kw).groupBy("word").agg(F.count("*").alias("n_near"), best)
    took = -F.col("best.k") >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(took, F.col("best.near")).alias("form"), F.when(took, -F.col("best.k")).alias("form_n")
    )
    judged = Table(spark, judged, "near").df
    roots = last_forms(spark, judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
