"""Benchmark decontamination: an FM-index for each shard of training text.

The query set (the windows of all benchmark items) goes to every task in blocks of bounded size.
A task cuts its documents into shards, indexes each shard once, searches all windows backwards,
locates the occurrences and merges them to spans of words for each document. Texts that are equal
within a shard are indexed once. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, fresh, row_key, small_batches
from .fmindex import SEPARATOR, FMIndex

#: Word bytes (0-9, a-z, all beyond ASCII) stay, A-Z become lower case, all others become a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


class Phrases:
    """Distinct windows of a block of items: by length, a matrix of symbols, and the items of each."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.symbols: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            w = [self.symbols.setdefault(x, len(self.symbols) + SEPARATOR + 1) for x in words(text)]
            size = min(window, len(w))
            for at in range(len(w) - size + 1) if size else ():
                found.setdefault(size, {}).setdefault(tuple(w[at : at + size]), set()).add(item)
        self.groups = [(size, np.array(list(g), dtype=np.int64), [sorted(x) for x in g.values()]) for size, g in sorted(found.items())]


def _spans(at: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Merged [from, to) spans of word positions."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(at, kind="stable"):
        lo, hi = int(at[i]), int(at[i] + size[i])
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


class Shard:
    """Documents of one index. ``add`` returns a document's number; equal texts share one."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.numbers = phrases, {}
        self.parts, self.starts, self.places, self.n_words, self.size = [], [], [], [], 0

    def add(self, text: str | None) -> int:
        key = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key in self.numbers:
            return self.numbers[key]
        w = words(text)
        ids = np.fromiter(map(self.phrases.symbols.get, w, repeat(SEPARATOR)), dtype=np.int64, count=len(w))
        keep = ids != SEPARATOR
        keep[1:] |= ids[:-1] != SEPARATOR  # of a run of separators the first
        place = np.flatnonzero(keep)
        self.numbers[key] = len(self.n_words)
        self.starts.append(self.size)
        self.places.append(place.astype(np.int32))
        self.parts += [ids[place], np.array([SEPARATOR])]
        self.size += len(place) + 1
        self.n_words.append(len(w))
        return len(self.n_words) - 1

    def search(self) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """Per document: merged spans of words, and items with occurrences."""
        docs: list = [([], set()) for _ in self.n_words]
        if not self.phrases.groups or self.size <= len(self.n_words):
            return docs
        text = np.concatenate([*self.parts, np.array([0])])
        index = FMIndex(text, len(self.phrases.symbols) + SEPARATOR + 1)
        at, size, group, row = [], [], [], []
        for g, (length, matrix, _) in enumerate(self.phrases.groups):
            lo, hi = index.search(matrix)
            many = hi - lo
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            at.append(index.locate(rows))
            row.append(np.repeat(np.arange(len(matrix)), many))
            size.append(np.full(len(rows), length))
            group.append(np.full(len(rows), g))
        at, size, group, row = map(np.concatenate, (at, size, group, row))
        of = np.searchsorted(self.starts, at, "right") - 1
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.diff(of[order], prepend=-1, append=len(docs)))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            mine = order[lo:hi]
            d = int(of[mine[0]])
            word = self.places[d][at[mine] - self.starts[d]]
            items = set().union(*(self.phrases.groups[g][2][r] for g, r in {(int(g), int(r)) for g, r in zip(group[mine], row[mine], strict=True)}))
            docs[d] = (_spans(word, size[mine]), items)
        return docs


_SCHEMA = "doc_id long, text string, n_words long, spans array<struct<lo:long,hi:long>>, items array<long>"


def _search(phrases, shard_symbols: int, held_chars: int, first: bool, last: bool):
    """Adds the hits of a block to what the blocks before have found; the last one drops the texts, the others hold ``held_chars`` of them."""
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, held = Shard(phrases.value), [], 0

        def out() -> pa.RecordBatch:
            found = shard.search()
            spans, items = [], []
            for _, _, n, old_spans, old_items in rows:
                at = found[n][0]
                if old_spans:
                    both = np.array(at + old_spans)
                    at = _spans(both[:, 0], both[:, 1] - both[:, 0])
                spans.append([{"lo": a, "hi": b} for a, b in at])
                items.append(sorted(found[n][1].union(old_items)))
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([shard.n_words[r[2]] for r in rows], pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_words", "spans", "items"])

        for b in batches:
            before = zip(*(b.column(k).to_pylist() for k in (3, 4)), strict=True) if not first else repeat(((), ()))
            for i, t, (old_spans, old_items) in zip(b.column(0), b.column(1), before, strict=not first):
                text = t.as_py()
                rows.append((i.as_py(), None if last else text, shard.add(text), [(s["lo"], s["hi"]) for s in old_spans], old_items))
                held += 0 if last or text is None else len(text)
                if shard.size >= shard_symbols or len(rows) >= 50_000 or held >= held_chars:
                    yield out()
                    shard, rows, held = Shard(phrases.value), [], 0
        if rows:
            yield out()

    return run


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block_items: int = 20_000, shard_symbols: int = 1_000_000, block_bytes: int = 32 << 20, held_chars: int = 8 << 20) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for every row of ``docs``; ``spans`` are merged [lo, hi) of words.

    The query set is gathered in blocks of about ``block_items`` items or ``block_bytes`` of text; each block is searched by a step of
    its own, and rows go through all steps with what was found so far, so the number of blocks changes
    nothing. A step before the last holds ``held_chars`` of texts, and one text more. Null texts have no words; items without words have no windows; null item ids are left out.
    Rows with null or repeated ids are searched each for itself.
    """
    small_batches(spark)
    n, size = benchmark.where("item_id IS NOT NULL").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_bytes))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows
    for k in range(blocks):
        items = benchmark.where(F.col("item_id").isNotNull() & (block_of == k)).select("item_id", "text").collect()
        phrases = spark.sparkContext.broadcast(Phrases([(r["item_id"], r["text"]) for r in items], window))
        found = found.mapInArrow(_search(phrases, shard_symbols, held_chars, k == 0, k == blocks - 1), _SCHEMA)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.hi - s.lo)
    return found.select("doc_id", "n_words", size.alias("n_hit"), "spans", "items")


def report(found: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at least 1/share of the words are hit)."""
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    bad = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), bad.alias("contaminated"))


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``spans`` and what separates them; the rest keeps its bytes."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    mask = np.frombuffer(raw.translate(_BYTES), np.uint8) != 32
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for lo, hi in spans:
        out.append(raw[at : start[lo]])
        at = int(start[hi]) if hi < len(start) else int(end[-1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", action: str = "drop", share: int = 20, **kw) -> DataFrame:
    """``docs`` without contaminated documents (``drop``) or without their hit words (``cut``); all columns stay.

    Documents below the share are left as they are. Each row is judged by itself, null and repeated ids too.
    """
    key, cut, name = fresh(docs, "_bad"), fresh(docs, "_spans"), fresh(docs, "_key")
    keyed = docs.withColumn(name, row_key(id_col, text_col))
    found = hits(spark, keyed, benchmark, name, text_col, **kw).where((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    bad = Table(spark, found.select(F.col("doc_id").alias(key), F.col("spans").alias(cut)).dropDuplicates([key]), "contaminated").df
    if action == "drop":
        return keyed.join(bad, F.col(name) == F.col(key), "left_anti").select(*docs.columns)

    @F.pandas_udf("string")
    def strip(text, spans):
        return text.combine(spans, lambda t, s: t if s is None else without_spans(t, [(x["lo"], x["hi"]) for x in s]))

    joined = keyed.join(bad, F.col(name) == F.col(key), "left")
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(strip(F.col(text_col), F.col(cut)))
    return joined.withColumn(text_col, text).select(*docs.columns)
