"""Substring dedup behind a count-min prefilter.

Pass 1: each partition counts the hashes of its word windows in a count-min sketch with saturating
counters (none, once, more); the sketches merge by saturating addition, segment by segment, in two
levels. A window that occurs twice anywhere has full counters in every row of the merged sketch, so
none is lost. Pass 2: only windows estimated as repeated go through the exact grouping, keyed by 96
bits of hash. Pass 3: each document drops the words of its repeated windows.

Within pass 2 a task first groups its own rows: of the documents in which it has met a window only
the smallest can be the first of all; the rest are settled there and leave no row under the window's
key. A passage in a third of all documents so sends as many rows as there were tasks, not documents.

The merged sketch is broadcast, two rows of at most 2^``max_bits`` bits. Where windows are so many
that it fills up it passes more windows to the exact grouping: slower, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, small_batches
from .windows import Hasher, Windows, mix, slices

ROWS = 2
_SEGMENT = 1 << 20  # bytes of bits
_U = np.uint64


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """A counter in each row of the sketch: two separate fields of the hash."""
    mask = _U((1 << bits) - 1)
    return [(h & mask).astype(np.uint32), ((h >> _U(32)) & mask).astype(np.uint32)]


def _set(bits: np.ndarray, cells: np.ndarray) -> None:
    """Set the bits of ascending ``cells``."""
    if not len(cells):
        return
    byte = cells >> 3
    first = np.flatnonzero(np.diff(byte, prepend=np.uint32(0xFFFFFFFF)))
    bits[byte[first]] |= np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (cells & 7).astype(np.uint8)), first)


def _test(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


class Sketch:
    """Counters of two bits: ``once`` and ``more``."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = [np.zeros(1 << max(bits - 3, 0), np.uint8) for _ in range(ROWS)]
        self.more = [np.zeros(1 << max(bits - 3, 0), np.uint8) for _ in range(ROWS)]

    def add(self, hashes: np.ndarray) -> None:
        for once, more, cells in zip(self.once, self.more, _cells(hashes, self.bits), strict=True):
            cells.sort()
            again = _test(once, cells)
            again[1:] |= cells[1:] == cells[:-1]
            _set(more, cells[again])
            _set(once, cells)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        zstd = zstandard.ZstdCompressor(level=1)
        per = -(-len(self.once[0]) // _SEGMENT)
        for r in range(ROWS):
            for k in range(per):
                part = slice(k * _SEGMENT, (k + 1) * _SEGMENT)
                if self.once[r][part].any():
                    yield r * per + k, zstd.compress(self.once[r][part].tobytes()), zstd.compress(self.more[r][part].tobytes())


def _sketch(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = Hasher(size), None
        for b in batches:
            for part in slices(b, 0):
                h = hasher(part.column(0)).hashes[0]
                if len(h):
                    sketch = sketch or Sketch(bits)
                    sketch.add(h)
        for k, once, more in sketch.segments() if sketch else ():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([once]), pa.array([more])], ["segment", "once", "more"])

    return run


_SEGMENTS = "segment int, once binary, more binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their key (the leading columns); a segment in memory at a time."""
    zstd, back = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    now, once, more = None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[-1]], pa.int32()), pa.array([zstd.compress(once.tobytes())]), pa.array([zstd.compress(more.tobytes())])], ["segment", "once", "more"])

    for b in batches:
        *keys, a, c = (x.to_pylist() for x in b.columns)
        for key, x, y in zip(zip(*keys, strict=True), a, c, strict=True):
            x, y = (np.frombuffer(back.decompress(v), np.uint8) for v in (x, y))
            if key != now:
                if now is not None:
                    yield out()
                now, once, more = key, x.copy(), y.copy()
            else:
                more |= y | (once & x)
                once |= x
    if now is not None:
        yield out()


def repeated_filter(docs: DataFrame, size: int, bits: int) -> list[np.ndarray]:
    """The merged sketch's "more than once" bits, a bitmap for each of its rows."""
    each = docs.select("text").mapInArrow(_sketch(size, bits), _SEGMENTS)
    tasks = docs.rdd.getNumPartitions()
    if tasks > 256:  # many sketches merge in two levels, the first by groups of tasks
        each = each.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks)))).select("group", "segment", "once", "more")
        each = each.repartition("segment", "group").sortWithinPartitions("group", "segment").mapInArrow(_merge, _SEGMENTS)
    merged = each.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, _SEGMENTS).select("segment", "more")
    row_bytes = 1 << max(bits - 3, 0)
    per, out = -(-row_bytes // _SEGMENT), [np.zeros(row_bytes, np.uint8) for _ in range(ROWS)]
    for r in merged.toLocalIterator():  # at most ROWS x 2^max_bits bits
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["more"])), np.uint8)
        at = (r["segment"] % per) * _SEGMENT
        out[r["segment"] // per][at : at + len(part)] = part
    return out


def _candidates(size: int, bits: int, filters, held: int):
    """Rows (h1, key, doc_id, gone); ``key`` has 32 bits of the second hash above the word position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, maps = Hasher(size, (1, 2)), filters.value
        parts: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            h1, key, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.lexsort((doc, key >> _U(32), h1))
            h1, key, doc = h1[order], key[order], doc[order]
            same = (h1[1:] == h1[:-1]) & (key[1:] >> _U(32) == key[:-1] >> _U(32))
            opens = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.repeat(doc[opens], np.diff(np.append(opens, len(doc))))
            gone = doc > least
            # settled rows go anywhere, evenly
            h1 = np.where(gone, mix(doc.view(np.uint64) ^ (key << _U(20)) ^ h1), h1)
            for at in range(0, len(h1), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(h1[s].view(np.int64)), pa.array(key[s].view(np.int64)), pa.array(doc[s]), pa.array(gone[s])], ["h1", "key", "doc_id", "gone"])

        for b in batches:
            for part in slices(b, 1):
                w: Windows = hasher(part.column(1))
                h1, h2 = w.hashes
                at = np.flatnonzero(np.logical_and.reduce([_test(m, c) for m, c in zip(maps, _cells(h1, bits), strict=True)]))
                if len(at):
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    parts.append((h1[at], (h2[at] & _U(0xFFFFFFFF00000000)) | w.pos[at].astype(np.uint64), ids[w.row[at]]))
                    if sum(len(x[0]) for x in parts) >= held:
                        yield from out()
        if parts:
            yield from out()

    return run


def repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, max_bits: int = 28, held: int = 500_000) -> DataFrame:
    """(doc_id, spans): merged [lo, hi) of words under windows that also start in a document of smaller id.

    Rows with a null id or text neither remove nor lose words. Rows of one id are one document: a
    window that only they share is not repeated.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(max_bits, max(16, math.ceil(math.log2(max(total, 1) / 3))))  # about two counters for each window
    filters = spark.sparkContext.broadcast(repeated_filter(rows, size, bits))
    found = rows.mapInArrow(_candidates(size, bits, filters, held), "h1 long, key long, doc_id long, gone boolean")
    least = F.min("doc_id").over(W.partitionBy("h1", F.call_function("shiftrightunsigned", F.col("key"), F.lit(32))))
    hit = found.withColumn("least", least).where(F.col("gone") | (F.col("doc_id") > F.col("least")))
    pos = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    of = hit.groupBy("doc_id").agg(F.sort_array(F.collect_list(pos)).alias("at"))
    first = F.filter("at", lambda x, i: F.coalesce(F.get("at", i - 1) + size < x, F.lit(True)))
    last = F.filter("at", lambda x, i: F.coalesce(F.get("at", i + 1) > x + size, F.lit(True)))
    of = of.select("doc_id", first.alias("first"), last.alias("last"))
    return of.select("doc_id", F.transform("first", lambda x, i: F.struct(x.alias("lo"), (F.get("last", i) + size).alias("hi"))).alias("spans"))


def _drop_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, kept = [], [], []
        for t, s in zip(b.column(1), b.column(2), strict=True):
            text = t.as_py()
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            n.append(len(words))
            for x in reversed(s.as_py() or ()):
                del words[x["lo"] : x["hi"]]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])


def without_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 24 << 20, **kw) -> DataFrame:
    """(doc_id, n_words, n_removed, text) for every row: the kept words, joined by one space.

    Null and empty texts have no words and come out empty. The spans are broadcast only if their
    measured size is below ``broadcast_bytes``; otherwise texts and spans meet in a shuffle.
    """
    small_batches(spark)
    spans = Table(spark, repeats(spark, docs, id_col, text_col, **kw), "repeats").df
    size = spans.agg(F.sum(F.size("spans").cast("long") * 16 + 64)).first()[0] or 0
    side = spans.withColumnRenamed("doc_id", "s_id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = rows.join(F.broadcast(side) if size <= broadcast_bytes else side, F.col("doc_id") == F.col("s_id"), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_drop_words, "doc_id long, n_words long, n_removed long, text string")
