"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits; bit i is the majority of bit i over the XXH64 values of its
word shingles. Two documents are linked if their fingerprints differ in at most ``radius`` bits.

Search. Each bit position i gets a nonzero vector m(i) of radius + 1 bits. For each nonzero vector
v there is one table, whose mask keeps the positions with <m(i), v> = 1. The vectors of any
``radius`` differing positions span less than the whole space, so some v is orthogonal to all of
them: its mask keeps none of the differing positions, and the pair meets in that table. No pair
within the radius is ever missed, with 2^(radius+1) - 1 tables.

Scale. Equal fingerprints are merged before the search, so copies cost nothing. A bucket of up to
``small`` fingerprints is compared pair by pair. A larger bucket, whose pairs would be quadratic,
is linked through *midpoints* instead: two fingerprints within 2 bits that agree on the mask are
both within 1 bit of a common point, so each sends itself and its one-bit neighbours outside the
mask (a fixed number of rows each), and equal points link. That is exact too, and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neardup
from .common import Table, fresh, light, row_key, scratch, small_batches
from .components import components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one whole text; 0 if it has no words (null and empty texts too)."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    over = np.zeros(_BITS, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, 8192):  # bounded memory for very long texts
        h = np.array([digest(join(words[i : i + shingle]), seed) for i in range(at, min(at + 8192, n))], dtype=">u8")
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(over * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. One row per input row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long")


def covering_masks(radius: int = 2, bits: int = _BITS) -> list[int]:
    """The masks of the tables, as signed longs. Bit positions take the nonzero vectors in turn."""
    full = (1 << (radius + 1)) - 1
    masks = [sum(1 << i for i in range(bits) if bin((1 + i % full) & v).count("1") % 2) for v in range(1, full + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _differ(x, y):
    return F.bit_count(x.bitwiseXOR(y))


def links(spark: SparkSession, fps: DataFrame, radius: int = 2, small: int = 24) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within ``radius`` bits do.

    ``fps`` has one column ``fp`` of distinct values. Pairs come from small buckets; stars around
    midpoints come from large ones.
    """
    if radius != 2:
        raise ValueError("large buckets are linked through midpoints, which is exact for radius 2")
    masks = covering_masks(radius)
    spots = F.array(*[F.struct(F.lit(k).alias("tab"), F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(spots).alias("s")).select("s.tab", "s.mask", "s.key", "fp")
    sizes = rows.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = Table(spark, rows.join(sizes, ["tab", "key"]), "buckets").df
    few, many = met.where(F.col("n") <= small), met.where(F.col("n") > small)
    # a bucket of at most `small` rows is an array of bounded length; its pairs are made in place
    group = few.groupBy("tab", "key").agg(F.collect_list("fp").alias("fps"))
    one = group.select("fps", F.explode("fps").alias("a"))
    pairs = one.select("a", F.explode(F.filter("fps", lambda y: (y > F.col("a")) & (_differ(F.col("a"), y) <= radius))).alias("b"))
    # midpoints: itself and its one-bit neighbours outside the table's mask
    bit = F.transform(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    free = F.filter(bit, lambda x: F.col("mask").bitwiseAND(x) == 0)
    points = F.concat(F.array("fp"), F.transform(free, lambda x: F.col("fp").bitwiseXOR(x)))
    stars = many.select("fp", F.explode(points).alias("point")).distinct()
    hub = stars.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top")
    # a point has at most 65 neighbours; all of them lie within 2 bits of each other
    starred = stars.join(hub, "point").where("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(starred).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links.

    One row per input row. Null and empty texts have fingerprint 0 and link like any other; rows
    with a null id get a row but name no component of others. Repeated ids share a component where
    their fingerprints do. An empty table gives an empty result.
    """
    base = Table(spark, fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints").df
    first = Table(spark, base.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fp").df
    comp = components(spark, links(spark, first.select("fp"), radius)).df
    # the component's name: the least id of all its fingerprints
    placed = first.join(comp, first.fp == comp.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = Table(spark, placed.join(named, "root").select("fp", "component_id"), "fp-component").df
    return base.join(of, "fp").select("doc_id", "fp", "component_id")


def similar(spark: SparkSession, docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, component_id): documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more are linked.

    Fingerprints within ``radius`` meet in the covering tables, and the exact similarity decides over each
    such pair. Fingerprints of 64 bits can't reach further: documents at a similarity of 0.8 differ in about
    ten bits, where covering tables would be thousands. Pairs beyond the radius come from the exact prefix
    filter of ``neardup``, so none is missed. Null ids as in ``near_duplicates``.
    """
    fps = Table(spark, fingerprints(docs, id_col, text_col, shingle, seed), "stage-fingerprints").df.select("doc_id", "fp")

    def close(found: DataFrame) -> DataFrame:
        of = found.where("doc_id IS NOT NULL AND size(hashes) > 0").select("doc_id", "key").distinct().join(fps.distinct(), "doc_id")
        of = Table(spark, of.groupBy("fp").agg(F.min("key").alias("key"), F.max("key").alias("top")), "fp-keys").df
        met = links(spark, of.select("fp"), radius).join(of.select(F.col("fp").alias("a"), F.col("key").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("key").alias("y")), "b")
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return pairs.unionByName(of.select(F.col("key").alias("a"), F.col("top").alias("b"))).where("a < b").distinct()

    return neardup.near_duplicates(spark, docs, id_col, text_col, shingle, similarity, close)


def _stays(spark: SparkSession, keyed: DataFrame, found: DataFrame, id_col: str, name: str) -> DataFrame:
    """(key, copies, stays) of the rows with an id, written: the least (id, key) of each component stays."""
    of = keyed.where(F.col(id_col).isNotNull()).groupBy(F.col(name).alias("key")).agg(F.min(F.col(id_col).cast("long")).alias("id"), F.count("*").alias("copies"))
    placed = Table(spark, of.join(found, of.key == found.doc_id).select("key", "id", "copies", "component_id"), "near-placed").df
    least = placed.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("least"))
    return Table(spark, placed.join(least, "component_id").select("key", "copies", (F.col("key") == F.col("least.key")).alias("stays")), "near-judged", stays=True).df


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **kw) -> DataFrame:
    """``docs`` with the row of the smallest id of each component; all columns stay.

    With ``similarity`` the components are those of ``similar``, else those of the fingerprints. Rows are
    judged one by one, by 64 bits of hash over id and text: an id may have several texts, each of which
    stays or goes for itself. Of rows equal in id and text one stays. Rows with a null id all stay: they
    have no place in the order of ids. An empty table gives an empty result.
    """
    name, num = fresh(docs, "_key"), fresh(docs, "_id")
    keyed = docs.withColumn(name, row_key(id_col, text_col))
    find = near_duplicates if similarity is None else partial(similar, similarity=similarity)
    with scratch():
        judged = _stays(spark, keyed, find(spark, keyed.select(name, text_col), id_col=name, text_col=text_col, **kw).distinct(), id_col, name)
    # written, so that their own size decides whether they are broadcast or the texts are shuffled
    drop = light(Table(spark, judged.where("NOT stays").select(F.col("key").alias(num)), "near-dropped").df)
    rest = keyed.join(drop, F.col(name) == F.col(num), "left_anti")
    again = light(Table(spark, judged.where("stays AND copies > 1").select(F.col("key").alias(num)), "near-again").df)
    if not again.limit(1).count():
        return rest.select(*docs.columns)
    # rows equal in id and text: any one, combined before the shuffle
    once = rest.join(again, F.col(name) == F.col(num), "left_semi").groupBy(name).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    return rest.join(again, F.col(name) == F.col(num), "left_anti").select(*docs.columns).unionByName(once)
