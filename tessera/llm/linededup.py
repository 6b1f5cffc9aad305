"""Fuzzy line dedup by MinHash.

A shingle is nine characters, at every character of a line (a shorter line is one shingle). The
signature is a bottom-k MinHash: the ``kept`` least hashes of a line's shingles. Each ``rows`` neighbours
in it are a band. Two lines of Jaccard similarity 0.8 share a band unless no two neighbours of eight
survive: they meet with probability 0.99.

Before texts are fetched for a pair, the numbers of shingles and 256 parities of them rule out pairs that can't reach
the threshold: a bound, not an estimate, so none is lost. (A parity is odd if an odd number of a line's shingles
falls to it. Shared shingles cancel out, so a parity shows a difference whatever else falls to it.)

The lines of a small bucket are all paired; in a larger one every line is paired with the bucket's
least and greatest line. A pair counts only if the exact Jaccard similarity of the full shingle sets
reaches the threshold. A line is first compared with its least partner; of the other pairs only those that
are not connected yet are compared too. Lines of larger buckets that this has not connected as a whole (a
passage that many lines share makes such buckets) meet once more by bands of five least shingles in
twenty tables, which only similar lines share often. What is then not connected is compared in full: every
pair of a large bucket's lines of different components goes by the bounds of their sizes and maps, in
parts, and by the exact check if these allow it. So every pair that shares a band and holds is linked. Verified pairs go
to distributed union-find; the least line (by doc_id, then line number) of a component stays.

Lines travel by a 64-bit hash; texts are fetched for candidates alone. (Lines that share that hash
but not a second one are told apart and keep their own.) Hot buckets: least and greatest are
combined aggregates, and the join that brings them back has plain exchanges that Spark splits.

Shingles are hashed in numpy over the lines' bytes, a batch of lines at once; joins, buckets and
components are DataFrame operations. The same steps in DataFrame functions alone stay over the
time that the check tool allows (README has the figures): a regular expression and a list for each
shingle cost ten times as much as its hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import SPACES, Table, fresh, light, row_key, scratch, small_batches
from .components import components
from .windows import Polynomial, mix, slices, texts

WIDTH = 9
#: Parities of a line's shingles that stand before the exact check.
MAP = 256
#: And those that stand before it where every pair of a bucket meets.
WIDE_MAP = 1024
#: Lines of a large bucket that a task takes against all of it.
PART = 1000

#: Lines that are hashed at once, so that one number has a line's place and the upper bits of a shingle's hash.
ROWS = 1 << 15
_HASH_BITS = 49

_U = np.uint64
_LONGS = ArrayType(LongType())
_HASH = Polynomial(WIDTH)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, line_no, line): lines with a word of rows with an id; ``row`` is a hash of id and text."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    # the key below the generator: above it, it would take the whole text along with each line
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.split(F.col(text_col).cast("string"), "\n").alias("lines"))
    rows = rows.select("doc_id", "row", F.posexplode("lines").alias("line_no", "line"))
    return rows.where(F.btrim("line", F.lit(SPACES)) != "")


def _hashes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the lines, in order and with repeats (a shingle is short enough to be a plain polynomial), and where each line's begin (and the last one's end)."""
    data, starts = texts(lines)
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
    at = np.searchsorted(chars, starts)
    count = np.diff(at)
    n = np.maximum(count - WIDTH + 1, np.minimum(count, 1))
    # one for each character that has WIDTH of them from it on, over all lines at once; then those go that cross a line's end
    run, inverse = (x[chars] for x in _HASH.sums(data))
    h = np.zeros(len(chars) - 1, dtype=_U)
    np.subtract(run[WIDTH:], run[:-WIDTH], out=h[: max(0, len(run) - WIDTH)])
    h *= inverse[:-1]
    stays = np.ones(len(h), dtype=bool)
    for k in range(1, WIDTH):
        stays[(at[1:] - k)[count >= k]] = False
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    h[at[short]] = (run[at[short + 1]] - run[at[short]]) * inverse[at[short]]
    stays[at[short]] = True
    return mix(h[stays]), np.append(0, np.cumsum(n))


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row and their rows, ordered by row, then by hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _brief(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_distinct``, with the upper 49 bits of the hashes: one sort of plain numbers, which takes a fraction of the time."""
    key = row.astype(_U) << _U(_HASH_BITS) | h >> _U(64 - _HASH_BITS)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key & _U((1 << _HASH_BITS) - 1), (key >> _U(_HASH_BITS)).astype(np.int64)


def _least(h: np.ndarray, edge: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``kept`` least distinct hashes (their upper bits) of each line, and where each line's begin."""
    n = np.diff(edge)
    row = np.repeat(np.arange(len(n)), n)
    # only hashes that can be among the least are sorted: those below a bound that some 4 * kept pass, or all if too few do
    bound = np.where(n > 4 * kept, _U(2**64 - 1) // np.maximum(n, 1).astype(_U) * _U(4 * kept), _U(2**64 - 1))
    low = h <= bound[row]
    x, r = _brief(h[low], row[low])
    few = (np.bincount(r, minlength=len(n)) < kept)[row] & ~low
    if few.any():
        low |= (np.bincount(r, minlength=len(n)) < kept)[row]
        x, r = _brief(h[low], row[low])
    first = np.searchsorted(r, np.arange(len(n)))
    stays = np.arange(len(r)) - first[r] < kept
    return x[stays], np.searchsorted(r[stays], np.arange(len(n) + 1))


def _arrays(h: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(h.view(np.int64)))


def _in_parts(run, *columns: pa.Array) -> pa.Array:
    """``run`` over parts of about a megabyte of each column, and of ``ROWS`` rows at most."""
    whole = pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))])
    parts = [whole.slice(i, ROWS) for i in range(0, len(whole), ROWS)]
    for i in range(len(columns)):
        parts = [x for p in parts for x in slices(p, i)]
    return pa.concat_arrays([run(*p.columns) for p in parts] or [run(*columns)])


def shingles(line: Column) -> Column:
    """Distinct 64-bit hashes of a line's shingles."""

    def run(x):
        h, edge = _hashes(x)
        h, row = _distinct(h, np.repeat(np.arange(len(x)), np.diff(edge)))
        return _arrays(h, np.searchsorted(row, np.arange(len(x) + 1)))

    return F.arrow_udf(lambda x: _in_parts(run, x), _LONGS)(line)


def bands(line: Column, kept: int = 8, rows: int = 2) -> Column:
    """Hashes of each ``rows`` neighbours of the ``kept`` least shingles of a line (of all, where these are fewer)."""

    def run(x):
        low, edge = _least(*_hashes(x), kept)
        n = np.diff(edge)
        many = np.maximum(n - rows + 1, np.minimum(n, 1))
        out = np.append(0, np.cumsum(many))
        at = np.arange(out[-1]) + np.repeat(edge[:-1] - out[:-1], many)
        end = np.repeat(edge[1:], many)
        h = np.zeros(len(at), dtype=_U)
        for i in range(rows):
            inside = at + i < end
            h[inside] = mix(h[inside] * _U(3) + low[at[inside] + i])
        return _arrays(h, out)

    return F.arrow_udf(lambda x: _in_parts(run, x), _LONGS)(line)


def similar(a: Column, b: Column, threshold: float) -> Column:
    """Whether the Jaccard similarity of two lines' shingle sets reaches the threshold."""

    def run(x, y):
        n = len(x)
        h, edge = _hashes(pa.concat_arrays([x, y]))
        pair = np.repeat(np.tile(np.arange(n, dtype=_U), 2), np.diff(edge))
        # one number for pair, shingle (at least 48 bits of it within a pair) and side, so that one sort does
        bits = max(1, (n - 1).bit_length())
        key = (pair << _U(64 - bits)) | (h >> _U(bits) & ~_U(1))
        key[edge[n] :] |= _U(1)
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        pair = (key >> _U(64 - bits)).astype(np.int64)
        shared = np.bincount(pair[1:][key[1:] >> _U(1) == key[:-1] >> _U(1)], minlength=n)
        return pa.array(shared >= threshold * (np.bincount(pair, minlength=n) - shared) - 1e-9)

    return F.arrow_udf(lambda x, y: _in_parts(run, x, y), "boolean")(a, b)


def longer_bands(line: Column, tables: int = 20, rows: int = 5) -> Column:
    """``tables`` bands of ``rows`` least shingles each, all of these in an order of their own: similarity 0.8 shares one with probability 0.9996."""
    odd = mix(np.arange(1, tables * rows + 1, dtype=_U)) | _U(1)

    def run(x):
        h, edge = _hashes(x)
        n = np.diff(edge)
        some = np.flatnonzero(n)
        out = np.tile(np.arange(tables, dtype=_U), (len(some), 1))
        for i, a in enumerate(odd if len(some) else ()):
            out[:, i // rows] = mix(out[:, i // rows] * _U(3) + np.minimum.reduceat(h * a, edge[some]))
        return _arrays(out.ravel(), np.append(0, np.cumsum(np.where(n > 0, tables, 0))))

    return F.arrow_udf(lambda x: _in_parts(run, x), _LONGS)(line)


def candidates(spark: SparkSession, keyed: DataFrame, small: int = 16) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b: keys (h1) of lines that share a bucket: all pairs of a bucket of at most ``small`` distinct
    keys, else each line with the bucket's ends; and (band, h1) of these larger buckets. ``keyed`` (h1, bands)
    is a written table."""
    banded = keyed.select("h1", F.explode("bands").alias("band"))
    ends = banded.groupBy("band").agg(F.min("h1").alias("least"), F.max("h1").alias("most"), F.count("*").alias("n")).where("least < most")
    ends = Table(spark, ends, "buckets").df
    wide = Table(spark, ends.where("n > 2"), "wide-buckets").df
    met = Table(spark, banded.join(light(wide.select("band")), "band").select("band", "h1").distinct(), "bucket-keys").df
    size = Table(spark, met.groupBy("band").agg(F.count("*").alias("size"), F.min("h1").alias("least"), F.max("h1").alias("most")), "bucket-sizes").df
    # bounded groups: their pairs are made in place
    group = met.join(size.where(F.col("size") <= small).select("band"), "band", "left_semi").groupBy("band").agg(F.sort_array(F.collect_list("h1")).alias("g"))
    near = group.select("g", F.posexplode("g").alias("i", "a")).select("a", F.explode(F.slice("g", F.col("i") + 2, small)).alias("b"))
    many = met.join(size.where(F.col("size") > small), "band")
    far = many.select("h1", F.explode(F.array("least", "most")).alias("other")).where("h1 <> other")
    pairs = ends.where("n = 2").select(F.col("least").alias("a"), F.col("most").alias("b")).unionByName(near)
    pairs = pairs.unionByName(far.select(F.least("h1", "other").alias("a"), F.greatest("h1", "other").alias("b")))
    return Table(spark, pairs.distinct(), "pairs").df, Table(spark, many.select("band", "h1"), "large-buckets").df


def sketch(line: Column, size: int = MAP) -> Column:
    """The number of a line's distinct shingles, then ``size`` parities of them (a power of two)."""

    def run(x):
        h, edge = _hashes(x)
        n = len(x)
        h, row = _brief(h, np.repeat(np.arange(n), np.diff(edge)))
        cell = (h >> _U(_HASH_BITS + 1 - size.bit_length())).astype(np.int64)
        odd = np.bincount(row * size + cell, minlength=n * size).astype(np.uint8) & 1
        words = np.packbits(odd.reshape(n, size), axis=1).view(np.int64)
        out = np.concatenate([np.bincount(row, minlength=n)[:, None], words], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

    return F.arrow_udf(lambda x: _in_parts(run, x), _LONGS)(line)


def _texts(spark: SparkSession, lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(h1, line, sketch): the lines of ``keys``, written."""
    text = lines.select("line", F.xxhash64("line").alias("h1")).join(light(keys), "h1", "left_semi")
    once = text.groupBy("h1").agg(F.min_by("line", F.xxhash64(F.lit(1), "line")).alias("line"))
    return Table(spark, once.select("h1", "line", sketch(F.col("line")).alias("sketch")), "candidate-lines").df


def _possible(a: Column, b: Column, threshold: float, size: int = MAP) -> Column:
    """Whether two sketches allow the threshold. Sets of x and y shingles that reach t have sizes in proportion and differ in (1 - t) / (1 + t) (x + y) of
    them at most. A parity in which they differ has such a shingle of its own, so no more parities differ than that: no pair that reaches it is lost."""
    x, y = F.get(a, 0), F.get(b, 0)
    off = sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(1, 1 + size // 64)), F.lit(0))
    return (F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9) & (off <= (1 - threshold) / (1 + threshold) * (x + y) + 1e-9)


def _verified(spark: SparkSession, pairs: DataFrame, text: DataFrame, threshold: float, name: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold, written. Texts are fetched for pairs that the sketches allow."""
    brief = lambda n: text.select(F.col("h1").alias(n), F.col("sketch").alias(f"{n}_sketch"))
    pairs = pairs.join(brief("a"), "a").join(brief("b"), "b").where(_possible(F.col("a_sketch"), F.col("b_sketch"), threshold)).select("a", "b")
    pairs = Table(spark, pairs, f"{name}-possible").df
    met = Table(spark, pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct(), f"{name}-keys").df
    text = text.join(light(met), "h1", "left_semi")
    side = lambda n: text.select(F.col("h1").alias(n), F.col("line").alias(f"{n}_line"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(similar(F.col("a_line"), F.col("b_line"), threshold))
    return Table(spark, both.select("a", "b"), name).df


def _more(spark: SparkSession, pairs: DataFrame, known: DataFrame, text: DataFrame, threshold: float, name: str) -> DataFrame:
    """Those of the ``pairs`` that hold and that ``known`` (node, root) doesn't connect already."""
    root = lambda n: known.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
    apart = F.coalesce("a_root", "a") != F.coalesce("b_root", "b")
    rest = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(apart)
    return _verified(spark, rest.select("a", "b"), text, threshold, name)


def linked(spark: SparkSession, lines: DataFrame, keyed: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(node, root) of the keys that have a verified partner. ``lines`` has (line), ``keyed`` is a written table (h1, bands)."""
    pairs, many = candidates(spark, keyed)
    keys = Table(spark, pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct(), "keys").df
    text = _texts(spark, lines, keys)
    least = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    edges = _verified(spark, least, text, threshold, "edges-1")
    rest = pairs.join(least, ["a", "b"], "left_anti")
    edges = edges.unionByName(_more(spark, rest, components(spark, edges).df, text, threshold, "edges-2"))
    known = components(spark, edges).df
    if many.limit(1).count():  # large buckets: their lines that aren't connected meet again
        again = candidates(spark, _longer(spark, many, known, text))[0]
        found = _more(spark, again, known, text, threshold, "edges-3")
        if found.limit(1).count():
            edges = edges.unionByName(found)
            known = components(spark, edges).df
        found = _rest(spark, many, known, text, threshold)  # what neither connects: every pair of a bucket
        if found.limit(1).count():
            known = components(spark, edges.unionByName(found)).df
    return known


def _rest(spark: SparkSession, many: DataFrame, known: DataFrame, text: DataFrame, threshold: float) -> DataFrame:
    """The pairs of lines of large buckets (band, h1) that hold and that ``known`` (node, root) doesn't connect. None is left out.

    Lines meet by bucket and size class (a partner's class is the same or the next), a bucket's lines in parts against all, so no
    task has a whole bucket's pairs. Sketches decide within the join: only pairs that can reach the threshold are written, each
    in the first bucket alone that has both.
    """
    rooted = Table(spark, many.join(known, F.col("h1") == F.col("node"), "left").select("band", "h1", F.coalesce("root", "h1").alias("root")), "rest-rooted").df
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("lo < hi")
    rows = Table(spark, rooted.join(split.select("band", "parts"), "band"), "rest-keys").df
    keys = Table(spark, rows.groupBy("h1").agg(F.collect_set("band").alias("bands")), "rest-lines").df
    of = text.join(light(keys), "h1").select("h1", "bands", sketch(F.col("line"), WIDE_MAP).alias("wide"))
    # the parities as plain columns that are never null: the join's condition stays short enough to be compiled
    words = [f"w{i}" for i in range(WIDE_MAP // 64)]
    of = Table(spark, of, "rest-sketches").df.select("h1", "bands", *[F.coalesce(F.get("wide", i), F.lit(0)).alias(c) for i, c in enumerate(["size", *words])])
    kind = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(-np.log(threshold)))).cast("int")
    rows = rows.join(of, "h1").withColumn("kind", kind).withColumn("before", F.filter("bands", lambda b: b < F.col("band")))
    side = lambda n: [F.col(c).alias(f"{n}_{c}") for c in ("h1", "root", "size", "before", *words)]
    large = rows.select("band", "kind", F.pmod(F.xxhash64("h1"), F.col("parts")).cast("int").alias("part"), *side("y"))
    lesser = rows.withColumn("kind", F.explode(F.array(F.col("kind"), F.col("kind") + 1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", "kind", "part", *side("x"))
    once = (F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_h1") < F.col("y_h1")))
    fits = once & (F.col("x_root") != F.col("y_root")) & (F.col("x_size") >= threshold * F.col("y_size") - 1e-9)
    # a bound as in _possible; most pairs are over it after a part of the parities
    off = [F.bit_count(F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}"))) for w in words]
    for n in (len(words) // 4, len(words) // 2, len(words)):
        fits = fits & (sum(off[1:n], off[0]) <= (1 - threshold) / (1 + threshold) * (F.col("x_size") + F.col("y_size")) + 1e-9)
    met = lesser.join(large, ["band", "kind", "part"]).where(fits & ~F.arrays_overlap("x_before", "y_before"))
    pairs = Table(spark, met.select(F.least("x_h1", "y_h1").alias("a"), F.greatest("x_h1", "y_h1").alias("b")), "rest-pairs").df
    return _verified(spark, pairs, text, threshold, "edges-4")


def _longer(spark: SparkSession, many: DataFrame, known: DataFrame, text: DataFrame) -> DataFrame:
    """(h1, bands), written: longer bands of lines of large buckets (band, h1) that ``known`` (node, root) doesn't connect as a whole."""
    rooted = Table(spark, many.join(known, F.col("h1") == F.col("node"), "left").select("band", "h1", F.coalesce("root", "h1").alias("root")), "large-rooted").df
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    keys = Table(spark, rooted.join(split.select("band"), "band", "left_semi").select("h1").distinct(), "large-keys").df
    return Table(spark, text.join(light(keys), "h1", "left_semi").select("h1", longer_bands(F.col("line")).alias("bands")), "longer-bands").df


def judged(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, kept: int = 8, rows: int = 2) -> DataFrame:
    """(doc_id, row, line_no, keep_doc_id, keep_line_no, kept) for every line with a word; line_no counts from 0.

    ``kept`` is true for the one line of each component that stays: the least by id, row and number. ``row``
    is a hash of id and text: rows of one id are told apart, and only rows equal in both are one
    document. Lines of rows with a null id or text, and lines without words, are not judged. An empty table
    gives an empty result. Lines of any length are taken whole.
    """
    small_batches(spark)
    lines = _lines(docs, id_col, text_col)
    # one pass over the texts makes all keys and bands; later ones read the columns they need
    names = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]
    keyed = Table(spark, lines.select("doc_id", "row", "line_no", *names, bands(F.col("line"), kept, rows).alias("bands")), "line-keys").df
    of = keyed.drop("bands")
    with scratch():
        root = Table(spark, linked(spark, lines, keyed, threshold), "line-roots", stays=True).df
    where = F.struct("doc_id", "row", "line_no")
    groups = of.groupBy("h1", "h2").agg(F.min(where).alias("id"), F.count("*").alias("copies"))
    # lines that share h1 but not h2: the first one has the key's component, the others have their own
    clash = of.groupBy("h1").agg(F.min("h2").alias("least"), F.max("h2").alias("most")).where("least < most").select("h1", "least")
    clash = light(Table(spark, clash, "line-clashes").df)
    # roots and kept lines are as many as the lines allow, and both sides are narrow: they meet in a shuffle, not on the driver
    groups = groups.join(root.hint("merge"), F.col("h1") == F.col("node"), "left").join(clash, "h1", "left")
    first = F.col("least").isNull() | (F.col("h2") == F.col("least"))
    # a line of one copy and of no component is kept, whatever the others are: only the rest is gathered
    groups = groups.where((F.col("copies") > 1) | (first & F.col("root").isNotNull()))
    name = F.when(first, F.struct(F.coalesce("root", "h1").alias("x"), F.lit(0).cast("long").alias("y"))).otherwise(F.struct(F.col("h1").alias("x"), F.col("h2").alias("y")))
    groups = Table(spark, groups.select("h1", "h2", "id", name.alias("name")), "line-groups").df
    keep = Table(spark, groups.groupBy("name").agg(F.min("id").alias("keep")), "kept-lines").df
    keep = Table(spark, groups.join(keep, "name").select("h1", "h2", "keep"), "line-keep").df
    out = of.join(keep.hint("merge"), ["h1", "h2"], "left").withColumn("keep", F.coalesce("keep", where))
    return out.select("doc_id", "row", "line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), (F.col("keep") == where).alias("kept"))


def without_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = True, **kw) -> DataFrame:
    """``docs`` with only the kept lines in their texts; all columns stay.

    Rows are judged one by one, repeated ids too; rows with a null id stay as they are. Blank lines stay where they are. With ``drop_empty``, documents that had words and lost all of
    them go; null texts and texts without words stay.
    """
    lines = judged(spark, docs, id_col, text_col, **kw)
    key, gone = fresh(docs, "_id"), fresh(docs, "_gone")
    off = lines.where("NOT kept").groupBy(F.col("row").alias(key)).agg(F.collect_set("line_no").alias(gone))
    off = Table(spark, off, "dropped-lines").df
    # the table grows with the texts, so it is never broadcast: they meet in one shuffle at any size
    joined = docs.join(off.hint("merge"), F.when(F.col(id_col).isNotNull(), row_key(id_col, text_col)) == F.col(key), "left")
    # dropped lines as a map: one lookup for each line
    left = F.map_from_arrays(F.col(gone), F.transform(F.col(gone), lambda _: F.lit(True)))
    joined = joined.withColumn(gone, left)
    rest = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: F.try_element_at(F.col(gone), i).isNull()), "\n")
    out = joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest))
    if drop_empty:
        out = out.where(F.col(gone).isNull() | (F.translate(F.col(text_col), SPACES, "") != ""))
    return out.select(*docs.columns)
