"""Ranked retrieval for a table of queries: lexical, vector and trigram lists, gates, fusion, scores.

Every function takes all queries at once. The three lists are block products: a block of at most
``BLOCK`` queries, whose terms or vectors form a matrix, goes to every task; a task multiplies its rows
with it and lets through only rows that can still be among a query's best. No pair of query and row is
ever a row of a table, however frequent a term is. More queries than a block are more passes.
Elsewhere small sides are broadcast below ``BROADCAST_ROWS`` (counted), and joined by a shuffle beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import fuzzy as Z
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import phrases as P
from tessera.operators import synonyms as Y
from tessera.sources.tables import small_batches, written

# Depths, weights and gates of the ranking --------------------------------------------
DEPTH = {"vec": 100, "fts": 100, "trgm": 60}
RRF_K, RRF_WEIGHTS = 60, {"vec": 0.50, "fts": 0.35, "trgm": 0.15}
RANK_GATE, RANK_SHARE = {"vec": 20, "fts": 15}, 0.15
FINAL_WEIGHTS = {"vec": 0.35, "fts": 0.25, "trgm": 0.10, "rerank": 0.30}
SIGNAL_FLOOR, EPS = 1e-2, 1e-9
HEAD_CHARS = 420
# --------------------------------------------------------------------------------------------------

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
BLOCK, ROWS, TERMS = 500, 256, 50_000
#: Multiplications that a matrix product makes in the time that counting a hit takes.
STEP = 300


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if the table has at most ``rows`` rows of ``BROADCAST_BYTES`` together, measured as JSON."""
    n = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")).alias("size")).first()
    return F.broadcast(df) if n["n"] <= rows and (n["size"] or 0) <= BROADCAST_BYTES else df


def _top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The best ``k`` rows of each query, numbered by ``rnk``; cut before the shuffle by Spark's group limit."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rnk", rank).where(F.col("rnk") <= k)


# Block products -----------------------------------------------------------------------------------


def _blocks(queries: DataFrame, most: int = BLOCK, terms: int = TERMS) -> Iterator[list]:
    """Up to ``most`` queries that have about ``terms`` terms together (one query at least)."""
    block, size = [], 0
    for r in queries.toLocalIterator():
        n = len(r["h"]) if "h" in r.asDict() else 0
        if block and (len(block) >= most or size + n > terms):
            yield block
            block, size = [], 0
        block.append(r)
        size += n
    if block:
        yield block


class _Vocabulary:
    """Ascending distinct hashes of a block's queries (each r["h"], distinct), and which queries have each."""

    def __init__(self, block: list):
        lists = [np.unique(np.asarray(r["h"], np.int64)) for r in block]
        of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.concatenate(lists or [np.zeros(0, np.int64)])
        order = np.lexsort((of, flat))
        self.queries = of[order]
        self.hashes, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.sizes = np.array([len(x) for x in lists], float)

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place of the hash, times) of what rows have of the vocabulary, by row."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        spot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[spot] == h
        key, times = np.unique(row[hit] * len(self.hashes) + spot[hit], return_counts=True)
        return key // len(self.hashes), key % len(self.hashes), times.astype(float)

    def steps(self, spot: np.ndarray) -> np.ndarray:
        """The number of queries that have each hit."""
        return self.first[spot + 1] - self.first[spot]

    def _cells(self, row: np.ndarray, spot: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[spot], n)
        return np.repeat(row, n) * len(self.sizes) + self.queries[at]

    def counts(self, row: np.ndarray, spot: np.ndarray, rows: int) -> np.ndarray:
        """Counts of hits as a matrix rows x queries."""
        return np.bincount(self._cells(row, spot, self.steps(spot)), minlength=rows * len(self.sizes)).reshape(rows, len(self.sizes))

    def spread(self, row: np.ndarray, spot: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weights, and counts of hits, as matrices rows x queries: a step for each hit and query that has it."""
        n = self.steps(spot)
        cell, shape = self._cells(row, spot, n), (rows, len(self.sizes))
        return np.bincount(cell, np.repeat(weight, n), minlength=rows * shape[1]).reshape(shape), np.bincount(cell, minlength=rows * shape[1]).reshape(shape)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column, their rows, and the lists' lengths."""
    n = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n), n


def _best(rows: DataFrame, block: list, kind: str, k: int, score: Callable) -> DataFrame:
    """(query_id, doc_id, raw [, other columns]): rows that can be among the ``k`` best of a query, by task.

    ``score`` makes a matrix (rows x queries) of a record batch, -inf for rows that don't count. What is
    let through reaches a task's k-th best score so far, less what rounding can hide.
    """
    spark, ids = rows.sparkSession, pa.array(range(len(block)), pa.int32())
    small_batches(spark)
    names = [c for c in rows.columns if c not in ("h", "v")]
    n = len(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, least = np.full((k, n), -np.inf), np.full(n, -np.inf)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = pa.record_batch([pa.concat_arrays([c.slice(lo, ROWS)]) for c in b.columns], names=b.schema.names)
                s = score(part)
                up = np.flatnonzero((s > least).any(axis=0))  # queries whose best rows change
                if len(up):
                    both = np.concatenate([best[:, up], s[:, up]])
                    best[:, up] = both = np.partition(both, len(both) - k, axis=0)[len(both) - k :]
                    least[up] = both.min(axis=0)
                row, q = np.nonzero((s >= least - 1e-6) & (s > -np.inf))
                cols = [ids.take(pa.array(q)), pa.array(s[row, q]), *[part.column(c).take(pa.array(row)) for c in names]]
                yield pa.record_batch(cols, names=["_q", "raw", *names])

    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(run, ", ".join(["_q int", "raw double", *[f"{c} {kinds[c]}" for c in names]]))
    names_of = spark.createDataFrame([(j, r["query_id"]) for j, r in enumerate(block)], f"_q int, query_id {kind}")
    return found.join(F.broadcast(names_of), "_q").drop("_q")  # a row for each query of the block


def _in_blocks(queries: DataFrame, one: Callable[[list], DataFrame], empty: DataFrame) -> DataFrame:
    out = None
    for block in _blocks(queries):
        found = one(block)
        out = found if out is None else out.unionByName(found)
    return empty if out is None else out


def _hashes(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t))


def _together(d: DataFrame) -> DataFrame:
    """``d`` (doc_id, h), a written table, with the rows of one id as one document; a 0 ends each of them."""
    again = written(d.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")
    if not again.limit(1).count():
        return d
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    many = d.join(again, same, "left_semi").groupBy("doc_id").agg(F.flatten(F.collect_list(F.concat("h", F.array(F.lit(0).cast("long"))))).alias("h"))
    return written(d.join(again, same, "left_anti").unionByName(many), "tokens-by-id")


def _frequencies(d: DataFrame, vocab: _Vocabulary) -> np.ndarray:
    """How many rows of ``d`` (doc_id, h) have each hash of the vocabulary: counted within tasks, a row for each hash and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocab.hashes), np.int64)
        for b in batches:
            h, row, _ = _flat(b.column(0))
            n += np.bincount(vocab.hits(h, row)[1], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(n[at])], names=["at", "n"])

    small_batches(d.sparkSession)
    out = np.zeros(len(vocab.hashes))
    for r in d.select("h").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # hashes of one block
        out[r["at"]] = r["n"]
    return out


# Lexical ------------------------------------------------------------------------------------------


def lexical(queries: DataFrame, docs: DataFrame, k: int = 10, match_all: bool = False, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rnk): BM25 of query terms over documents. Terms are compared by 64 bits of hash.

    The documents are tokenized once, into a table of hashes; a pass over it counts the documents, their lengths
    and those that have each term of the queries, and one for each block of queries scores, by the terms that a row and a
    query share. With ``match_all``, documents that lack a term of the query are left out.
    """
    d = written(docs.select(F.col(id_col).alias("doc_id"), _hashes(T.all_tokens(F.col(text_col))).alias("h")), "tokens")
    q = queries.select("query_id", _hashes(T.tokens(F.col("text"))).alias("h")).where(F.size("h") > 0)
    kinds = dict(d.dtypes) | dict(q.dtypes)
    whole = d.agg(F.count("*").alias("n"), F.avg(F.size("h")).alias("len")).first()
    mean = whole["len"] or 1.0
    by_id = _together(d)

    def one(block: list) -> DataFrame:
        vocab = _Vocabulary(block)
        have = _frequencies(by_id, vocab)
        idf = np.log(1 + (whole["n"] - have + 0.5) / (have + 0.5))

        def score(part: pa.RecordBatch) -> np.ndarray:
            h, row, size = _flat(part.column("h"))
            row, spot, tf = vocab.hits(h, row)
            weight = idf[spot] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / mean))
            s, met = vocab.spread(row, spot, weight, part.num_rows)
            return np.where(met == vocab.sizes if match_all else met > 0, s, -np.inf)

        return _best(d, block, kinds["query_id"], k, score)

    empty = d.limit(0).crossJoin(q.limit(0).select("query_id")).select("doc_id", F.lit(0.0).alias("raw"), "query_id")
    scored = _in_blocks(q, one, empty).select("query_id", "doc_id", F.round("raw", digits).alias("score"))
    return _top(scored, k, F.desc("score"), F.col("doc_id"))


def websearch(queries: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id) of documents that satisfy a query in web-search syntax: words (all), "phrases",
    ``or`` between words, and ``-word`` to exclude.

    Each query becomes groups of alternatives (any of a group, all groups). Documents are tokenized once; a pass over them for
    each block of queries finds all alternatives and lets through only documents that satisfy a query. Rows of one id
    are one document; no phrase goes from one row to the next.
    """
    small_batches(docs.sparkSession)
    q = P.wanted(P.parsed(queries))
    d = written(docs.select(F.col(id_col).alias("doc_id"), _hashes(T.all_tokens(F.col(text_col))).alias("h")), "tokens")
    d = _together(d)
    kinds = dict(d.dtypes) | dict(q.dtypes)

    def one(block: list) -> DataFrame:
        phrases, spark = P.Phrases(block), docs.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h, row, size = _flat(b.column(1))
                at, phrase, _ = phrases.found(h, row, np.arange(len(h)))
                order = np.argsort(row[at], kind="stable")
                hit, phrase = row[at[order]], phrase[order]
                for lo, hi in phrases.parts(hit, phrase, b.num_rows):
                    x, y = np.searchsorted(hit, [lo, hi])
                    r, q = np.nonzero(phrases.satisfied(hit[x:y] - lo, phrase[x:y], hi - lo))
                    yield pa.record_batch([pa.array(q, pa.int32()), b.column(0).take(pa.array(r + lo))], names=["_q", "doc_id"])

        names = spark.createDataFrame([(j, r["query_id"]) for j, r in enumerate(block)], f"_q int, query_id {kinds['query_id']}")
        return d.mapInArrow(run, f"_q int, doc_id {kinds['doc_id']}").join(F.broadcast(names), "_q").select("query_id", "doc_id")

    return _in_blocks(q, one, q.limit(0).select("query_id").crossJoin(d.limit(0).select("doc_id")))


# Vectors ------------------------------------------------------------------------------------------


def _units(lists: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of length one (zeros stay), cut or filled up to ``dim``; nulls, NaN and infinities as 0."""
    n, ends = len(lists), lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((n, dim))
    if (np.diff(ends) == dim).all():
        out = flat[ends[0] : ends[-1]].reshape(n, dim)
    else:
        for i in range(n):
            x = flat[ends[i] : min(ends[i + 1], ends[i] + dim)]
            out[i, : len(x)] = x
    return _of_length_one(out)


def _of_length_one(out: np.ndarray) -> np.ndarray:
    out = np.where(np.isfinite(out), out, 0.0)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def _cosines(queries: DataFrame, rows: DataFrame, k: int, bonus: Callable | None = None, made: Callable | None = None) -> DataFrame:
    """``_best`` of rows (doc_id, v, ..) by cosine similarity to the queries (query_id, v, ..) of each block. ``made`` makes rows of vectors of texts in v."""
    kind = dict(queries.dtypes)["query_id"]

    def one(block: list) -> DataFrame:
        dim = max((len(r["v"]) for r in block), default=0)
        at = _units(pa.array([r["v"] for r in block], pa.list_(pa.float64())), dim).T

        def score(part: pa.RecordBatch) -> np.ndarray:
            v = _units(part.column("v"), dim) if made is None else _of_length_one(made(part.column("v").to_pylist()).astype(float))
            s = v @ at
            return s if bonus is None else bonus(s, part, block)

        return _best(rows, block, kind, k, score)

    names = [c for c in rows.columns if c != "v"]
    empty = rows.limit(0).crossJoin(queries.limit(0).select("query_id")).select(F.lit(0.0).alias("raw"), *names, "query_id")
    return _in_blocks(queries, one, empty)


def _floats(table: DataFrame) -> Column:
    """Its column ``vec``: floats go to Python as they are, at half the bytes of doubles."""
    v = F.col("vec")
    return v if dict(table.dtypes)["vec"] == "array<float>" else V.doubles(v)


def vector(queries: DataFrame, vectors: DataFrame, k: int = 10, digits: int = 6, made: Callable | None = None) -> DataFrame:
    """(query_id, doc_id, similarity, score, rnk): exact cosine neighbours.

    ``queries`` (query_id, vec), ``vectors`` (doc_id, vec [, importance]); rows and queries without a vector
    are left out. The order is by distance; ``score`` weighs the similarity with the importance. With ``made`` (as an embedder's
    ``rows``) the vectors' ``vec`` holds texts, which become vectors within the pass that scores them.
    """
    q = queries.where("vec IS NOT NULL").select("query_id", V.doubles(F.col("vec")).alias("v"))
    imp = F.coalesce(F.col("importance"), F.lit(1.0)) if "importance" in vectors.columns else F.lit(1.0)
    d = vectors.where("vec IS NOT NULL").select("doc_id", (F.col("vec") if made else _floats(vectors)).alias("v"), imp.cast("double").alias("importance"))
    scored = _cosines(q, d, k, made=made).select("query_id", "doc_id", F.round("raw", digits).alias("similarity"), "importance")
    best = _top(scored, k, F.desc("similarity"), F.col("doc_id"))
    return best.select("query_id", "doc_id", "similarity", F.round(F.col("similarity") * (0.8 + 0.2 * F.col("importance")), digits).alias("score"), "rnk")


def similar(vectors: DataFrame, wanted: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rnk): neighbours of each of the ``wanted`` (doc_id) rows, with bonuses for its book and section.

    ``vectors`` (doc_id, vec, book, section). 2k rows are fetched by distance less .05 for the same
    book; then .1 for the same book, and .15 for the same section or .05 if one contains the other.
    """
    d = vectors.where("vec IS NOT NULL").select("doc_id", V.doubles(F.col("vec")).alias("v"), F.col("book").cast("string").alias("book"), "section")
    base = d.join(_small(wanted.select("doc_id").distinct()), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")

    def nearer(s: np.ndarray, part: pa.RecordBatch, block: list) -> np.ndarray:
        book, own = np.array(part.column("book").to_pylist(), object)[:, None], np.array([r["book"] for r in block], object)
        ids, me = np.array(part.column("doc_id").to_pylist(), object)[:, None], np.array([r["query_id"] for r in block], object)
        return np.where(ids == me, -np.inf, s + 0.05 * ((book == own) & (book != None)))  # noqa: E711

    x = _cosines(base, d, 2 * k, nearer).join(base.select("query_id", F.col("book").alias("b_book"), F.col("section").alias("b_section")), "query_id")
    same_book = F.coalesce(F.col("book") == F.col("b_book"), F.lit(False))
    bonus = F.when(same_book, 0.05).otherwise(0.0)
    x = x.withColumn("sim", F.round(F.col("raw") - bonus, digits))
    near = _top(x, 2 * k, (1 - F.col("sim")) - bonus, F.col("doc_id")).drop("rnk")
    a, b = F.lower("section"), F.lower("b_section")
    section = F.when(a == b, 0.15).when(F.contains(a, b) | F.contains(b, a), 0.05).otherwise(0.0)
    score = F.round(F.col("sim") + F.when(same_book, 0.1).otherwise(0.0) + F.coalesce(section, F.lit(0.0)), digits)
    return _top(near.select("query_id", "doc_id", score.alias("score")), k, F.desc("score"), F.col("doc_id"))


# Trigrams -----------------------------------------------------------------------------------------


def trigrams(x: Column) -> Column:
    """The set of trigrams of a normalized text's words, each padded with two blanks before and one after."""
    words = F.filter(F.split(T.normalize(x), r"(?U)[^\w]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def _spaced(x: Column) -> Column:
    """A normalized text's words, each with two blanks before and one after. White space needs no step of its own: no word has any."""
    words = F.when(T.is_ascii(x), F.regexp_replace(F.lower(x), r"\W+", "   ")).otherwise(F.regexp_replace(T.folded(x), r"(?U)[^\w]+", "   "))
    return F.concat(F.lit("  "), F.trim(words), F.lit(" "))


def _codes(spaced: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of ``_spaced`` texts as numbers (three code points of 21 bits), their rows, and how many each row has."""
    texts = [t or "" for t in spaced.to_pylist()]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    within = (row[:-2] == row[2:]) & ~((c[1:-1] == 32) & (c[2:] == 32))  # not from one word to the next
    row = row[:-2][within]
    points = np.unique(c) if len(c) < 1 << 16 else np.flatnonzero(np.bincount(c))
    bits = max(1, (len(points) - 1).bit_length())
    if 3 * bits + len(texts).bit_length() > 63:  # as good as never
        code = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[within]
        order = np.lexsort((code, row))
        code, row = code[order], row[order]
    else:  # row and ranks of the three code points in one number: one sort
        rank = np.zeros(points[-1] + 1, np.int64)
        rank[points] = np.arange(len(points))
        r = rank[c]
        key = (row << 3 * bits) | (((r[:-2] << 2 * bits) | (r[1:-1] << bits) | r[2:])[within])
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        row, low = key >> 3 * bits, (1 << bits) - 1
        code = (points[key >> 2 * bits & low] << 42) | (points[key >> bits & low] << 21) | points[key & low]
    new = np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])) if len(code) else np.zeros(0, bool)
    return code[new], row[new], np.bincount(row[new], minlength=len(texts))


def trigram(queries: DataFrame, docs: DataFrame, k: int = 60, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text", digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rnk): Jaccard similarity of trigram sets.

    Queries under three characters have no list. With ``threshold`` only rows that reach it; rows that are too
    long or too short for every query of a block aren't compared then.
    """
    q = queries.where(F.length("text") >= 3).select("query_id", _spaced(F.col("text")).alias("s"))
    q = q.withColumn("h", F.udf(lambda s: _codes(pa.array([s]))[0].tolist(), "array<bigint>")("s")).select("query_id", "h")
    d = docs.select(F.col(id_col).alias("doc_id"), _spaced(F.col(text_col)).alias("h"))
    kind, least = dict(q.dtypes)["query_id"], (threshold or 0) - 1e-6

    def one(block: list) -> DataFrame:
        vocab = _Vocabulary(block)
        ones = np.zeros((len(vocab.hashes), len(block)), np.float32)
        ones[np.repeat(np.arange(len(vocab.hashes)), np.diff(vocab.first)), vocab.queries] = 1
        short, long = vocab.sizes.min(initial=np.inf) * least, vocab.sizes.max(initial=0) / max(least, 1e-9)

        def score(part: pa.RecordBatch) -> np.ndarray:
            code, row, n = _codes(part.column("h"))
            met = np.zeros((part.num_rows, len(block)))
            fits = np.flatnonzero((n >= short) & (n <= long)) if threshold else np.arange(part.num_rows)
            if len(fits) and len(vocab.hashes):
                place = np.full(part.num_rows, -1)
                place[fits] = np.arange(len(fits))
                stays = place[row] >= 0
                at, spot, _ = vocab.hits(code[stays], place[row[stays]])
                if vocab.steps(spot).sum() * STEP < len(fits) * ones.size:
                    met[fits] = vocab.counts(at, spot, len(fits))
                else:
                    have = np.zeros((len(fits), len(vocab.hashes)), np.float32)
                    have[at, spot] = 1
                    met[fits] = have @ ones  # counts below 2^24 are exact
            s = met / np.maximum(vocab.sizes + n[:, None] - met, 1)
            return np.where((met > 0) & (s >= least), s, -np.inf)

        return _best(d, block, kind, k, score)

    empty = d.limit(0).crossJoin(q.limit(0).select("query_id")).select("doc_id", F.lit(0.0).alias("raw"), "query_id")
    scored = _in_blocks(q, one, empty).select("query_id", "doc_id", F.round("raw", digits).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return _top(scored, k, F.desc("score"), F.col("doc_id"))


def trigram_thresholds(n_tokens: Column) -> Column:
    """struct(min_sim, min_overlap) by the query's tokens."""
    pair = lambda s, o: F.struct(F.lit(s).alias("min_sim"), F.lit(o).alias("min_overlap"))
    return F.when(n_tokens <= 2, pair(0.38, 0.50)).when(n_tokens <= 4, pair(0.35, 0.50)).otherwise(pair(0.33, 0.45))


def wants_trigrams(x: Column) -> Column:
    n = T.normalize(x)
    return (F.length(n) >= 6) & (F.size(T.tokens(n)) > 1)


# Fusion -------------------------------------------------------------------------------------------


def ranked(lists: DataFrame) -> DataFrame:
    """(query_id, signal, doc_id, score, rnk): the best score of each document in each list, ranked from 1."""
    best = lists.groupBy("query_id", "signal", "doc_id").agg(F.max("score").alias("score"))
    return best.withColumn("rnk", F.row_number().over(W.partitionBy("query_id", "signal").orderBy(F.desc("score"), "doc_id")))


def rrf(lists: DataFrame, k: int = RRF_K, weights: dict[str, float] = RRF_WEIGHTS, digits: int = 9) -> DataFrame:
    """(query_id, doc_id, fused, n_signals): weighted reciprocal-rank fusion of (query_id, signal, doc_id, rnk)."""
    w = F.lit(0.0)
    for s, v in weights.items():
        w = F.when(F.col("signal") == s, v).otherwise(w)
    best = lists.groupBy("query_id", "doc_id", "signal").agg(F.min("rnk").alias("rnk"))
    return best.groupBy("query_id", "doc_id").agg(F.round(F.sum(w / (k + F.col("rnk"))), digits).alias("fused"), F.count("*").alias("n_signals"))


def gated(lists: DataFrame, queries: DataFrame, overlaps: DataFrame, want_pool: int = 80) -> DataFrame:
    """(query_id, doc_id, fused, n_signals): fusion of the documents that pass the gates.

    ``lists`` (query_id, signal, doc_id, score, rnk) with signals vec, fts, trgm; ``queries``
    (query_id, text); ``overlaps`` (query_id, doc_id, overlap). A document needs two signals, or a
    rank within the gate of vec or fts; with trigrams alone it needs similarity and overlap. Queries
    that accept too few (under max(30, half the pool)) accept all but weak trigram-only documents.
    """
    size = lists.groupBy("query_id").agg(*[F.count_if(F.col("signal") == s).alias(f"n_{s}") for s in RANK_GATE])
    wide = lists.groupBy("query_id", "doc_id").agg(*[F.min(F.when(F.col("signal") == s, F.col("rnk"))).alias(s) for s in RRF_WEIGHTS], F.max(F.when(F.col("signal") == "trgm", F.col("score"))).alias("sim"))
    q = queries.select("query_id", F.size(T.tokens(T.normalize(F.col("text")))).alias("n_tok"))
    q = q.withColumn("t", trigram_thresholds(F.col("n_tok"))).select("query_id", "n_tok", "t.min_sim", "t.min_overlap")
    x = wide.join(size, "query_id").join(q, "query_id").join(overlaps, ["query_id", "doc_id"], "left")
    gate = lambda s: F.greatest(F.lit(RANK_GATE[s]), F.ceil(RANK_SHARE * F.col(f"n_{s}")))
    signals = sum((F.when(F.col(s).isNotNull(), 1).otherwise(0) for s in RRF_WEIGHTS), F.lit(0))
    only = F.col("trgm").isNotNull() & F.col("vec").isNull() & F.col("fts").isNull()
    short = F.col("n_tok") <= 2
    sim = F.when(short, F.greatest(F.lit(0.34), F.col("min_sim") - 0.02)).otherwise(F.col("min_sim"))
    ovl = F.when(short, F.greatest(F.lit(0.50), F.col("min_overlap") - 0.05)).otherwise(F.col("min_overlap"))
    overlap = F.coalesce("overlap", F.lit(0.0))
    strict = F.when(only, (F.col("sim") >= sim) & (overlap >= ovl)).otherwise((signals >= 2) | F.coalesce(F.col("vec") <= gate("vec"), F.lit(False)) | F.coalesce(F.col("fts") <= gate("fts"), F.lit(False)))
    loose = F.when(only, (F.col("sim") >= F.col("min_sim")) & (overlap >= F.col("min_overlap"))).otherwise(F.lit(True))
    x = x.withColumn("strict", strict).withColumn("loose", loose)
    few = F.count_if("strict").over(W.partitionBy("query_id")) < max(30, want_pool // 2)
    ok = x.withColumn("few", few).where(F.when(F.col("few"), F.col("loose")).otherwise(F.col("strict"))).select("query_id", "doc_id")
    return rrf(lists.join(ok, ["query_id", "doc_id"], "left_semi"))


def topped_up(fused: DataFrame, lists: DataFrame, want: int = 80) -> DataFrame:
    """(query_id, doc_id, fused, pos): the fused order, filled up from vec and fts by their lesser rank."""
    first = fused.select("query_id", "doc_id", "fused", F.lit(0).alias("part"), F.lit(0).alias("near"))
    rest = lists.where(F.col("signal").isin("vec", "fts")).groupBy("query_id", "doc_id").agg(F.min("rnk").alias("near"))
    rest = rest.join(fused.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(0.0).alias("fused"), F.lit(1).alias("part"), "near")
    order = W.partitionBy("query_id").orderBy("part", F.desc("fused"), "near", "doc_id")
    return first.unionByName(rest).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= want).select("query_id", "doc_id", "fused", "pos")


def final_scores(candidates: DataFrame, reranked: bool = False, digits: int = 6) -> DataFrame:
    """``candidates`` (query_id, doc_id, vec, fts, trgm, rerank, importance) with ``score``.

    Each signal is divided by its query's maximum; signals whose maximum is negligible give their
    weight to the others. With ``reranked`` the reranker alone decides. Importance weighs a little.
    """
    by = W.partitionBy("query_id")
    value = lambda s: F.coalesce(F.col(s), F.lit(0.0))
    weights = {"rerank": 1.0} if reranked else FINAL_WEIGHTS
    x = candidates
    for s in weights:
        x = x.withColumn(f"_max_{s}", F.max(value(s)).over(by))
    on = {s: F.when(F.col(f"_max_{s}") > SIGNAL_FLOOR, w).otherwise(0.0) for s, w in weights.items()}
    total = sum(on.values(), F.lit(0.0))
    parts = sum((on[s] * value(s) / (F.col(f"_max_{s}") + EPS) for s in weights), F.lit(0.0))
    score = F.when(total > EPS, parts / total).otherwise(0.0) * (0.9 + 0.1 * F.coalesce("importance", F.lit(1.0)))
    return x.withColumn("score", F.round(score, digits)).drop(*[f"_max_{s}" for s in weights])


def label_boost(scored: DataFrame, labels: DataFrame, wanted: DataFrame, factor: float = 1.05, digits: int = 6) -> DataFrame:
    """``scored`` with its score times ``factor`` for each of a document's labels that the query wants.

    ``labels`` (doc_id, ns, code, path), ``wanted`` (query_id, ns, code): a label counts by its code or an ancestor.
    A document's labels and a query's wishes meet on the scored rows alone, never each with each.
    """
    codes = F.filter(F.array_distinct(F.concat(F.array("code"), F.coalesce("path", F.array().cast("array<string>")))), lambda c: c.isNotNull())
    of = labels.where("ns IS NOT NULL").groupBy("doc_id").agg(F.collect_set(F.struct("ns", F.col("code").alias("own"), codes.alias("codes"))).alias("_labels"))
    want = wanted.where("ns IS NOT NULL AND code IS NOT NULL").groupBy("query_id").agg(F.collect_set(F.struct("ns", "code")).alias("_wanted"))
    out = scored.join(of, "doc_id", "left").join(_small(want), "query_id", "left")
    hit = F.filter("_labels", lambda x: F.exists(x.codes, lambda c: F.array_contains("_wanted", F.struct(x.ns.alias("ns"), c.alias("code")))))
    n = F.when(F.col("_labels").isNotNull() & F.col("_wanted").isNotNull(), F.size(F.array_distinct(F.transform(hit, lambda x: F.struct(x.ns.alias("ns"), x.own.alias("own")))))).otherwise(0)
    out = out.withColumn("score", F.round(F.col("score") * F.pow(F.lit(factor), n), digits))
    return out.select("query_id", "doc_id", *[c for c in scored.columns if c not in ("query_id", "doc_id")])


def rerank_snippet(query: Column, text: Column, most: int = 700) -> Column:
    """The three sentences that share most of the query's tokens, at most ``most`` characters."""
    q = T.tokens(query)
    scored = F.transform(T.sentences(text), lambda s, i: F.struct((-T.overlap(q, T.tokens(s))).alias("o"), i.alias("i"), s.alias("s")))
    picked = F.array_join(F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: F.size(T.tokens(x.s)) > 0)), 1, 3), lambda x: x.s), " ")
    return F.substring(F.when(picked != "", picked).otherwise(F.coalesce(text, F.lit(""))), 1, most)


def lexical_reranker(query: Column, title: Column, text: Column) -> Column:
    """The default reranker, without a model: the query's share of tokens in title and snippet, 0 to 1."""
    return T.overlap(T.tokens(query), T.tokens(F.concat_ws(" ", title, rerank_snippet(query, text))))


def mmr_pick(sim_q: np.ndarray, sims: np.ndarray, groups: list, base: np.ndarray, k: int, lam: float = 0.7, penalty: float = 0.2, base_weight: float = 0.1) -> list[int]:
    """Greedy maximal marginal relevance; values equal to nine digits are ties, which go to the earlier row."""
    base = base / base.max() if len(base) and base.max() > 1e-9 else np.zeros(len(base))
    relevance = lam * sim_q + base_weight * base
    near = np.full(len(sim_q), -np.inf)
    dup = np.zeros(len(sim_q), dtype=bool)
    free, out = np.ones(len(sim_q), dtype=bool), []
    codes = pd.factorize(pd.Series(groups, dtype=object), use_na_sentinel=False)[0]
    while len(out) < min(k, len(sim_q)):
        value = relevance - (1 - lam) * near - penalty * dup if out else sim_q + base_weight * base
        i = int(np.argmax(np.where(free, np.round(value, 9), -np.inf)))
        out.append(i)
        free[i] = False
        near = np.maximum(near, sims[:, i])
        dup |= codes == codes[i]
    return out


def mmr(pool: DataFrame, k: int = 10, lam: float = 0.7, max_pool: int = 50, penalty: float = 0.2, cap: int = 12) -> DataFrame:
    """(query_id, doc_id, mmr_rank): diversified picks from ``pool`` (query_id, doc_id, pos, vec, query_vec, group [, score]).

    At most ``max_pool`` rows of each query reach a task together. A query with no more than k rows keeps its order.
    """
    k = min(k, cap)
    cut = pool.where(F.col("pos") <= max_pool)
    if "score" not in cut.columns:
        cut = cut.withColumn("score", F.lit(0.0))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "doc_id"]).reset_index(drop=True)
        if len(pdf) <= k:
            order = list(range(len(pdf)))
        else:
            v = np.nan_to_num(np.stack(pdf["vec"].map(np.asarray).tolist()).astype(float))
            q = np.nan_to_num(np.asarray(pdf["query_vec"][0], dtype=float))
            length = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(length > 0, length, 1)
            q = q / (np.linalg.norm(q) or 1)
            order = mmr_pick(v @ q, np.clip(v @ v.T, -1, 1), pdf["group"].tolist(), pdf["score"].clip(lower=0).to_numpy(float), k, lam, penalty)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[order].to_numpy(), "doc_id": pdf["doc_id"].iloc[order].to_numpy(), "mmr_rank": np.arange(1, len(order) + 1)})

    kinds = dict(pool.dtypes)
    return cut.select("query_id", "doc_id", "pos", "vec", "query_vec", "group", "score").groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, mmr_rank long")


# Queries ------------------------------------------------------------------------------------------


def inline_filters(queries: DataFrame) -> DataFrame:
    """(query_id, ns, code, prefix) of filters written in a query's text, as ``ns:value``."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?iuU)\b((?:okpd2?|окпд2?|gost|гост|ost|ост|tu|ту)\s*[:=]\s*[\w.\-]+)"), 1)
    x = queries.select("query_id", F.explode(found).alias("f")).select("query_id", F.lower(F.regexp_extract("f", r"(?U)^(\w+)", 1)).alias("name"), F.regexp_extract("f", r"(?U)[:=]\s*(.+)$", 1).alias("value"))
    ns = F.when(F.col("name").rlike("^(okpd2?|окпд2?)$"), "okpd").when(F.col("name").isin("gost", "гост"), "gost").when(F.col("name").isin("ost", "ост"), "ost").otherwise("tu")
    return x.select("query_id", ns.alias("ns"), F.when(ns != "okpd", F.col("value")).alias("code"), F.when(ns == "okpd", F.col("value")).alias("prefix"))


def expanded(queries: DataFrame, synonyms: DataFrame | None = None, most: int = 3, letters: str = "") -> DataFrame:
    """(query_id, variant, text): the normalized query, then with synonyms (longest key first; ``stem*`` keys
    match beginnings), then two paraphrases; distinct, at most ``most``. Words are of Unicode's letters, digits and ``_``, or of
    the ``letters`` (as in a pattern's brackets) that the caller names.

    ``synonyms`` (key, synonym): up to BROADCAST_ROWS of them make an automaton that finds all keys in one pass; of a larger
    dictionary a query joins only the keys that share a word's first three letters with it.
    """
    q = queries.select("query_id", T.normalize_query(F.coalesce("text", F.lit(""))).alias("q"))
    out = q.select("query_id", F.lit(0).alias("step"), F.lit(0).alias("len"), F.lit("").alias("key"), F.lit(0).alias("n"), F.col("q").alias("text"))
    if synonyms is not None:
        s = synonyms.where("key IS NOT NULL AND synonym IS NOT NULL").withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("synonym"))).withColumn("synonym", T.normalize_query(F.col("synonym")))
        rows = s.select("key", "n", "synonym").limit(BROADCAST_ROWS + 1).collect()
        if len(rows) <= BROADCAST_ROWS:
            m = Y.substituted(q, rows, letters)
        else:
            s = s.select("key", "n", "synonym", F.substring("key", 1, 3).alias("block"), F.regexp_replace("key", r"\*$", "").alias("stem"), F.endswith("key", F.lit("*")).alias("open"))
            one = f"[{letters}]" if letters else r"\w"
            words = q.select("query_id", "q", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("q", F.lit(f"(?U){one}+"), 0), lambda w: F.substring(w, 1, 3)))).alias("block"))
            word = F.concat(F.lit(rf"(?U)(?<!{one})\Q"), F.col("stem"), F.lit(r"\E"), F.when(F.col("open"), f"{one}*").otherwise(f"(?!{one})"))
            m = words.join(s, "block").where(F.regexp_like("q", word)).select("query_id", "key", "n", F.regexp_replace("q", word, F.col("synonym")).alias("text"))
        out = out.unionByName(m.select("query_id", F.lit(1).alias("step"), (-F.length("key")).alias("len"), "key", "n", "text"))
    same = [F.lit(0).alias("len"), F.lit("").alias("key"), F.lit(0).alias("n")]
    out = out.unionByName(q.where(F.startswith("q", F.lit("как "))).select("query_id", F.lit(2).alias("step"), *same, F.concat(F.lit("каким образом "), F.expr("substring(q, 5)")).alias("text")))
    out = out.unionByName(q.where(F.contains("q", F.lit("что делать"))).select("query_id", F.lit(3).alias("step"), *same, F.replace(F.col("q"), F.lit("что делать"), F.lit("пошагово")).alias("text")))
    once = out.withColumn("first", F.row_number().over(W.partitionBy("query_id", "text").orderBy("step", "len", "key", "n"))).where("first = 1")
    return once.withColumn("variant", F.row_number().over(W.partitionBy("query_id").orderBy("step", "len", "key", "n"))).where(F.col("variant") <= most).select("query_id", "variant", "text")


def vocabulary(*columns: DataFrame) -> DataFrame:
    """(word) of all tokens of one-column tables."""
    one = [c.select(F.explode(T.tokens(F.col(c.columns[0]))).alias("word")) for c in columns]
    out = one[0]
    for c in one[1:]:
        out = out.unionByName(c)
    return out.distinct()


def typos_fixed(queries: DataFrame, vocab: DataFrame, most: int = 2, by_ratio: bool = False) -> DataFrame:
    """(query_id, text): words of five letters or more that the vocabulary lacks become its closest word.

    Candidates share what is left after up to ``most`` deletions from either, as any two words within
    ``most`` edits do; the fewest edits win, then the alphabet. ``by_ratio`` takes the candidate of the greatest edit
    ratio instead, if that is TYPO_SCORE or more: words of like length that reach it are two deletions apart at most up to a
    length of 12 (for longer words raise ``most``).
    """
    w = queries.select("query_id", F.posexplode(F.regexp_extract_all(F.translate(F.lower("text"), "ё", "е"), F.lit("[а-яa-z0-9]+"), 0)).alias("pos", "w"))
    odd = w.join(vocab.withColumnRenamed("word", "w"), "w", "left_anti").where((F.length("w") >= 5) & ~F.col("w").rlike("^[0-9]+$")).select("w").distinct()


    def keys(c: str) -> Column:
        shorter = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
        out = step = F.array(F.col(c))
        for _ in range(most):
            step = F.array_distinct(F.flatten(F.transform(F.filter(step, lambda x: x != ""), shorter)))
            out = F.concat(out, step)
        return F.transform(out, lambda x: F.xxhash64(x))

    words = vocab.where(F.length("word") >= 5 - most)
    cand = odd.select("w", F.explode(keys("w")).alias("k")).join(words.select("word", F.explode(keys("word")).alias("k")), "k").select("w", "word").distinct()
    if by_ratio:
        near = cand.select("w", "word", (-Z.word_score_of(F.col("w"), F.col("word"))).alias("d")).where(F.col("d") <= -Z.TYPO_SCORE)
    else:
        near = cand.select("w", "word", F.levenshtein("w", "word", most).alias("d")).where("d >= 0")
    near = near.groupBy("w").agg(F.min(F.struct("d", "word")).alias("m"))
    fixed = w.join(near.select("w", F.col("m.word").alias("fix")), "w", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("fix", "w").alias("w")))).alias("x"))
    return fixed.select("query_id", F.array_join(F.transform("x", lambda p: p.w), " ").alias("text"))


def domain_gate(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, in_domain) from each query's three best ``hits`` (query_id, rnk, score, rerank, vec, fts, section, text).

    A score of .75 is enough. Otherwise the signals vote, with thresholds by the query's tokens, and
    some tokens must be shared. Questions about the day's weather or rates, and queries without hits, are outside.
    """
    q = queries.select("query_id", T.stem_tokens(F.col("text")).alias("qt"), T.is_realtime(F.coalesce("text", F.lit(""))).alias("live"))
    head = F.concat_ws(" ", F.coalesce("section", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 400))
    x = hits.where("rnk <= 3").withColumn("head", head).join(q, "query_id").withColumn("ov", T.overlap(F.col("qt"), T.stem_tokens(F.col("head"))))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    a = x.groupBy("query_id").agg(F.max(z("score")).alias("best"), F.max(z("rerank")).alias("rr"), F.max(z("vec")).alias("vs"), F.avg(z("fts")).alias("fs"), F.max("ov").alias("ov_max"), F.avg("ov").alias("ov_avg"), F.max(F.size("qt")).alias("n"))
    by = lambda s, m, l: F.when(F.col("n") <= 2, s).when(F.col("n") <= 4, m).otherwise(l)  # noqa: E731, E741
    seen = F.col("ov_max") >= by(0.20, 0.28, 0.30)
    short = F.col("n") <= 2
    votes = [(F.col("rr") >= by(0.08, 0.12, 0.15)) & (seen | short), (F.col("vs") >= by(0.48, 0.46, 0.42)) & (seen | short), (F.col("fs") >= by(0.20, 0.22, 0.20)) & (F.col("ov_avg") >= by(0.18, 0.22, 0.25))]
    n_votes = sum((v.cast("int") for v in votes), F.lit(0))
    ok = (F.col("best") >= 0.75) | (((F.col("ov_max") >= 0.20) | (F.col("ov_avg") >= 0.18)) & (n_votes >= by(1, 2, 2)))
    return q.join(a.select("query_id", ok.alias("ok")), "query_id", "left").select("query_id", (~F.col("live") & F.coalesce("ok", F.lit(False))).alias("in_domain"))
