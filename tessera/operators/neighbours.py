"""An index for vector search: rows in lists around centroids, queries probe the nearest lists.

Centroids are fitted (k-means on unit vectors) on at most ``SAMPLE`` rows, those of the least hash of their id; every row
lies in the list of its nearest centroid. A query reads ``probes`` lists: by default as many as the sample's own
neighbours need for a recall of ``RECALL``, few where vectors form clusters, most where they don't. With as many as there
are lists the result is the exact one of ``retrieval.vector``. Lists are cut into parts of bounded size, so no task holds a list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.retrieval import _in_blocks, _top, _units
from tessera.sources.tables import replace

SAMPLE = 20_000
RECALL, TRIED = 0.95, 200
PART_ROWS = 50_000


def centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means on the sphere; a centroid without rows restarts at the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        of = s.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        empty = np.flatnonzero(np.bincount(of, minlength=k) == 0)
        total[empty] = x[np.argsort(s.max(axis=1))[: len(empty)]]
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = total / np.where(size > 0, size, 1)
    return c


def probes_needed(x: np.ndarray, at: np.ndarray, k: int = 10, recall: float = RECALL, tried: int = TRIED) -> int:
    """Lists to read for that share of the ``k`` nearest rows of ``x``, measured for ``tried`` of the rows."""
    q = x[:tried]
    true = np.argsort(-(q @ x.T), axis=1)[:, : k + 1]  # itself, and k others
    order = np.argsort(-(q @ at.T), axis=1)
    rank = np.argsort(order, axis=1)[np.arange(len(q))[:, None], (x @ at.T).argmax(axis=1)[true]]
    return int(np.quantile(rank, recall, method="inverted_cdf")) + 1


class Lists:
    """Stored lists: ``path/rows`` (list, part, doc_id, v, importance) by list, ``path/centroids`` (list, v, probes)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.rows = spark, spark.read.parquet(f"{path}/rows")
        found = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list"])  # bounded by the sample
        self.centroids, self.probes = np.array([r["v"] for r in found], float), found[0]["probes"]

    def nearest(self, queries: DataFrame, k: int = 10, probes: int | None = None, digits: int = 6) -> DataFrame:
        """(query_id, doc_id, similarity, score, rnk), as ``retrieval.vector`` has them, from ``queries`` (query_id, vec)."""
        q = queries.where("vec IS NOT NULL").select("query_id", V.doubles(F.col("vec")).alias("v"))
        kinds, at = dict(self.rows.dtypes) | dict(q.dtypes), self.centroids
        probes = min(probes or self.probes, len(at))

        def one(block: list) -> DataFrame:
            unit = _units(pa.array([r["v"] for r in block], pa.list_(pa.float64())), at.shape[1])
            near = np.argsort(-(unit @ at.T), axis=1, kind="stable")[:, :probes]
            asked = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
            ids = pa.array(range(len(block)), pa.int32())

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best: dict[int, np.ndarray] = {}  # each query's k best scores so far in this task
                for b in batches:
                    lists = b.column(0).to_numpy()
                    v = _units(b.column(2), at.shape[1])
                    for c in np.unique(lists):
                        row, who = np.flatnonzero(lists == c), asked[int(c)]
                        s = v[row] @ unit[who].T
                        for j, w in enumerate(who):
                            top = np.concatenate([best.get(w, np.full(k, -np.inf)), s[:, j]])
                            best[w] = np.partition(top, len(top) - k)[len(top) - k :]
                        floor = np.array([best[w].min() for w in who])
                        hit, col = np.nonzero(s >= floor - 1e-6)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[col])), b.column(1).take(pa.array(row[hit])), pa.array(s[hit, col]), b.column(3).take(pa.array(row[hit]))], ["_q", "doc_id", "raw", "importance"])

            read = self.rows.where(F.col("list").isin(*asked)).select("list", "doc_id", "v", "importance")
            found = read.mapInArrow(run, f"_q int, doc_id {kinds['doc_id']}, raw double, importance double")
            names = self.spark.createDataFrame([(j, r["query_id"]) for j, r in enumerate(block)], f"_q int, query_id {kinds['query_id']}")
            return found.join(F.broadcast(names), "_q").drop("_q")

        empty = self.spark.createDataFrame([], f"doc_id {kinds['doc_id']}, raw double, importance double, query_id {kinds['query_id']}")
        scored = _in_blocks(q, one, empty).select("query_id", "doc_id", F.round("raw", digits).alias("similarity"), "importance")
        best = _top(scored, k, F.desc("similarity"), F.col("doc_id"))
        return best.select("query_id", "doc_id", "similarity", F.round(F.col("similarity") * (0.8 + 0.2 * F.col("importance")), digits).alias("score"), "rnk")


def _placed(at: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = (_units(b.column(1), at.shape[1]) @ at.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), *b.columns], ["list", "doc_id", "v", "importance"])

    return run


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> Lists:
    """Index ``vectors`` (doc_id, vec [, importance]) at ``path``; rows without a vector are left out.

    ``lists`` defaults to the root of the number of rows, at most a tenth of the sample.
    """
    spark = vectors.sparkSession
    imp = F.coalesce(F.col("importance"), F.lit(1.0)) if "importance" in vectors.columns else F.lit(1.0)
    d = vectors.where("vec IS NOT NULL").select("doc_id", V.doubles(F.col("vec")).alias("v"), imp.cast("double").alias("importance"))
    n = d.count()
    chosen = d.select("doc_id", "v").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    dim = max((len(r["v"]) for r in chosen), default=1)
    x = _units(pa.array([r["v"] for r in chosen] or [[0.0]], pa.list_(pa.float64())), dim)
    k = max(1, min(lists or math.isqrt(max(n, 1)), max(1, len(x) // 10)))
    at = centroids(x, k)
    probes = probes_needed(x, at)
    replace(spark.createDataFrame([(i, [float(y) for y in c], probes) for i, c in enumerate(at)], "list int, v array<double>, probes int"), f"{path}/centroids")
    rows = d.mapInArrow(_placed(at), f"list int, doc_id {dict(d.dtypes)['doc_id']}, v array<double>, importance double")
    parts = max(1, math.ceil(n / PART_ROWS))
    # rows of a list lie together, in as many parts as its size asks for
    replace(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).repartitionByRange(F.col("list"), F.col("part")).sortWithinPartitions("list", "part"), f"{path}/rows")
    return Lists(spark, path)
