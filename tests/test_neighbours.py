"""The vector index: recall against the exact search, exact when all lists are read, odd rows."""

import random

from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import neighbours, retrieval
from tessera.sources.tables import load

SF = "/root/testdata/sf0.01"


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


def test_recall_of_the_query(spark):
    got, true = pairs(catalog.QUERIES["indexed_neighbours"](spark, SF)), pairs(catalog.QUERIES["vector_topk"](spark, SF))
    assert len(got) == len(true) and len(got & true) >= 0.9 * len(true)


def test_all_lists_are_exact(spark, tmp_path):
    e = load(spark, SF, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), (1 + F.col("label") % 2).cast("double").alias("importance"))
    q = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vec")
    lists = neighbours.build(e, str(tmp_path / "lists"), lists=13)
    row = lambda df: sorted((r.query_id, r.rnk, r.doc_id, r.similarity, r.score) for r in df.collect())
    assert row(lists.nearest(q, 10, probes=13)) == row(retrieval.vector(q, e, 10))
    assert spark.read.parquet(str(tmp_path / "lists/rows")).count() == e.count()


def test_clusters_need_few_lists(spark, tmp_path):
    rng = random.Random(3)
    center = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in center[i % 20]]) for i in range(1000)]
    rows += [(2000, None), (2001, [float("nan")] * 16), (2002, [])]
    e = spark.createDataFrame(rows, "doc_id long, vec array<double>")
    lists = neighbours.build(e, str(tmp_path / "lists"), lists=20)
    assert lists.probes <= 3
    q = e.where("doc_id % 50 = 0 AND doc_id < 1000").withColumnRenamed("doc_id", "query_id")
    true = pairs(retrieval.vector(q, e, 10))
    assert len(pairs(lists.nearest(q, 10)) & true) >= 0.9 * len(true)
    empty = neighbours.build(e.limit(0), str(tmp_path / "none"))
    assert empty.nearest(q, 10).count() == 0
