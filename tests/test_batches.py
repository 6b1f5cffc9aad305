"""Python steps take texts in bounded batches, however large a partition is."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, retrieval
from tessera.sources import files

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("step", ["chunks", "pages", "lexical", "trigram", "vector"])
def test_batches_are_bounded(spark, monkeypatch, step):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, "10000")
    try:
        d = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.array(F.lit(1.0)).alias("vec"))
        q = d.select(F.col("doc_id").alias("query_id"), "text", "vec")
        {
            "chunks": lambda: chunking.chunks(d),
            "pages": lambda: files.pages_text(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))),
            "lexical": lambda: retrieval.lexical(q, d),
            "trigram": lambda: retrieval.trigram(q, d),
            "vector": lambda: retrieval.vector(q, d),
        }[step]()
        assert int(spark.conf.get(KEY)) <= 512
    finally:
        spark.conf.set(KEY, before)
