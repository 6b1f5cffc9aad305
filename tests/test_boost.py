from pyspark.sql import functions as F

from tessera.operators import retrieval

LABELS = "doc_id long, ns string, code string, path array<string>"


def test_boost_counts_each_label_once(spark):
    scored = spark.createDataFrame([(1.0, 1, 10), (1.0, 1, 11), (1.0, 2, 10), (1.0, 1, None), (1.0, 3, 10), (2.0, 1, 10)], "score double, query_id long, doc_id long")
    labels = spark.createDataFrame(
        [(10, "a", "1.2", ["1", "1.2"]), (10, "a", "1.2", ["1", "1.2"]), (10, "a", "1.3", ["1", "1.3"]), (10, "b", "1.2", None), (11, "a", None, ["1"]), (11, None, "1", None), (None, "a", "1", None)], LABELS
    )
    wanted = spark.createDataFrame([(1, "a", "1"), (1, "a", "1.2"), (1, "a", "1"), (2, "b", "1.2"), (2, "b", None), (2, None, "1"), (None, "a", "1")], "query_id long, ns string, code string")
    out = retrieval.label_boost(scored, labels, wanted, factor=2.0)
    assert out.columns == ["query_id", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 10, 4.0), (1, 10, 8.0), (1, 11, 2.0), (2, 10, 2.0), (1, None, 1.0), (3, 10, 1.0)], key=str)


def test_boost_makes_no_row_for_each_query_and_label(spark, tmp_path):
    """200 queries that all want what 500 documents have, 10 scored rows: 100,000 pairs before."""
    labels = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a").alias("ns"), F.lit("1.2").alias("code"), F.array(F.lit("1"), F.lit("1.2")).alias("path"))
    wanted = spark.range(200).select(F.col("id").alias("query_id"), F.lit("a").alias("ns"), F.lit("1").alias("code"))
    scored = spark.range(10).select(F.col("id").alias("query_id"), (F.col("id") * 3).alias("doc_id"), F.lit(1.0).alias("score"))
    out = retrieval.label_boost(scored, labels, wanted)
    assert {r["score"] for r in out.collect()} == {1.05}
    spark.range(1).count()
    tracker = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway
    before = _written(spark, tracker, gateway)
    out.write.mode("overwrite").parquet(f"{tmp_path}/out")
    assert _written(spark, tracker, gateway) - before < 2_000


def _written(spark, tracker, gateway) -> int:
    """Rows that all stages so far have written to shuffles."""
    none = gateway.jvm.java.util.ArrayList
    stages = tracker.stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_repeated_ids_count_once_in_frequencies(spark):
    d = spark.createDataFrame([(1, [5, 5, 7]), (1, [5]), (2, [5, 9]), (None, [7]), (None, [7, 9])], "doc_id long, h array<long>").localCheckpoint()
    vocab = retrieval._Vocabulary([{"h": [5, 7]}, {"h": [7, 9, 11]}])
    assert dict(zip(vocab.hashes.tolist(), retrieval._frequencies(retrieval._together(d), vocab).tolist(), strict=True)) == {5: 2, 7: 2, 9: 2, 11: 0}
