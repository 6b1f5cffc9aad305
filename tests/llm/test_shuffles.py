"""Whole texts are shuffled where the work needs it alone, and in the same way at any size."""

import pytest

import corpus_pipeline
from tessera.llm import quality, simhash


@pytest.fixture
def no_guess(spark):
    """Nothing is broadcast because Spark thinks that it is small."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30)) if i % 3 else "too few words"
    return spark.createDataFrame([(str(i), text(i - i % 2 * (i == 5))) for i in range(60)], "doc_id string, text string")


def test_quality_rules_shuffle_no_text(spark, no_guess):
    docs = documents(spark)
    got = quality.filtered(spark, docs)
    assert "SortMergeJoin" not in plan(got) and "ShuffledHashJoin" not in plan(got)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect() if r.text != "too few words")


def test_near_dedup_shuffles_no_text_for_few_dropped_rows(spark, no_guess):
    docs = documents(spark).selectExpr("cast(doc_id AS long) AS doc_id", "text")
    got = simhash.keep_one(spark, docs, similarity=0.8)
    assert "SortMergeJoin" not in plan(got) and "ShuffledHashJoin" not in plan(got)
    ids = {r.doc_id for r in got.collect()}
    assert ids == {0} | {i for i in range(60) if i % 3} - {5}


def test_line_dedup_does_not_broadcast_what_grows_with_the_texts(spark):
    docs = spark.createDataFrame([(i, f"line {i} of its own, at some length\nthe same line in all of them") for i in range(9)], "doc_id long, text string")
    got = corpus_pipeline.line_dedup(spark, docs, "")
    assert "BroadcastHashJoin" not in plan(got) and "SortMergeJoin" in plan(got)
    assert sum("the same line" in r.text for r in got.collect()) == 1 and got.count() == 9
