"""Vectors of chunks are made where they are needed, and all chunks meet only small tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import context, retrieval
from tessera.plans import search


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


def chunks(spark):
    texts = ["замена картриджа плоттера", "Ремонт плоттера и замена ножа. Нож меняют так.", "отпуск сотрудника", "İ ſ \u212a\u2003x x x", None, " "]
    c = spark.createDataFrame([(i, t, i // 2) for i, t in enumerate(texts * 3)], "id long, text string, parent_group long")
    return c.withColumns({"section": F.lit("Раздел"), "book": F.lit("b"), "page": F.lit(1), "importance_score": F.lit(1.0), "is_parent": F.lit(False), "child_index": F.col("id"), "parent_title": F.lit("T")})


def questions(spark):
    return spark.createDataFrame([(1, "замена картриджа"), (2, "отпуск"), (3, "")], "query_id int, text string")


def test_search_makes_the_vectors_that_chunks_lack(spark):
    c, q, embed = chunks(spark), questions(spark), search.embedder()
    rows = lambda c: search.search(q, c, embed, top_k=5, min_score=0.0, context_window=1).orderBy("query_id", "rnk").collect()
    want = rows(c.withColumn("emb", embed(F.concat(F.lit("passage: "), "text"))))
    assert rows(c) == want and len(want) > 5


def test_vectors_are_those_of_one_text_at_a_time(monkeypatch):
    def one(t, dim):
        v = np.zeros(dim, np.float32)
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1 if h >> 63 else -1
        n = float(np.linalg.norm(v))
        return v / n if n else v

    texts = ["a b a c", None, "", " \n", "İ ſ \u212a x", "w " * 5000, *[f"word{i} of {i % 7}" for i in range(40)]]
    places = V._Places(16, most=9)  # forgets
    monkeypatch.setattr(V, "_places", lambda dim: places)
    assert (V.hashed_terms(texts, 16) == np.array([one(t, 16) for t in texts])).all() and len(places) <= 9


def test_all_chunks_meet_the_listed_ids_alone(spark, no_guess, monkeypatch):
    plans, real = {}, search.written
    monkeypatch.setattr(search, "written", lambda df, name: (plans.setdefault(name, plan(df)), real(df, name))[1])
    search.search(questions(spark), chunks(spark), top_k=3, expand=False)
    assert "BroadcastHashJoin" in plans["candidates"] and "LeftSemi" in plans["candidates"]


def test_widening_shuffles_no_chunk_for_few_hits(spark, no_guess, monkeypatch):
    plans, real = {}, context.written
    monkeypatch.setattr(context, "written", lambda df, name: (plans.setdefault(name, plan(df)), real(df, name))[1])
    hits = spark.createDataFrame([(1, 1, 0), (1, 2, 7)], "query_id int, rnk int, id long")
    assert context.widened(hits, chunks(spark)).count() == 2
    assert "SortMergeJoin" not in plans["groups"] + plans["near-chunks"]


def test_vectors_made_within_the_pass_give_the_same_list(spark):
    c, embed = chunks(spark), search.embedder()
    q = questions(spark).select("query_id", embed("text").alias("vec"))
    d = c.select(F.col("id").alias("doc_id"), "text")
    want = retrieval.vector(q, d.select("doc_id", embed("text").alias("vec")), 4).orderBy("query_id", "rnk").collect()
    assert retrieval.vector(q, d.select("doc_id", F.coalesce("text", F.lit("")).alias("vec")), 4, made=embed.rows).orderBy("query_id", "rnk").collect() == want and len(want) == 12
