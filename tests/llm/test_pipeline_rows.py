"""All stages of the pipeline over nulls, repeated ids, repeated rows and clashing columns; near dedup's work on hard buckets."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import kdshard, neardup, simhash

from . import fixtures as X


def words(rng, n, vocab=4000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(9)
    text = {k: words(rng, 40) + "\n" + words(rng, 40) for k in "abcdef"}
    rows = [(3, text["a"]), (5, text["a"]), (5, text["b"]), (5, text["c"] + "\n" + text["a"].split("\n")[0]), (6, text["d"]), (6, text["d"]), (None, text["e"]), (None, text["e"]), (8, None), (9, "")]
    return text, spark.createDataFrame([(i, t, "en", "s", None, 1, "x", 2, 3, True) for i, t in rows], X.SCHEMA)


def test_near_dedup_row_by_row(spark, odd):
    text, docs = odd
    for similarity in (None, 0.8):
        got = simhash.keep_one(spark, docs, similarity=similarity)
        assert got.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in got.collect()]
        assert rows.count((3, text["a"])) == 1 and rows.count((5, text["a"])) == 0  # the smaller id stays
        assert rows.count((5, text["b"])) == 1  # another text of the same id does too
        assert rows.count((6, text["d"])) == 1  # equal rows: one
        assert rows.count((None, text["e"])) == 2  # no place in the order of ids
        assert rows.count((8, None)) + rows.count((9, "")) == 1  # both have no words
        assert simhash.keep_one(spark, docs.limit(0), similarity=similarity).count() == 0


def test_line_dedup_row_by_row(spark, odd):
    text, docs = odd
    got = corpus_pipeline.line_dedup(spark, docs, "")
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert (3, text["a"]) in rows and (5, text["a"]) not in rows
    assert (5, text["b"]) in rows  # its lines repeat nothing, whatever other rows of its id do
    assert (5, text["c"]) in rows
    assert rows.count((6, text["d"])) == 2  # rows equal in id and text are one document
    assert rows.count((None, text["e"])) == 2 and (8, None) in rows and (9, "") in rows


@pytest.mark.parametrize("of", ["odd", "empty", "fixtures"])
def test_all_stages(spark, odd, of):
    docs = {"odd": odd[1], "empty": X.empty(spark), "fixtures": X.documents(spark)}[of]
    columns = docs.columns
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), X.SCHEMA)
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def verified(spark, docs, monkeypatch):
    """Compared pairs beside the linear ones."""
    seen, real = {}, neardup._verified

    def counting(spark, pairs, of, threshold, name):
        seen[name] = pairs.distinct().count()
        return real(spark, pairs, of, threshold, name)

    monkeypatch.setattr(neardup, "_verified", counting)
    found = neardup.near_duplicates(spark, docs).collect()
    return seen, found


def test_a_common_passage_makes_no_square(spark, monkeypatch):
    """Documents of a passage of 60 words and 8 own words are below 0.8 of each other."""
    rng = random.Random(1)
    common = words(rng, 60, 10**6)
    for n in (300, 900):
        docs = spark.createDataFrame([(i, common + " " + " ".join(f"u{i}x{k}" for k in range(8))) for i in range(n)], "doc_id long, text string")
        seen, found = verified(spark, docs, monkeypatch)
        assert all(r.doc_id == r.component_id for r in found)
        assert seen["rest"] <= n, seen


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Sets of a few passages of a small stock, with near copies: against a brute force."""
    rng = random.Random(4)
    stock = [words(rng, 14) for _ in range(12)]
    texts = [" ".join(rng.choice(stock) for _ in range(5)) for _ in range(150)]
    for t in texts[:40]:
        w = t.split()
        w[rng.randrange(len(w))] = "odd"
        texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = X.components(len(texts), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    monkeypatch.setattr(neardup, "CROWD", 4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_equal_rows_share_the_bytes(spark):
    docs = spark.createDataFrame([(1, "x" * 84)] * 400, "doc_id long, text string")
    sizes = [r.w for r in kdshard.kd_shards(spark, docs, 8).groupBy("shard").agg(F.sum("size").alias("w")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.05 * sum(sizes) / 8
