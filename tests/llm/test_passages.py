"""The classifier: its gradient, its features, held-out accuracy, and texts that go wrong."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import passages, queries

from .fixtures import documents, empty, rows


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    model = passages.Model(hidden=5, gates=3)
    model.w = {k: rng.standard_normal(v.shape) * 0.3 for k, v in model.w.items()}
    x = rng.random((7, passages.WIDTH)) * 0.2
    starts, label = np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        z = model.attended(model.encoded(x), starts)[0]
        return np.mean(np.log1p(np.exp(z)) - label * z)

    g = model.gradient(x, starts, label)
    for k, v in model.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if k == "W":
                at = (at[0], at[1])
            was, step = v[at], 1e-5
            v[at] = was + step
            up = loss()
            v[at] = was - step
            down = loss()
            v[at] = was
            assert abs((up - down) / (2 * step) - g[k][at]) < 1e-5


def test_passages_cover_all_words():
    texts = [r[1] for r in rows()]
    p = passages.Passages(pa.array(texts, pa.string()))
    n = [len((t or "").encode().split()) for t in texts]
    assert np.bincount(p.of, weights=p.sizes).tolist() == n
    assert np.bincount(p.of).tolist() == [max(1, -(-k // passages.WORDS)) for k in n]
    whole = p.counts(0, len(p.of))
    assert (whole.sum(axis=1, dtype=int) == 5 * p.sizes).all()
    for t in ("One TWO three.", "a!! b!!  c"):  # a text's features don't depend on its neighbours in the batch
        alone = passages.Passages(pa.array([t]))
        both = passages.Passages(pa.array(["x", t, t]))
        assert (alone.counts(0, 1)[0] == both.counts(0, 3)[1:]).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_quality_classifier(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.95
    assert all(a for a, b in held if b)


def test_odd_rows(spark):
    docs = documents(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("label"))
    labels = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, label long"))
    model = passages.fitted(spark, docs.unionByName(docs), labels, most=20)
    got = passages.scored(spark, docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())
    again = passages.scored(spark, docs, passages.fitted(spark, docs.unionByName(docs), labels, most=20)).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in got)
    none = passages.fitted(spark, docs, labels.where("false"))
    assert {r.score for r in passages.scored(spark, docs, none).collect()} == {0.5}
    assert passages.scored(spark, empty(spark), model).count() == 0
