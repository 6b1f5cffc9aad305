"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages (64 words each) with one label. Each passage is encoded by a
hidden layer over hashed counts of its words, their shapes, pairs of shapes and repetitions. Gated
attention, softmax(w . (tanh(V h) * sigmoid(U h))) over a document's passages, weighs the encodings,
and a logistic unit scores their weighted sum. All weights are learnt together from document labels
(Adam, written out in numpy).

It is fitted in one task on a bounded sample: ``most`` labelled documents (those of the least hash of
their id), ``most_passages`` passages of each, spread evenly. The fitted weights are a table, so a lost
executor never meets another model. Scores take every passage of every document, without a shuffle.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, small_batches
from .windows import SPACE, Polynomial, mix, slices, texts

WORDS = 64  # words of a passage: a count fits a byte
SHAPE, PAIR, WORD, EXTRA = 384, 256, 256, 64
WIDTH = SHAPE + PAIR + WORD + EXTRA
_U = np.uint64

#: Classes of bytes: letters by case (bytes of other scripts as small ones), digits, and each other sign as itself.
_CLASS = np.array([ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)], np.uint8)


class Passages:
    """Passages of a batch: ``of`` is each one's row, ``counts(lo, hi)`` their features; a row without words has one empty passage."""

    def __init__(self, column: pa.Array):
        data, starts = texts(column)
        word = ~SPACE[data]
        change = np.zeros(len(data) + 1, np.int8)
        change[:-1] = word
        change[1:] -= word
        edge = starts[(starts > 0) & (starts < len(data))]  # words of two texts don't run together
        joint = edge[(word[edge] & word[edge - 1])] if len(edge) else edge
        self.first = np.union1d(np.flatnonzero(change == 1), joint)
        self.last = np.union1d(np.flatnonzero(change == -1), joint)
        per = np.diff(np.searchsorted(self.first, starts))
        pages = np.maximum(-(-per // WORDS), 1)
        self.of = np.repeat(np.arange(len(per)), pages)
        page_starts = np.cumsum(pages) - pages
        n = len(self.first)
        row = np.repeat(np.arange(len(per)), per)
        self.page = page_starts[row] + (np.arange(n) - np.repeat(np.cumsum(per) - per, per)) // WORDS
        self.sizes = np.bincount(self.page, minlength=len(self.of))
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self._features(data)

    def _features(self, data: np.ndarray) -> None:
        n = len(self.first)
        self.features = np.zeros((5, n), np.int16)
        if not n:
            return
        kind = _CLASS[data]
        new = np.ones(len(data), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[self.first] = True
        at = np.cumsum(new)
        shape = Polynomial(11)(kind[new], at[self.first] - 1, at[self.last - 1])
        word = Polynomial(12)(data, self.first, self.last)
        before = np.zeros(n, bool)  # whether the word before is in the same passage
        before[1:] = self.page[1:] == self.page[:-1]
        pair = shape.copy()
        pair[1:] ^= np.where(before[1:], shape[:-1] * _U(0x9E3779B97F4A7C15), _U(0))
        same = np.zeros(n, bool)
        same[1:] = before[1:] & (word[1:] == word[:-1])
        f = self.features
        f[0] = shape % _U(SHAPE)
        f[1] = SHAPE + (mix(pair) % _U(PAIR)).astype(np.int16)
        f[2] = SHAPE + PAIR + (word % _U(WORD)).astype(np.int16)
        f[3] = SHAPE + PAIR + WORD + np.minimum(self.last - self.first, 31)
        f[4] = SHAPE + PAIR + WORD + 32 + same

    def counts(self, lo: int, hi: int) -> np.ndarray:
        """(hi - lo, WIDTH) counts of passages lo to hi."""
        a, b = self.bounds[lo], self.bounds[hi]
        cell = ((self.page[a:b] - lo) * WIDTH + self.features[:, a:b]).ravel()
        return np.bincount(cell, minlength=(hi - lo) * WIDTH).reshape(hi - lo, WIDTH).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """Encoder, gated attention and scorer; ``w`` holds the weights by name."""

    def __init__(self, hidden: int = 32, gates: int = 16, seed: int = 42):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        zero = lambda *n: np.zeros(n, np.float32)
        self.w = {"W": draw(WIDTH, hidden), "b": zero(hidden), "V": draw(hidden, gates), "U": draw(hidden, gates), "a": zero(gates), "c": zero(hidden), "d": zero(1)}

    @staticmethod
    def inputs(counts: np.ndarray) -> np.ndarray:
        """Roots of shares: rare signs weigh more than in proportion; a passage's length doesn't count."""
        words = np.maximum(counts[:, :SHAPE].sum(axis=1, dtype=np.float32), 1)
        return np.sqrt(counts.astype(np.float32) / words[:, None])

    def encoded(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w["W"] + self.w["b"])

    def attended(self, h: np.ndarray, starts: np.ndarray):
        """For bags of passages that begin at ``starts``: (scores before the sigmoid, and what the gradient needs)."""
        w = self.w
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["a"]
        sizes = np.diff(np.append(starts, len(h)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        share = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(share[:, None] * h, starts, axis=0)
        return z @ w["c"] + w["d"][0], t, s, share, z, sizes

    def gradient(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w, h = self.w, self.encoded(x)
        score, t, s, share, z, sizes = self.attended(h, starts)
        off = ((_sigmoid(score) - label) / len(label)).astype(np.float32)
        each = np.repeat(off, sizes)
        toward = h @ w["c"]  # what a passage says of the score
        de = each * share * (toward - np.repeat(z @ w["c"], sizes))
        dg = de[:, None] * w["a"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (each * share)[:, None] * w["c"] + dt @ w["V"].T + ds @ w["U"].T
        dx = dh * (1 - h * h)
        return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ off, "d": off.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 12, least_steps: int = 600, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 42) -> None:
        """``bags``: counts of each document's passages. Adam with a rate that falls to zero; more epochs where they would be under ``least_steps``."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        batches = -(-len(bags) // batch)
        epochs = max(epochs, -(-least_steps // batches))
        step, steps = 0, epochs * batches
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(bags), batch):
                pick = order[at : at + batch]
                sizes = np.array([len(bags[i]) for i in pick])
                g = self.gradient(self.inputs(np.concatenate([bags[i] for i in pick])), np.cumsum(sizes) - sizes, labels[pick])
                step += 1
                lr = rate * (1 - (step - 1) / steps)
                for k, v in self.w.items():
                    d = g[k] + decay * v
                    first[k] += 0.1 * (d - first[k])
                    second[k] += 0.001 * (d * d - second[k])
                    v -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def scores(self, p: Passages, room: int = 4096) -> np.ndarray:
        """A score from 0 to 1 for each row; ``room`` passages' features in memory at a time."""
        h = np.concatenate([self.encoded(self.inputs(p.counts(lo, min(lo + room, len(p.of))))) for lo in range(0, len(p.of), room)])
        return _sigmoid(self.attended(h, np.flatnonzero(np.diff(p.of, prepend=-1)))[0].astype(np.float64))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, b: bytes) -> Model:
        new = cls()
        new.w = dict(np.load(io.BytesIO(b)))
        return new


def _bags(most_passages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 3):
                p = Passages(part.column(3))
                edges = np.flatnonzero(np.diff(p.of, prepend=-1, append=-2))
                out = []
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    pick = np.unique(np.linspace(lo, hi - 1, min(hi - lo, most_passages)).round().astype(int))
                    out.append(np.concatenate([p.counts(i, i + 1) for i in pick]).tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.binary())], ["id", "label", "of_text", "bag"])

    return run


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
    model = Model()
    if rows:
        model.fit([np.frombuffer(bag, np.uint8).reshape(-1, WIDTH) for _, _, bag in rows], np.array([y for _, y, _ in rows], np.float32))
    yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], ["model"])


def fitted(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", most: int = 6000, most_passages: int = 32) -> Model:
    """A model of ``labels`` (``id_col``, ``label_col`` 0 or 1), learnt from at most ``most`` documents.

    Null ids and labels are left out; an id with several labels takes their mean, one with several
    documents the text of the least hash. Without any labels every score is 0.5.
    """
    small_batches(spark)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    chosen = Table(spark, chosen.orderBy(F.xxhash64("id"), "id").limit(most), "labelled").df  # at most ``most`` rows of two numbers
    rows = docs.select(F.col(id_col).cast("long").alias("of"), F.col(text_col).cast("string").alias("text"))
    sample = rows.join(F.broadcast(chosen), F.col("of") == F.col("id")).select("id", "label", F.xxhash64("text").alias("of_text"), "text")
    bags = sample.mapInArrow(_bags(most_passages), "id long, label double, of_text long, bag binary")
    bags = bags.groupBy("id", "label").agg(F.min(F.struct("of_text", "bag")).alias("one")).select("id", "label", "one.bag")
    model = Table(spark, bags.repartition(1).mapInArrow(_fitted, "model binary"), "model")
    return Model.from_bytes(bytes(model.df.first()["model"]))


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.from_bytes(shared.value)
        for b in batches:
            for part in slices(b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(Passages(part.column(1))), pa.float64())], ["doc_id", "score"])

    return run


def scored(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: 0 to 1, higher where label 1 is likelier. Null and empty texts are one
    empty passage; ids may be null or repeated. No shuffle; about ten bytes of memory a byte of a text over 1 MB."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model.to_bytes())  # about 150 KB, whatever the data
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scores(shared), "doc_id long, score double")
