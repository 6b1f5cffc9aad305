"""Runs against a brute force over all periods."""

import hashlib
import random
import zlib

import numpy as np

from tessera.llm import periodic, queries

from .fixtures import documents, empty, rows


def brute(words, least=12):
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                out.setdefault((s, i - s + q), q)
    return [(s, n, q) for s, q, n in sorted((s, q, n) for (s, n), q in out.items())]


def odd_words(rng):
    n, letters = rng.choice([0, 1, 5, 11, 12, 13, 30, 60, 200]), rng.choice([1, 2, 3, 50])
    words = [rng.randrange(letters) for _ in range(n)]
    kind = rng.randrange(4)
    if kind == 1 and n:
        p = rng.randrange(1, max(2, n // 2))
        words = [words[i % p] for i in range(n)]
    elif kind == 2 and n > 20:
        p, s = rng.randrange(1, 8), rng.randrange(n // 2)
        words = [words[i] if i < s else words[s + (i - s) % p] for i in range(n)]
    elif kind == 3:
        words = (words * 3)[: 2 * n]
    return words


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(150):
        docs = [odd_words(rng) for _ in range(rng.randrange(1, 8))]
        least = rng.choice([9, 12, 20])
        named = [np.unique(np.array(w, np.int64), return_inverse=True)[1].astype(np.int64) for w in docs]
        for words, runs in zip(docs, periodic.runs_of(named, least), strict=True):
            assert [tuple(map(int, r)) for r in runs] == brute(words, least)


def test_small_chunks(monkeypatch):
    monkeypatch.setattr(periodic, "_CHUNK", 7)
    rng = random.Random(2)
    docs = [odd_words(rng) for _ in range(6)]
    named = [np.unique(np.array(w, np.int64), return_inverse=True)[1].astype(np.int64) for w in docs]
    assert [[tuple(map(int, r)) for r in x] for x in periodic.runs_of(named)] == [brute(w) for w in docs]


def words_of(text):
    return (text or "").encode().split()


def test_collapsed_texts(spark):
    got = sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.text) for r in periodic.collapsed(documents(spark)).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows():
        words = words_of(text)
        runs = brute(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((doc_id, len(words), tuple(runs), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    assert got == sorted(want, key=str)
    assert periodic.collapsed(empty(spark)).count() == 0


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, sf).collect()}
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = words_of(text)[:]
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue  # the brute force is quadratic
        runs = brute(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = 1000 * m // q if runs else None
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert got[doc_id] == (len(runs), s, m, q, milli, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
