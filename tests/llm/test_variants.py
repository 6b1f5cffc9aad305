"""Spelling variants against a brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import variants

from .fixtures import SCHEMA, documents, empty


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(count):
    out, form = {}, {}
    for w, n in count.items():
        of = [x for x in count if near(w, x)]
        best = min(of, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * n else None
        out[w] = (n, len(of), form[w], count[form[w]] if form[w] else None)
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def result(df):
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def word_counts(rows, change=True):
    count = Counter()
    for doc_id, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if change and doc_id is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("change", [None, variants.rare_deletions])
def test_vocabulary_of_odd_texts(spark, change):
    rng = random.Random(3)
    words = ["kitten", "kittén", "Kitten", "sitten", "mitten×", "Àgauche", "àgauche", "aaaaa", "aaaaaa", "naïveœuvre", "ſharp", "x" * 300]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), None, None, None, 1, "x", 2, 3, True) for i in range(80)]
    rows += [rows[0], (None, "kitten kitten", None, None, None, 1, "x", 2, 3, True), (7, None, None, None, None, 1, "x", 2, 3, True), (8, "", None, None, None, 1, "x", 2, 3, True)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = word_counts(rows, change is not None)
    got = variants.vocabulary(docs, change=change, held=5)
    assert {r.word: r.n for r in got.collect()} == want
    assert result(variants.grouped(spark, got)) == expected(want)


def test_all_edits_of_random_words(spark):
    rng = random.Random(11)
    count = {"".join(rng.choice("abé\U0001f600") for _ in range(rng.randrange(1, 8))): rng.randrange(1, 40) for _ in range(400)}
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    assert result(variants.grouped(spark, words)) == expected(count)
    assert result(variants.grouped(spark, words, max_bits=19)) == expected(count)


def test_a_full_map_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(variants, "_map_of", lambda words, bits: np.full(1 << (bits - 3), 255, np.uint8))
    count = {"abcde": 5, "abcd": 20, "abc": 50, "bbcde": 1, "abcdef": 2, "zzz": 9, "zzzz": 18, "zzzzz": 36}
    got = result(variants.grouped(spark, spark.createDataFrame(list(count.items()), "word string, n long")))
    assert got == expected(count)
    assert got["bbcde"][-1] == "abc"  # a chain of forms


def test_empty_and_clashing(spark):
    assert variants.grouped(spark, variants.vocabulary(empty(spark))).count() == 0
    assert variants.grouped(spark, variants.vocabulary(documents(spark), least_length=4)).columns == ["word", "n", "n_near", "form", "form_n", "root"]
