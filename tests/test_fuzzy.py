"""Edit ratios and the synonym automaton against plain versions of their definitions."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import fuzzy as Z
from tessera.operators import answers, retrieval
from tessera.operators import synonyms as Y


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def plain_ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_window(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    windows = [b[max(i, 0) : max(i, 0) + len(a) + min(i, 0)] for i in range(1 - len(a), len(b))]
    return max(plain_ratio(a, w) for w in windows if w)


def plain_word(a, b):
    if not a or not b:
        return 0.0
    long, short = max(len(a), len(b)), min(len(a), len(b))
    whole = plain_ratio(a, b)
    return whole if long < 1.5 * short else max(whole, plain_window(a, b) * (0.9 if long <= 8 * short else 0.6))


def words(rng, n, most=12, letters="abcdéж"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, most))) for _ in range(n)]


def test_ten_thousand_pairs():
    rng = random.Random(1)
    a, b = words(rng, 10_000), words(rng, 10_000)
    a += ["x" * 64, "ab" * 32, "ab" * 40, "q" * 200]
    b += ["x" * 63 + "y", "ba" * 32, "ba" * 41, "q" * 20]
    assert np.allclose(Z.word_scores(a, b), [plain_word(x, y) for x, y in zip(a, b, strict=True)])


def test_longer_strings():
    rng = random.Random(2)
    for _ in range(60):
        a, b = (" ".join(words(rng, rng.randrange(0, 12), 6, "abc")).strip() for _ in range(2))
        assert Z.lcs(a, b) == lcs(a, b)
        assert abs(Z.best_window(a, b) - plain_window(a, b)) < 1e-9
        assert abs(Z.token_set(a, b) - Z.token_set(b, a)) < 1e-9
    assert Z.token_set("b a c", "a b") == 100 and Z.token_set("", "a") == 0 and Z.window_token_set("a x", "x b") == 100
    assert Z.token_set("new york mets", "york new giants") == max(plain_ratio("new york", "new york giants"), plain_ratio("new york", "new york mets"), plain_ratio("new york mets", "new york giants"))


def test_overlap(spark):
    rows = [(["маркировки", "накладная"], ["моркировки", "другое"]), (["abc", "abcd"], ["abd", "abcx"]), ([], ["abc"]), (None, ["abc"]), (["abcdef"], None), (["typeahead"], ["type"])]
    df = spark.createDataFrame(rows, "q array<string>, d array<string>")
    want = []
    for q, d in rows:
        hits = sum(t in (d or []) or (len(t) >= 4 and any(plain_word(t, x) >= Z.least_score(len(t)) for x in d or [])) for t in q or [])
        want.append(hits / max(1, len(q or [])))
    assert [r.o for r in df.select(Z.overlap(F.col("q"), F.col("d")).alias("o")).collect()] == want
    assert want[0] == 0.5


def test_typos_and_grounding_by_ratio(spark):
    vocab = spark.createDataFrame([("маркировки",), ("накладная",), ("склад",)], "word string")
    queries = spark.createDataFrame([(1, "моркировки накладнная 12345"), (2, "совсем другое")], "query_id long, text string")
    got = {r.query_id: r.text for r in retrieval.typos_fixed(queries, vocab, by_ratio=True).collect()}
    assert got == {1: "маркировки накладная 12345", 2: "совсем другое"}
    a = spark.createDataFrame([(1, "Delivery notes are printed by every warehouse clerk.")], "query_id long, answer string")
    h = spark.createDataFrame([(1, 1, "clerk cards lie elsewhere; nothing else is said")], "query_id long, rnk int, text string")
    assert answers.grounding(a, h).first().grounding == 0.0
    assert answers.grounding(a, h, fuzzy=True).first().grounding == (1.0 if Z.window_token_set("delivery notes are printed by every warehouse clerk.", "clerk cards lie elsewhere; nothing else is said") >= 80 else 0.0)


def test_automaton_finds_what_patterns_find():
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("ab -") for _ in range(rng.randrange(1, 6))).strip() + rng.choice(["", "*"]) for _ in range(150)} - {"", "*"})
    automaton = Y.Automaton(keys)
    for _ in range(200):
        text = "".join(rng.choice("aab b-é_") for _ in range(40))
        want = {}
        for i, k in enumerate(keys):
            pattern = rf"(?<!\w){re.escape(k[:-1])}\w*" if k.endswith("*") else rf"(?<!\w){re.escape(k)}(?!\w)"
            if m := [x.span() for x in re.finditer(pattern, text)]:
                want[i] = m
                assert Y.replaced(text, m, "<>") == re.sub(pattern, "<>", text)
        assert automaton.found(text) == want


def test_large_dictionaries_take_the_join(spark, monkeypatch):
    assert len(Y.SYNONYMS) >= 100
    queries = spark.createDataFrame([(1, "Счет на оплату поставщика"), (2, "как создать заявку"), (3, None)], "query_id long, text string")
    rows = lambda: sorted((r.query_id, r.variant, r.text) for r in retrieval.expanded(queries, Y.table(spark), 9).collect())
    found = rows()
    assert (2, 1, "как создать заявку") in found and any("заказ" in t for q, _, t in found if q == 2)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 3)
    assert rows() == found
