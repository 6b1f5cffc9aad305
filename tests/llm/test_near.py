import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import linededup, simhash
from tessera.llm.components import components

from . import fixtures as X

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def test_components_against_union_find(spark):
    rng = random.Random(1)
    n = 300
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(220)} | {(i, i + 1) for i in range(250, 299)}
    want = X.components(n, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    edges = spark.createDataFrame([*pairs, (5, None)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(spark, edges).df.collect()}
    assert got == {i: want[i] for p in pairs for i in p}
    assert components(spark, edges.limit(0)).df.count() == 0


def test_covering_masks_meet_within_radius():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            d = (1 << i) | (1 << j)
            assert any((m & ((1 << 64) - 1)) & d == 0 for m in masks)


@pytest.mark.parametrize("small", [1, 24])
def test_links_join_what_all_pairs_join(spark, small):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for s in seeds for _ in range(40)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    u = [x & ((1 << 64) - 1) for x in fps]
    want = X.components(len(u), lambda a, b: (u[a] ^ u[b]).bit_count() <= 2)
    df = simhash.links(spark, spark.createDataFrame([(x,) for x in fps], "fp long"), small=small)
    got = {frozenset((r["a"], r["b"])) for r in df.collect()}
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in map(tuple, got))
    at = {x: i for i, x in enumerate(fps)}
    linked = {frozenset((at[a], at[b])) for a, b in map(tuple, got)}
    assert X.components(len(u), lambda a, b: frozenset((a, b)) in linked) == want


def test_near_duplicates_brute_force(spark):
    docs = X.documents(spark)
    got = {r["doc_id"]: (r["fp"] & ((1 << 64) - 1), r["component_id"]) for r in simhash.near_duplicates(spark, docs).collect()}
    rows = [(r[0], naive_fingerprint(r[1])) for r in X.rows() if r[0] is not None]
    root = X.components(len(rows), lambda a, b: (rows[a][1] ^ rows[b][1]).bit_count() <= 2)
    assert {k: v for k, v in got.items() if k is not None} == {rows[i][0]: (rows[i][1], rows[root[i]][0]) for i in range(len(rows))}
    assert None in got
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {rows[i][0] for i in set(root)} | {None}
    assert simhash.near_duplicates(spark, X.empty(spark)).count() == 0


def grams(line, w=9):
    """Nine characters at every character; a shorter line is one."""
    return {line[i : i + w] for i in range(max(1, len(line) - w + 1))}


def test_shingles_are_those_of_the_whole_line(spark):
    lines = ["", "abc", "123456789", "1234567890", "né" * 200, "x" * 1000, "".join(chr(65 + i % 57) for i in range(137)), "y" * 127 + "z" * 20, "東京都の天気は晴れです。明日も晴れです", " two  spaces and a-long-hyphenated-word "]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = df.select("i", F.size(linededup.shingles(F.col("line"))).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: len(grams(x)) if x else 0 for i, x in enumerate(lines)}


def test_lines_brute_force(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(18)) for _ in range(25)]
    edit = lambda x: " ".join(w if rng.random() > 0.04 else "changed" for w in x.split())
    docs = []
    for i in range(40):
        docs.append((i, "\n".join([edit(rng.choice(base)) for _ in range(4)] + ["", "short", " ".join(rng.choice(vocab) for _ in range(15))])))
    docs += [(40, None), (41, ""), (42, "\n\n"), (None, base[0]), (43, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("line", F.lit(2))
    flat = [(i, k, x) for i, t in docs if i is not None and t for k, x in enumerate(t.split("\n")) if x.strip()]
    flat.sort()
    sets = [grams(x[2]) for x in flat]
    root = X.components(len(flat), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {(r["doc_id"], r["line_no"]): ((r["keep_doc_id"], r["keep_line_no"]), r["kept"]) for r in linededup.judged(spark, df).collect()}
    assert set(got) == {x[:2] for x in flat}
    want = {x[:2]: (flat[root[i]][:2], root[i] == i) for i, x in enumerate(flat)}
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)  # bands reach 0.99 of pairs at the threshold itself
    out = linededup.without_lines(spark, df)
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 43 not in texts and texts[40] is None and texts[41] == "" and texts[42] == "\n\n" and texts[None] == base[0]
    for i, t in docs:
        if i in texts and t:
            assert i is None or texts[i].split("\n") == [x for k, x in enumerate(t.split("\n")) if (i, k) not in got or got[i, k][1]]
    assert linededup.judged(spark, df.limit(0)).count() == 0
