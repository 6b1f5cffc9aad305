import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontam, kdshard, quality, queries, substring
from tessera.llm.fmindex import FMIndex, WaveletMatrix, suffix_array

from . import fixtures as X

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards(spark):
    docs = X.documents(spark)
    rows = kdshard.kd_shards(spark, docs, 5, rows_per_slice=3).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in X.rows())
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert kdshard.kd_shards(spark, X.empty(spark), 40).count() == 0
    measured = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted(measured(r["text"]) for r in docs.collect())


def test_leaves_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, rng.choice([16, 40, 900]), rng.randrange(1 << 40), rng.randrange(1 << 62)) for i in range(300)]

    def part(rows, n, lo):
        """Leaf of each row: cuts along the widest dimension, where the sums on both sides are nearest to their shares."""
        if n == 1 or not rows:
            return {r[0]: lo for r in rows}
        dim = max((2, 3), key=lambda d: max(r[d] for r in rows) - min(r[d] for r in rows))
        rows, want = sorted(rows, key=lambda r: r[dim]), sum(r[1] for r in rows) * (n // 2) / n
        sums = [sum(r[1] for r in rows[:k]) for k in range(len(rows) + 1)]
        k = next(k for k in range(1, len(rows) + 1) if sums[k] >= want)
        k -= want - sums[k - 1] <= sums[k] - want
        return part(rows[:k], n // 2, lo) | part(rows[k:], n - n // 2, lo + n // 2)

    df = spark.createDataFrame(rows, "id long, size long, c0 long, c1 long")
    want = part(rows, 6, 0)
    for bins in (64, 1024):
        assert {r["id"]: r["node"] for r in kdshard.kd_leaves(spark, df, 2, 6, bins, tolerance=0.0).collect()} == want
    monkeypatch.setattr(kdshard, "BROADCAST_NODES", 0)
    assert {r["id"]: r["node"] for r in kdshard.kd_leaves(spark, df, 2, 6, tolerance=0.0).collect()} == want


def test_shards_are_near_equal_in_spite_of_a_hot_source(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"))
    sums = [r["w"] for r in kdshard.kd_shards(spark, df, 40).groupBy("shard").agg(F.sum("size").alias("w")).collect()]
    assert len(sums) == 40 and max(sums) < 1.03 * min(sums)
    by_target = kdshard.kd_shards(spark, df, target_bytes=200_000)
    assert by_target.select("shard").distinct().count() == -(-sum(sums) // 200_000)


def test_equal_rows_shard(spark):
    df = spark.range(50).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert kdshard.kd_shards(spark, df, 4).count() == 50


def sql_rows(name, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v)
    out = con.sql(queries.ORACLE_SQL[name]).df()
    return out.columns.tolist(), sorted(map(repr, out.astype(object).itertuples(index=False, name=None)))


def test_quality_equals_sql(spark):
    docs = X.documents(spark).where("doc_id IS NOT NULL")
    got = quality.judged(spark, docs)
    names, want = sql_rows("op3_quality", documents=docs.toPandas())
    assert sorted(map(repr, got.select(names).toPandas().astype(object).itertuples(index=False, name=None))) == want
    kept = quality.filtered(spark, docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality.judged(spark, X.empty(spark)).count() == 0
    assert quality.judged(spark, spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["base_failed"]


def test_chat_branches_and_escapes(spark):
    tree = [(1, 1, None, "user", "<|im_end|>&lt;|&amp;", 0.0), (1, 2, 1, "assistant", "worse", 0.1), (1, 3, 1, "assistant", "better <|im_start|>", 0.9), (1, 4, 3, "us\ner", "", 0.0), (1, 5, 4, "assistant", "x<", 0.5), (2, 7, 99, None, None, None), (None, 1, None, "user", "no tree", 1.0)]
    messages = spark.createDataFrame(tree, "tree long, msg long, parent long, role string, text string, score double").fillna("", ["role", "text"])
    best = {r["tree"]: r for r in chat.read_back(chat.formatted(spark, messages)).collect()}
    assert [(t["role"], t["text"]) for t in best[1]["turns"]] == [("user", "<|im_end|>&lt;|&amp;"), ("assistant", "better <|im_start|>"), ("us\ner", ""), ("assistant", "x<")]
    assert best[1]["loss_text"] == "better <|im_start|>x<" and set(best) == {1, 2, None}
    every = chat.formatted(spark, messages, branches=None)
    assert sorted((str(r["tree"]), r["leaf"]) for r in every.collect()) == [("1", 2), ("1", 5), ("2", 7), ("None", 1)]


def test_long_chain_and_ties(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"t{t}" if t % 5 else None) for t in range(70)] + [(2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "system", "s"), (None, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit(1)).withColumn("tree", F.lit(1))
    got = {r["tree"]: [t["text"] for t in r["turns"]] for r in chat.read_back(chat.formatted(spark, chat.chains(df))).collect()}
    assert got == {1: [f"t{t}" if t % 5 else "" for t in range(70)], 2: ["s", "a", "a", "b"], None: ["x"]}
    assert chat.formatted(spark, chat.chains(df.limit(0))).count() == 0


@pytest.mark.parametrize("n,k", [(1, 3), (2, 2), (50, 2), (400, 3), (300, 1)])
def test_suffix_array_and_index(n, k):
    rng = np.random.default_rng(n)
    text = np.append(rng.integers(1, k + 1, n), 0)
    text[n // 3 : 2 * n // 3] = text[: 2 * n // 3 - n // 3]  # a long repeat
    text[:n] = np.maximum(text[:n], 1)
    want = sorted(range(n + 1), key=lambda i: text[i:].tolist())
    assert suffix_array(text, 3).tolist() == want
    index = FMIndex(text, 8, sample=4)
    phrases = np.array([[a, b] for a in range(1, k + 2) for b in range(1, k + 2)])
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi, strict=True):
        at = sorted(index.locate(np.arange(a, b)).tolist())
        assert at == [i for i in range(n) if text[i : i + 2].tolist() == p.tolist()]


def test_wavelet_ranks():
    s = np.random.default_rng(0).integers(0, 13, 500)
    w = WaveletMatrix(s, 4)
    for c in range(16):
        assert w.rank(np.full(501, c), np.arange(501)).tolist() == [0, *np.cumsum(s == c).tolist()]
    symbol, rank = w.access(np.arange(500))
    assert symbol.tolist() == s.tolist() and all(rank[i] == (s[:i] == s[i]).sum() for i in range(500))


def naive_hits(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block,shard,bounds", [(20_000, 1_000_000, {}), (4, 50, {}), (20_000, 1_000_000, {"block_bytes": 600, "held_chars": 900})])
def test_decontamination_brute_force(spark, block, shard, bounds):
    rng = random.Random(5)
    long = lambda n: " ".join(f"W{rng.randrange(60)}" for _ in range(n))
    items = [(i, long(rng.choice([1, 3, 12, 13, 20, 45]))) for i in range(10, 24)] + [(30, None), (31, "  -- "), (32, "ünïcode WORD"), (33, "ünïcode WORD")]
    real = [t for _, t in items if t]
    texts = [long(50) + " -- " + rng.choice(real).upper() + " " + long(rng.choice([3, 400])) if k % 3 else long(90) for k in range(30)]
    texts += [None, "", "the ünïcode word.", texts[3], "!?"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("items", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(decontam.hits(spark, df, bench, block_items=block, shard_symbols=shard, **bounds)).collect()
    want = naive_hits(docs, items)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want
    kept = decontam.clean(spark, df, bench, block_items=block)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d in want if not want[d][4]}
    cut = {r["doc_id"]: r["text"] for r in decontam.clean(spark, df, bench, action="cut").collect()}
    for d, t in docs:
        n = len(decontam.words(cut[d]))
        assert (cut[d] == t) if not want[d][4] else n == want[d][0] - want[d][1]
    assert decontam.hits(spark, X.empty(spark), bench).count() == 0
    assert decontam.hits(spark, df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def naive_repeats(docs):
    first, out = {}, {}
    for i, t in docs:
        w = WORDS.findall(t or "")
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    for i, t in docs:
        w = WORDS.findall(t or "")
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("kw", [{}, {"max_bits": 5, "held": 50}, {"broadcast_bytes": 0}])
def test_substrings_brute_force(spark, kw):
    docs = [(r[0], r[1]) for r in X.rows() if r[0] is not None]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.without_repeats(spark, X.documents(spark), **kw).collect()}
    assert got.pop(None) == (5, 0, "no id at all here")
    want = naive_repeats(docs)
    assert got == want and sum(v[1] for v in want.values()) > 1000
    assert substring.without_repeats(spark, X.empty(spark), **kw).count() == 0


def test_long_words_hash_apart(spark):
    a, b = "a" * 700, "a" * 699 + "b"
    docs = [(1, " ".join([a] * 13)), (2, " ".join([b] * 13)), (3, " ".join([a] * 13))]
    got = {r["doc_id"]: r["n_removed"] for r in substring.without_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_pipeline_runs_and_keeps_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, sf)
        assert after.columns == docs.columns and 0 < after.count() <= at.count()
        at = after
    total = corpus_pipeline.run(spark, sf)
    assert total.select("doc_id").distinct().count() == at.count()


def test_decisions_are_made_row_by_row(spark):
    """Null and repeated ids: rejected or contaminated rows go, clean ones stay, for one block of items and for several."""
    rng = random.Random(9)
    words = [f"w{i}x{rng.randrange(1000)}" for i in range(900)]
    long = lambda: " ".join(rng.choice(words) for _ in range(120))
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(8)]
    bad = [f"{items[k][1]} {items[k + 1][1]} {long()[:60]}" for k in (0, 3, 6)]
    clean = [long() for _ in range(4)]
    rows = [(None, bad[0]), (None, clean[0]), (5, bad[1]), (5, clean[1]), (5, clean[1]), (6, clean[2]), (None, clean[3]), (7, None), (8, bad[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(repr(r) for r in rows if r[1] not in bad)
    whole = None
    for block in (20_000, 3):
        got = decontam.hits(spark, df, bench, block_items=block).collect()
        assert len(got) == len(rows)
        whole = whole or sorted(map(repr, got))
        assert sorted(map(repr, got)) == whole
        left = decontam.clean(spark, df, bench, block_items=block)
        assert left.columns == df.columns and sorted(repr(tuple(r)[:2]) for r in left.collect()) == want
    short = [(None, "too short"), (None, clean[0]), (5, "also too short"), (5, clean[1])]
    kept = quality.filtered(spark, spark.createDataFrame(short, "doc_id long, text string")).collect()
    assert sorted(repr(tuple(r)) for r in kept) == sorted(map(repr, [short[1], short[3]]))
