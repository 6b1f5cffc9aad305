import random

from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import linededup, queries

from . import fixtures as X



def test_large_buckets_link_all_their_similar_lines(spark):
    """Every line is in one bucket; hashes order the keys, so similar lines are rarely its ends."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    lines = []
    for _ in range(60):
        base = [word() for _ in range(20)]
        lines += [" ".join(base), " ".join([*base[:9], word(), *base[10:]])]
    table = spark.createDataFrame(list(enumerate(lines)), "id int, line string").select("id", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    keyed = table.withColumn("bands", F.array(F.lit(7).cast("long")))
    at = {r["h1"]: r["id"] for r in table.collect()}
    root = {}
    for r in linededup.linked(spark, table, keyed).collect():
        root.setdefault(r["root"], []).append(at[r["node"]])
    assert sorted(map(sorted, root.values())) == [[i, i + 1] for i in range(0, len(lines), 2)]


def test_copies_do_not_make_a_bucket_large(spark):
    rows = [(1, [5])] * 20 + [(2, [5]), (3, [5]), (4, [5])]
    keyed = spark.createDataFrame(rows, "h1 long, bands array<long>")
    pairs, many = linededup.candidates(spark, keyed)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(a, b) for a in range(1, 5) for b in range(a + 1, 5)}
    assert many.count() == 0


def grams(line, w=9):
    return {line[i : i + w] for i in range(max(1, len(line) - w + 1))}


def test_query_takes_shingles_at_every_character(spark, tmp_path):
    """One edit in lines without spaces and in short lines, against brute force; the stage keeps the same lines."""
    rng = random.Random(4)
    name = lambda n, of="abcdefghij0123456789{}:,|": "".join(rng.choice(of) for _ in range(n))
    lines = ["abc", "123456789", "1234567890", "né" * 60, "🎉" * 12 + "b", "東京都の天気は晴れです。明日も晴れです"]
    for k in range(14):
        base = name(150) if k % 2 else " ".join(name(6, "abcdefghij") for _ in range(16))
        at = rng.randrange(20, 80)
        lines += [base, base[:at] + "X" + base[at:]]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", F.size(linededup.shingles(F.col("line"))).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: len(grams(x)) for i, x in enumerate(lines)}
    docs = [(i, "\n".join(lines[i::5])) for i in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    flat = [(i, k, x) for i, t in docs for k, x in enumerate(t.split("\n"))]
    sets = [grams(x[2]) for x in flat]
    root = X.components(len(flat), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    want = {x[:2]: (flat[root[i]][:2], root[i] == i) for i, x in enumerate(flat)}
    found = queries.op8_line_dedup(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["line_no"]): ((r["keep_doc_id"], r["keep_line_no"]), r["kept"]) for r in found} == want
    assert sum(k for _, k in want.values()) <= len(lines) - 14
    left = corpus_pipeline.line_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sum(len(r["text"].split("\n")) for r in left) == sum(k for _, k in want.values())


def test_recall_on_whole_table(spark, capsys):
    """All pairs of distinct lines at 0.8 or more by full shingle sets (exact prefix filter, rare shingles first)."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    lines = sorted({x for r in docs for x in (r["text"] or "").split("\n") if x.strip(" \t\x0b\x0c\r")})
    sets = [grams(x) for x in lines]
    often = {}
    for s in sets:
        for g in s:
            often[g] = often.get(g, 0) + 1
    at, truth = {}, []
    for i, s in enumerate(sets):
        seen = set()
        for g in sorted(s, key=lambda g: (often[g], g))[: len(s) - -(-8 * len(s) // 10) + 1]:
            seen.update(at.get(g, ()))
            at.setdefault(g, []).append(i)
        truth += [(i, j) for j in seen if 10 * len(s & sets[j]) >= 8 * len(s | sets[j])]
    first = {}
    for r in docs:
        for k, x in enumerate((r["text"] or "").split("\n")):
            first.setdefault(x, (r["doc_id"], k))
    keep = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in queries.op8_line_dedup(spark, sf).collect()}
    found = sum(keep[first[lines[i]]] == keep[first[lines[j]]] for i, j in truth)
    with capsys.disabled():
        print(f"\nline dedup on sf0.01: {found} of {len(truth)} pairs share a component")
    assert truth and found >= 0.98 * len(truth)


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    """A bucket of 60 lines, in pairs that its ends don't connect, and that longer bands don't find."""
    from tessera.llm.common import Table

    rng = random.Random(4)
    lines = []
    for _ in range(30):
        x = "".join(rng.choices("abcdefghij", k=80))
        lines += [x, x + "!"]
    monkeypatch.setattr(linededup, "longer_bands", lambda line: F.array(F.xxhash64(line)))
    monkeypatch.setattr(linededup, "PART", 7)
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    keyed = Table(spark, df.select(F.xxhash64("line").alias("h1"), F.array(F.lit(1).cast("long")).alias("bands")), "keyed").df
    of = {r.node: r.root for r in linededup.linked(spark, df, keyed).collect()}
    h = [r.h for r in df.select(F.xxhash64("line").alias("h")).collect()]
    assert len(of) == 60 and all(of[a] == of[b] for a, b in zip(h[::2], h[1::2])) and len(set(of.values())) == 30


def test_parities_rule_out_what_cannot_reach_and_lose_nothing(spark):
    """Pairs of long lines at 0.6 go before texts are fetched (a map of 256 bits was full at that length); those at 0.8 or more stay."""
    rng = random.Random(5)
    name = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for share in (0.6, 0.8, 0.9):
        for _ in range(20):
            same, own = name(8 + round(400 * share)), round(200 * (1 - share))
            rows.append((same + name(own), name(own) + same))
        rows.append(("x" * 300, "x" * 300 + "y"))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", linededup._possible(linededup.sketch(F.col("a")), linededup.sketch(F.col("b")), 0.8).alias("may")).collect()
    alike = lambda r: len(grams(r.a) & grams(r.b)) / len(grams(r.a) | grams(r.b))
    assert all(r.may for r in got if alike(r) >= 0.8) and sum(alike(r) >= 0.8 for r in got) >= 20
    low = [r.may for r in got if 0.55 < alike(r) < 0.65]
    assert len(low) == 20 and sum(low) <= 2


def test_a_pair_of_several_large_buckets_is_made_once(spark, monkeypatch):
    """Forty lines that share three buckets, and sketches that allow every pair."""
    from tessera.llm.common import Table

    rng = random.Random(6)
    lines = ["".join(rng.choices("abcdefghij", k=80)) for _ in range(40)]
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("h1", F.xxhash64("line"))
    many = Table(spark, df.select(F.explode(F.array(*[F.lit(i).cast("long") for i in (3, 4, 5)])).alias("band"), "h1"), "many").df
    none = spark.createDataFrame([], "node long, root long")
    monkeypatch.setattr(linededup, "sketch", lambda line, size=0: F.array(F.lit(90).cast("long"), *[F.lit(0).cast("long")] * (linededup.WIDE_MAP // 64)))
    seen = []
    monkeypatch.setattr(DataFrame, "distinct", lambda df: df)  # nothing is merged after the join
    monkeypatch.setattr(linededup, "_verified", lambda spark, pairs, *a: seen.append(pairs) or pairs)
    linededup._rest(spark, many, none, df.select("h1", "line"), 0.8)
    found = [(r.a, r.b) for r in seen[0].collect()]
    assert len(found) == len(set(found)) == 40 * 39 // 2


def test_lines_without_partners_are_not_gathered(spark):
    """Their own place is their result: no shuffle brings it to them, whatever Spark thinks of the tables' sizes."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        docs = spark.createDataFrame([(i, f"line {i} of its own and at some length\nthe same in all") for i in range(9)], "doc_id long, text string")
        got = linededup.judged(spark, docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hash" not in plan
        rows = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no, r.kept) for r in got.collect()}
        assert rows[5, 1] == (0, 1, False) and rows[0, 1] == (0, 1, True) and len(rows) == 18
    finally:
        spark.conf.set(key, before)
