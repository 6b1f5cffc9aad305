import random
from collections import Counter

from tessera.operators import documents


def _shuffled(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _expected(texts):
    words = [w.lower() for t in texts if t for w in t.split(" ") if len(w) >= 4]
    first, n = {}, Counter(words)
    for i, w in enumerate(words):
        first.setdefault(w, i)
    best = sorted(n, key=lambda w: (-n[w], first[w]))[:20]
    return [w for w in best if n[w] >= 4 and w not in documents.NOT_KEYWORDS][:10]


def test_words_are_counted_in_their_row_and_by_id(spark, tmp_path):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdж") for _ in range(rng.choice((3, 4, 5)))) for _ in range(60)] + documents.NOT_KEYWORDS + ["Abca", "ABCA"]
    text = lambda: " ".join(rng.choice(vocab[: rng.choice((5, 30, len(vocab)))]) for _ in range(rng.choice((0, 4, 40, 400))))
    rows = [(i, text()) for i in range(60)] + [(61, None), (62, ""), (63, "abcd abcd abcd"), (64, "abcd abcd abcd ABCD"), (65, "word " * 4 + "term " * 5)]
    got = {r["doc_id"]: r["keywords"] for r in documents.keywords(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: k for i, t in rows if (k := _expected([t]))} and got[65] == ["term", "word"]
    # an id of two rows is one document: three uses in one and one in the other are four
    twice = documents.keywords(spark.createDataFrame([*rows, (63, "x abcd"), (None, "null " * 2), (None, "null null")], "doc_id long, text string"))
    have = {r["doc_id"]: r["keywords"] for r in twice.collect()}
    assert have == got | {63: ["abcd"], None: ["null"]}


def test_words_are_not_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"{a}{b}{i % 7}word".translate({ord(str(d)): "qwertyuiop"[d] for d in range(10)}) for a in range(10) for b in range(10))) for i in range(50)], "doc_id long, text string")
    before = _shuffled(spark)
    documents.keywords(docs).write.parquet(f"{tmp_path}/out")
    assert _shuffled(spark) - before < 200  # 5,000 words
