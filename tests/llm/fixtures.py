"""Small documents with everything that goes wrong: nulls, empties, copies, ties, odd characters, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp string, node int, root int, kept boolean"


def texts():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    long = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = long(300)
    words = base.split()
    near = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(5, 90, 6)]
    passage = long(60)
    return [
        None, "", " ", "\n\n \t", "one", "one two", "One TWO three.", base, base, base, *near,
        f"{long(40)} {passage} {long(40)}", f"{long(30)} {passage}", passage, f"{passage} {passage}",
        "same line here for all of us to see\n" * 12, "don't  stop now,  it's we'll   go!!  \n\n  end ", "é ü ß ñ 東京 🎉🎉 é İstanbul ΑΣ ΑΣ.",
        "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "a" * 3000, "ab " * 5000, "\x1c\x1d x\x85y\x0bz\x0cq", "# * $ % & | < > " * 20,
        long(6000), "\n".join(long(12) for _ in range(40)), "tail  ", "  head",
    ]


def rows():
    out = [(i, t, ["en", "de", None][i % 3], "src0" if i % 2 else "src1", None, 1, "x", 2, 3, True) for i, t in enumerate(texts())]
    return out + [(None, "no id at all here", None, None, None, 1, "x", 2, 3, True)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]
