"""Shorter passes over characters give what the steps one by one gave."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval

ODD = [
    None, "", " ", "A\tb  c\n\n\n\n\nd", "Ёлка ёлка ёж", "café  x​y﻿z­!", "K Kİ Ａ ẞß", "x \r\n y\r z \t\n w", "a\u001cb\u0085c\u000bd",
    "Стр. 5 из 7 text", "страница 3", "ᲃᲄр 8", "сло-\n во и дефис", "word-\nword", "_" * 12 + "-" * 11 + "стр 2" + "_" * 9, "стр __________ 4", "a\nb\nc\n\n«q»\n“r”\n\"s\"", "para\n\npara\n\n" + "z" * 210 + "\n\n" + "z" * 210,
    "​​Str​ 1", "\t\t \n\t x", "퟿a\U0001f600b ́c", "é" * 3 + " _x_ 1-2", "İı",
]


def _normalize(x):
    low = F.translate(F.lower(x), "ё", "е")
    spaces, gone = "".join(map(chr, T.EXOTIC_SPACES)), "".join(map(chr, T.INVISIBLES))
    return F.trim(F.regexp_replace(F.translate(T.unaccent(low), spaces + gone, " " * len(spaces)), r"(?U)\s+", " "))


def _clean(x, keep):
    s = F.translate(x, " ​﻿", "   ")
    for p, to in [
        (r"\r\n|\r", "\n"), (r"\n{4,}", "\n\n\n"), (r"[ \t]+", " "), (r"[ \t]+\n", "\n"), (r"(?iuU)Стр(?:аница)?\.?\s*\d+\s*(?:из\s*\d+)?", ""), (r"_{10,}", ""), (r"-{10,}", ""),
        (r"(?iu)([а-яё])\s*-\s*\n\s*([а-яё])", "$1$2"),
    ]:
        s = F.regexp_replace(s, p, to)
    if not keep:
        s = F.regexp_replace(s, r"(?U)(\w)\s*\n\s*(\w)", "$1 $2")
    return F.trim(T.drop_repeated_paragraphs(T.collapse_lines(T.strip_quotes(s))))


def test_as_step_by_step(spark):
    x = F.col("x")
    rows = spark.createDataFrame([(t,) for t in ODD], "x string")
    spaced = F.concat(F.lit("  "), F.trim(F.regexp_replace(_normalize(x), r"(?U)[^\w]+", "   ")), F.lit(" "))
    pairs = {
        "normalize": (T.normalize(x), _normalize(x)), "spaced": (retrieval._spaced(x), spaced), "clean": (T.clean(x), _clean(x, False)), "paragraphs": (T.clean(x, True), _clean(x, True)),
        "tokens": (T.all_tokens(x), F.regexp_extract_all(F.translate(F.lower(F.coalesce(x, F.lit(""))), "ё", "е"), F.lit(T.TOKEN), 0)),
    }
    for r in rows.select("x", *[F.struct(a.alias("got"), b.alias("want")).alias(n) for n, (a, b) in pairs.items()]).collect():
        for n in pairs:
            assert r[n]["got"] == r[n]["want"], (n, r["x"])


def test_plain_texts_skip_the_map_of_characters(spark):
    case = T.normalize(F.col("x"))
    assert "char_length(x)" in str(case).lower() and str(case).lower().count("translate(") == 1
