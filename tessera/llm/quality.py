"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Fixed base rules reject what no corpus wants (too short, mostly repeated word windows). Everything
else is judged against its own kind: for each language and source a quantile sketch of each metric
gives quartiles, and a document outside the outer fences (quartile -/+ ``fence`` times the
interquartile range) is rejected.

The sketch is a log-linear histogram: an integer metric keeps its 7 leading bits, so a quantile is
at most 1/64 off, and sketches merge by adding counts, in any order, with one result. Strata with
fewer than ``least`` documents use the merged sketch of their language, or else of the corpus.
A quartile range can be zero (most documents have no symbols at all), so each metric has a
``spread`` that the range counts as at least; without it one ampersand would be an outlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, SPACES, Table, fresh, light

SYMBOLS = "#*$%&|<>"
#: Limits of so many strata at most are broadcast; beyond it, a shuffle.
BROADCAST_STRATA = 10_000

#: metric: (expression in thousandths, least range, whether too low is bad as well)
METRICS: dict[str, tuple[str, int, bool]] = {
    "symbols": ("1000 * n_symbols div n_words", 40, False),
    "word_length": ("1000 * word_chars div n_words", 1000, True),
    "dup_lines": ("1000 * n_dup_lines div n_lines", 200, False),
}


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", row: bool = False) -> DataFrame:
    """One row per document: doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    Null texts count as empty; missing lang or source columns as null. Repeated windows are found
    by their 64-bit hashes within one document; only documents that have any are sorted. With ``row``, a
    struct of that name has all columns of the document.
    """
    whole = [F.struct(*docs.columns).alias("row")] if row else []
    also = ["row"] if row else []
    have = {c.lower() for c in docs.columns}
    key = [(F.col(c).cast("string") if c.lower() in have else F.lit(None).cast("string")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    t = docs.select(*whole, F.col(id_col).cast("long").alias("doc_id"), *key, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    bare = F.translate("t", SPACES, "")
    d = t.select(
        *also, "doc_id", "lang", "source",
        F.length(bare).cast("long").alias("word_chars"),
        _count_of(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.transform(F.array_remove(F.split("t", SPACE), ""), lambda w: F.xxhash64(w)).alias("w"),
        F.filter(F.transform(F.split("t", "\n"), lambda x: F.when(F.translate(x, SPACES, "") != "", F.struct(F.xxhash64(x), F.xxhash64(F.lit(1), x)))), lambda x: x.isNotNull()).alias("lines"),
    )
    n = F.size("w")
    window = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)])
    d = d.select("*", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).alias("h"))
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    d = d.select("*", F.when(repeated, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).alias("s"))
    same = lambda x, j: F.coalesce(x.h == F.get("s", j).h, F.lit(False))
    d = d.select("*", F.sort_array(F.transform(F.filter("s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.p)).alias("at"))
    step = F.transform("at", lambda p, i: F.coalesce(F.least(F.lit(5), F.get("at", i + 1) - p), F.lit(5)))
    d = d.select(
        *also, "doc_id", "lang", "source", n.cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def _sketch_bin(v: Column) -> Column:
    """The value with its 7 leading bits kept: the sketch's bin."""
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(feats: DataFrame) -> DataFrame:
    """(lang, source, metric, v, n): counts per bin, of documents that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _sketch_bin(F.expr(e)).alias("v")) for m, (e, _, _) in METRICS.items()]))
    return feats.where("NOT base_failed").select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.metric", "x.v").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, total, q1, q3): the least bin at which the counts reach a quarter, and three."""
    merged = sketch.groupBy(*keys, "metric", "v").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "metric")
    run = merged.select(*keys, "metric", "v", F.sum("n").over(by.orderBy("v")).alias("run"), F.sum("n").over(by).alias("total"))
    q = lambda k, a: F.min(F.when(F.col("run") * 4 >= F.col("total") * k, F.col("v"))).alias(a)
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("total"), q(1, "q1"), q(3, "q3"))


def thresholds(sketch: DataFrame, least: int = 50, fence: int = 3) -> DataFrame:
    """(lang, source, <metric>_lo, <metric>_hi): a row for each stratum of the sketch."""
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), F.col("total").alias("l_total"), F.col("q1").alias("l1"), F.col("q3").alias("l3"))
    whole = quartiles(sketch, []).select(F.col("metric").alias("a_metric"), F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    q = own.join(lang, own.lang.eqNullSafe(lang.l_lang) & (own.metric == lang.l_metric)).join(whole, F.col("metric") == F.col("a_metric"))
    pick = lambda k: F.when(F.col("total") >= least, F.col(f"q{k}")).when(F.col("l_total") >= least, F.col(f"l{k}")).otherwise(F.col(f"a{k}"))
    q = q.select("lang", "source", "metric", pick(1).alias("q1"), pick(3).alias("q3"))
    out = []
    for m, (_, spread, _) in METRICS.items():
        reach = fence * F.greatest(F.col("q3") - F.col("q1"), F.lit(spread))
        mine = F.col("metric") == m
        out += [F.max(F.when(mine, F.col("q1") - reach)).alias(f"{m}_lo"), F.max(F.when(mine, F.col("q3") + reach)).alias(f"{m}_hi")]
    return q.groupBy("lang", "source").agg(*out)


def judged(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, fence: int = 3, **cols) -> DataFrame:
    """``features`` and ``kept`` for every row of ``docs``. Texts are read once and never shuffled.

    Rows that fail the base rules are not kept, and take no part in the sketches. Null languages and
    sources are strata like others. An empty table gives an empty result. With ``row=True`` the features
    bring the whole document along, as in ``features``.
    """
    feats = Table(spark, features(docs, id_col, text_col, **cols), "features").df
    limit = light(Table(spark, thresholds(sketches(feats), least, fence), "thresholds").df, BROADCAST_STRATA)
    limit = limit.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    bad = F.lit(False)
    for m, (e, _, low) in METRICS.items():
        bad = bad | (F.expr(e) > F.col(f"{m}_hi"))
        if low:
            bad = bad | (F.expr(e) < F.col(f"{m}_lo"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(~bad, F.lit(True)))
    return feats.join(limit, feats.lang.eqNullSafe(limit.t_lang) & feats.source.eqNullSafe(limit.t_source), "left").select(*feats.columns, kept.alias("kept"))


def filtered(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rejected documents; all columns stay. Each row is judged by itself, null and repeated ids too."""
    # documents are written beside their features and never shuffled: only the limits of their stratum meet them
    key = fresh(docs, "_key")  # ids of any type
    found = judged(spark, docs.withColumn(key, F.lit(0)), key, text_col, row=True, **kw).where("kept")
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
