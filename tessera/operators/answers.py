"""The answer side: context, grounding, confidence, citations, extractive answers, prompt packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import fuzzy as Z
from tessera.functions import text as T

# Sizes and thresholds ------------------------------------------------------------------
GROUPS, PER_FRAGMENT, CONTEXT_CHARS = 5, 1500, 12000
SENTENCE, SOURCES, SOURCE_CHARS, CONTAINED, SHARED = 20, 8, 1200, 220, 0.5
CITATIONS = 8
MESSAGE_CHARS, MESSAGES, BUDGET = 8000, 30, (16384 - 1024 - 256) * 4
LOW = 0.35
# --------------------------------------------------------------------------------------------------


def islands(pages: DataFrame, keys: list[str], page: str = "page", tie: str = "id") -> DataFrame:
    """``pages`` with ``island``: rows whose page is at most one above the row before share it; a null page stands alone."""
    w = W.partitionBy(*keys).orderBy(F.col(page).asc_nulls_last(), tie)
    opens = F.when(F.coalesce(F.col(page) - F.lag(page).over(w) <= 1, F.lit(False)), 0).otherwise(1)
    return pages.withColumn("_open", opens).withColumn("island", F.sum("_open").over(w)).drop("_open")


def overlap_length(a: Column, b: Column, least: int = 21, most: int = 200) -> Column:
    """Length of the longest end of ``a`` that begins ``b``; 0 below ``least``."""
    cap = F.least(F.lit(most), F.length(a), F.length(b))
    found = F.filter(F.sequence(F.lit(least), F.greatest(cap, F.lit(least))), lambda n: (n <= cap) & (F.substr(a, F.length(a) - n + 1) == F.substr(b, F.lit(1), n)))
    return F.coalesce(F.array_max(found), F.lit(0))


def _glued(texts: Column) -> Column:
    """Texts in order as one: an overlap of more than 50 characters is dropped, else a blank line joins."""

    def add(done: Column, x: Column) -> Column:
        n = overlap_length(done, x)
        return F.when(done == "", x).when(n > 50, F.concat(done, F.substr(x, n + 1))).otherwise(F.concat(done, F.lit("\n\n"), x))

    return F.aggregate(texts, F.lit(""), add)


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context) from ``hits`` (query_id, id, book, section, page, text, score, is_parent).

    The best sections by their greatest score; within one, fragments of adjoining pages are glued. Parents
    count only in sections that have nothing else.
    """
    key = ["query_id", "book", "section"]
    best = hits.groupBy(*key).agg(F.max("score").alias("best"), F.min(F.coalesce("is_parent", F.lit(False))).alias("only_parents"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("best"), "book", "section"))
    best = best.withColumn("grp", rank).where(F.col("grp") <= GROUPS)
    x = hits.join(best.select(*key, "grp", "only_parents"), key).where(F.col("only_parents") | ~F.coalesce("is_parent", F.lit(False)))
    x = islands(x, ["query_id", "grp"])
    order = F.struct(F.col("page").isNull().alias("last"), "page", "id", F.coalesce("text", F.lit("")).alias("text"))
    parts = x.groupBy("query_id", "grp", "book", "section", "island").agg(F.array_sort(F.collect_list(order)).alias("t"))
    parts = parts.select("query_id", "grp", "book", "section", "island", F.substring(_glued(F.transform("t", lambda r: r.text)), 1, PER_FRAGMENT).alias("part"))
    groups = parts.groupBy("query_id", "grp", "book", "section").agg(F.array_sort(F.collect_list(F.struct("island", "part"))).alias("p"))
    titled = F.concat(F.lit("\n### "), F.coalesce("book", F.lit("Unknown")), F.lit(" - "), F.coalesce("section", F.lit("Unknown")), F.lit("\n\n"), F.array_join(F.transform("p", lambda r: F.concat(r.part, F.lit("\n"))), "\n"))
    whole = groups.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("grp", titled.alias("s")))).alias("g"))
    return whole.select("query_id", F.substring(F.array_join(F.transform("g", lambda r: r.s), "\n"), 1, CONTEXT_CHARS).alias("context"))


def plain_answer(x: Column) -> Column:
    """An answer without code, links and addresses."""
    for p, to in ((r"(?s)```.*?```", ""), (r"`[^`]+`", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"https?://\S+", "")):
        x = F.regexp_replace(x, p, to)
    return x


def grounding(answers: DataFrame, hits: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(query_id, grounding): the share of an answer's sentences that its sources support.

    ``answers`` (query_id, answer), ``hits`` (query_id, rnk, text). A sentence of 20 characters or more is
    supported if half of its tokens are in the sources, or if it is short and one contains it. 0 without either. With ``fuzzy`` an edit ratio to one of the sources that is high enough will do too
    (``functions.fuzzy.sentence_found``).
    """
    low = lambda c: F.trim(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"(?U)\s+", " "))
    src = hits.where(F.col("rnk") <= SOURCES).select("query_id", F.substring(low(F.col("text")), 1, SOURCE_CHARS).alias("s"))
    src = src.groupBy("query_id").agg(F.collect_list("s").alias("src")).withColumn("stok", F.array_distinct(F.flatten(F.transform("src", T.all_tokens))))
    sent = answers.select("query_id", F.explode_outer(T.sentences(plain_answer(F.coalesce("answer", F.lit(""))))).alias("x"))
    sent = sent.select("query_id", F.regexp_replace("x", r"^[ \t\n\r\-–—•*]+|[ \t\n\r\-–—•*]+$", "").alias("x"))
    x = sent.where(F.length("x") >= SENTENCE).join(src, "query_id").select("query_id", low(F.col("x")).alias("x"), "src", "stok").withColumn("k", T.tokens(F.col("x")))
    ok = ((F.size("k") > 0) & (T.overlap(F.col("k"), F.col("stok")) >= SHARED)) | ((F.length("x") <= CONTAINED) & F.exists("src", lambda s: F.contains(s, F.col("x"))))
    if fuzzy:  # only sentences that nothing else supports reach Python
        ok = ok | Z.sentence_found(F.when(~ok, F.col("x")), F.when(~ok, F.col("src")))
    share = x.groupBy("query_id").agg(F.round(F.avg(ok.cast("int")), 6).alias("grounding"))
    return answers.select("query_id").join(share, "query_id", "left").fillna(0.0, ["grounding"])


def confidence(hits: DataFrame, answers: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, confidence) from ``hits`` (query_id, rnk, score) and ``answers`` (query_id, answer, grounding or null)."""
    h = hits.groupBy("query_id").agg(F.avg(F.when(F.col("rnk") <= 5, F.col("score"))).alias("mean5"), F.max(F.when(F.col("rnk") == 1, F.col("score"))).alias("top"), F.count_if(F.col("score") > 0.5).alias("good"))
    c = F.col("mean5") * 0.3 + F.col("top") * 0.3 + F.least(F.col("good") / 5, F.lit(1.0)) * 0.2 + F.least(F.length(F.coalesce("answer", F.lit(""))) / 1000, F.lit(1.0)) * 0.1
    c = F.when(F.col("grounding").isNull(), c).otherwise(c * 0.7 + F.col("grounding") * 0.3)
    return answers.join(h, "query_id", "left").select("query_id", F.round(F.least(F.coalesce(c, F.lit(0.0)), F.lit(1.0)), digits).alias("confidence"))


def citations(hits: DataFrame, most: int = CITATIONS) -> DataFrame:
    """(query_id, pos, book, section, page, relevance, is_parent): distinct places, children first, then by score."""
    parent = F.coalesce("is_parent", F.lit(False))
    x = hits.where(F.col("rnk") <= 2 * most).withColumn("is_parent", parent)
    order = [F.col("is_parent"), F.desc("score"), F.col("rnk")]
    x = x.withColumn("n", F.row_number().over(W.partitionBy("query_id", "book", "section", "page").orderBy(*order))).where("n = 1")
    x = x.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("pos") <= most)
    return x.select("query_id", "pos", "book", "section", "page", F.col("score").alias("relevance"), "is_parent")


def extractive(hits: DataFrame, most: int = 5, preview: int = 500) -> DataFrame:
    """(query_id, answer): the best fragments, numbered, with their place and the beginning of their text."""
    piece = F.format_string("%d. %s - %s\n%s", F.col("rnk"), F.coalesce("book", F.lit("Unknown")), F.coalesce("section", F.lit("Unknown")), F.concat(F.substring("text", 1, preview), F.when(F.length("text") > preview, "...").otherwise("")))
    x = hits.where(F.col("rnk") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rnk", piece.alias("p")))).alias("x"))
    return x.select("query_id", F.array_join(F.transform("x", lambda r: r.p), "\n\n").alias("answer"))


def needs_fallback(confidence: Column, grounding: Column) -> Column:
    return (confidence < LOW) | (grounding < LOW)


def packed_prompt(history: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(conv_id, turn, role, text) of the turns that fit a prompt, newest first in right of way.

    User and assistant turns with text, cut to the limit each; the newest ``MESSAGES`` - 2 of a conversation,
    and of those the newest that the budget holds.
    """
    h = history.where(F.col("role").isin("user", "assistant") & (F.trim("text") != "")).select("conv_id", "turn", "role", F.substring("text", 1, MESSAGE_CHARS).alias("text"))
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    h = h.withColumn("n", F.row_number().over(w)).withColumn("used", F.sum(F.length("text")).over(w))
    return h.where((F.col("n") <= MESSAGES - 2) & (F.col("used") <= budget)).select("conv_id", "turn", "role", "text")


def context_queries(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, query): each user turn widened by the one before it: both texts, and for questions of
    three tokens or more the union of their tokens. The first turn stands alone.

    ``turns`` (conv_id, turn, text [, book, sections]): the book and the first two sections of the answer
    to the turn before are added, where there are any."""
    w = W.partitionBy("conv_id").orderBy("turn")
    x = turns.withColumn("tok", T.stem_tokens(F.col("text")))
    x = x.withColumn("last", F.lag("text").over(w)).withColumn("ltok", F.lag("tok").over(w))
    union = F.array_join(F.array_sort(F.array_union("tok", "ltok")), " ")
    both = F.concat(F.col("last"), F.lit(". "), F.col("text"))
    q = F.when(F.col("last").isNull(), F.col("text")).when(F.size("tok") < 3, both).otherwise(F.concat(both, F.lit(". "), union))
    more = []
    if "book" in turns.columns:
        more.append(F.lag("book").over(w))
    if "sections" in turns.columns:
        more.append(F.nullif(F.array_join(F.slice(F.lag("sections").over(w), 1, 2), " "), F.lit("")))
    x = x.withColumn("more", F.concat_ws(" ", *more))
    return x.select("conv_id", "turn", F.trim(F.concat_ws(" ", q, F.nullif("more", F.lit("")))).alias("query"))


def by_book(hits: DataFrame) -> DataFrame:
    """(query_id, book, n, hits): each query's ``hits`` (query_id, rnk, id, book, score) by book, in order of rank."""
    g = hits.groupBy("query_id", "book").agg(F.array_sort(F.collect_list(F.struct("rnk", "id", "score"))).alias("hits"))
    return g.select("query_id", "book", F.size("hits").alias("n"), "hits")


def topic_shifts(turns: DataFrame, share: float = 0.25, cooldown: float = 60.0) -> DataFrame:
    """(conv_id, turn, overlap, shift): the book changed and few of the tokens are those of the turn before.

    ``turns`` (conv_id, turn, text, book [, ts]). With ``ts``, a shift within ``cooldown`` seconds of the
    conversation's last one doesn't count.
    """
    w = W.partitionBy("conv_id").orderBy("turn")
    x = turns.withColumn("tok", T.stem_tokens(F.col("text")))
    x = x.withColumn("ltok", F.lag("tok").over(w)).withColumn("lbook", F.lag("book").over(w))
    ov = F.when(F.col("ltok").isNotNull(), T.overlap(F.col("tok"), F.col("ltok")))
    cut = F.coalesce((F.size("tok") > 0) & (F.col("book") != F.col("lbook")) & (ov < share), F.lit(False))
    x = x.withColumn("overlap", F.round(ov, 6)).withColumn("raw", cut)
    if "ts" not in turns.columns:
        return x.select("conv_id", "turn", "overlap", F.col("raw").alias("shift"))
    # the cooldown depends on accepted shifts only, so it is a fold over a conversation's own raw shifts
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    raw = x.where("raw").groupBy("conv_id").agg(F.array_sort(F.collect_list(at)).alias("ts_list"))
    init = F.array().cast("array<double>")
    fold = F.aggregate("ts_list", init, lambda a, t: F.when((F.size(a) == 0) | (t - F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) >= cooldown), F.concat(a, F.array(t))).otherwise(a))
    x = x.join(raw.select("conv_id", fold.alias("cuts")), "conv_id", "left")
    return x.select("conv_id", "turn", "overlap", (F.col("raw") & F.coalesce(F.array_contains("cuts", at), F.lit(False))).alias("shift"))
