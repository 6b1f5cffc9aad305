"""Operators on whole documents: statistics, keywords, duplicates, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.binding import bound
from tessera.sources.tables import written

KEYWORD = r"(?U)\b[а-яёА-ЯЁa-zA-Z]{4,}\b"
#: Words that are never keywords.
NOT_KEYWORDS = ["этот", "который", "такой", "только", "также", "более", "менее", "через", "после", "перед"]


def normalized_hash(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, doc_hash): the MD5 of the normalized text."""
    return docs.select(id_col, T.content_hash(F.col(text_col)).alias("doc_hash"))


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_hash, n_copies, first_id) of normalized texts that occur more than once."""
    return normalized_hash(docs, text_col, id_col).groupBy("doc_hash").agg(F.count("*").alias("n_copies"), F.min(id_col).alias("first_id")).where("n_copies > 1")


def text_stats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, total_chars, total_words, total_lines, avg_word_length) by letter words of four or more."""
    words = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(KEYWORD), 0)
    x = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("t"), words.alias("w"))
    letters = F.aggregate("w", F.lit(0), lambda a, w: a + F.length(w))
    lines = F.length("t") - F.length(F.replace(F.col("t"), F.lit("\n"))) + 1
    return x.select(id_col, F.length("t").alias("total_chars"), F.size("w").alias("total_words"), lines.alias("total_lines"), F.coalesce(letters / F.nullif(F.size("w"), F.lit(0)), F.lit(0.0)).alias("avg_word_length"))


def token_stats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, n_distinct)."""
    x = docs.select(id_col, T.all_tokens(F.col(text_col)).alias("t"))
    return x.select(id_col, F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def keywords(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", top: int = 20, least: int = 4, keep: int = 10) -> DataFrame:
    """(id, keywords): of a document's ``top`` most frequent words those with ``least`` uses, the first ``keep``.

    Ties go by first use. Documents without any are left out. Words are counted within their row and not
    shuffled; only rows that share an id are, by a row for each distinct word of a document, counted before it.
    """
    rows = docs.select(id_col, F.col(text_col).alias("_text"))
    ids = rows.groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(id_col).alias("_id"))
    again = written(ids, "repeated-ids")
    if not again.limit(1).count():
        return _keywords_in_place(rows, id_col, top, least, keep)
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    once, many = rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")
    return _keywords_in_place(once, id_col, top, least, keep).unionByName(_keywords_by_id(many, id_col, top, least, keep))


def _keywords_in_place(rows: DataFrame, id_col: str, top: int, least: int, keep: int) -> DataFrame:
    """``keywords`` of rows (id, _text) with ids of their own: a text's words in order, runs of equal words counted there."""
    words = F.transform(F.regexp_extract_all("_text", F.lit(KEYWORD), 0), lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("pos")))
    d = bound(rows, _s=F.array_sort(words)).select(id_col, "_s")
    # a word with `least` uses begins where the word before differs and the one `least` - 1 further on doesn't
    before, on = lambda i: F.get("_s", i - 1)["w"], lambda i: F.get("_s", i + (least - 1))["w"]
    begins = F.filter(F.transform("_s", lambda x, i: F.struct(x.w.alias("w"), x.pos.alias("pos"), i.alias("i"))), lambda x: (on(x.i) == x.w) & ~before(x.i).eqNullSafe(x.w))
    ends = F.filter(F.transform("_s", lambda x, i: F.struct(x.w.alias("w"), i.alias("i"))), lambda x: (F.get("_s", x.i - (least - 1))["w"] == x.w) & ~F.get("_s", x.i + 1)["w"].eqNullSafe(x.w))
    d = bound(d, _b=begins, _e=ends).select(id_col, "_b", "_e")
    ranked = F.transform("_b", lambda x, k: F.struct((x.i - F.get("_e", k)["i"]).alias("n"), x.pos.alias("pos"), x.w.alias("word")))
    best = F.filter(F.slice(F.array_sort(ranked), 1, top), lambda x: ~x.word.isin(NOT_KEYWORDS))
    return d.select(id_col, F.slice(F.transform(best, lambda x: x.word), 1, keep).alias("keywords")).where(F.size("keywords") > 0)


def _keywords_by_id(rows: DataFrame, id_col: str, top: int, least: int, keep: int) -> DataFrame:
    """``keywords`` of rows (id, _text), those of one id together."""
    words = rows.select(id_col, F.posexplode(F.regexp_extract_all(F.col("_text"), F.lit(KEYWORD), 0)).alias("pos", "word"))
    n = words.groupBy(id_col, F.lower("word").alias("word")).agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    rank = F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("n"), "pos"))
    best = n.withColumn("rank", rank).where((F.col("rank") <= top) & (F.col("n") >= least) & ~F.col("word").isin(NOT_KEYWORDS))
    found = best.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
    return found.select(id_col, F.slice(F.transform("w", lambda x: x.word), 1, keep).alias("keywords"))


def importance(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return docs.select(id_col, T.importance(F.coalesce(text_col, F.lit(""))).alias("importance"))


def metadata(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, version, date, date_format, doc_type)."""
    x = docs.select(id_col, T.version(F.col(text_col)).alias("version"), T.date_found(F.col(text_col)).alias("d"), T.doc_type(F.col(text_col)).alias("doc_type"))
    return x.select(id_col, "version", "d.date", "d.date_format", "doc_type")


def collapsed_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, text) without runs of equal lines."""
    return docs.select(id_col, T.collapse_lines(F.col(text_col)).alias("text"))


def without_boilerplate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return docs.select(id_col, T.drop_repeated_paragraphs(F.col(text_col)).alias("text"))


def cleaned(docs: DataFrame, text_col: str = "text", keep_paragraphs: bool = False) -> DataFrame:
    return docs.withColumn(text_col, T.clean(F.col(text_col), keep_paragraphs))


def deduplicated(chunks: DataFrame) -> DataFrame:
    """Chunks by (parent_group, is_parent, doc_hash): the most important stays, then the least id."""
    key = W.partitionBy(F.coalesce("parent_group", F.lit("")), "is_parent", "doc_hash").orderBy(F.desc("importance_score"), "id")
    return chunks.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


def only_new(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks whose key isn't in ``known``; do this before embedding them."""
    key = lambda d, n: [F.coalesce(d["parent_group"], F.lit("")).alias(f"{n}0"), d["is_parent"].alias(f"{n}1"), d["doc_hash"].alias(f"{n}2")]
    k = known.select(*key(known, "k"))
    return chunks.join(k, (F.coalesce(chunks.parent_group, F.lit("")) == k.k0) & chunks.is_parent.eqNullSafe(k.k1) & (chunks.doc_hash == k.k2), "left_anti")
