"""Neighbours of a chunk: before, after, parent and children, and texts widened with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.sources.tables import written

# Lengths of what is added ------------------------------------------------------------
SIDE, PARENT, SEAM, FIRST_HITS = 220, 400, 40, 10
# --------------------------------------------------------------------------------------------------


def neighbours(chunks: DataFrame, window: int = 1, group: str = "parent_group", order: str = "child_index") -> DataFrame:
    """(id, before, after): the texts of the nearest ``window`` rows on both sides within the group, joined by blank lines."""
    w = W.partitionBy(group).orderBy(order, "id")
    x = chunks.select("id", F.collect_list("text").over(w.rowsBetween(-window, -1)).alias("b"), F.collect_list("text").over(w.rowsBetween(1, window)).alias("a"))
    text = lambda c: F.nullif(F.array_join(c, "\n\n"), F.lit(""))
    return x.select("id", text("b").alias("before"), text("a").alias("after"))


def tail(x: Column, most: int = SIDE) -> Column:
    """The last sentence's beginning on, at most the last ``most`` characters; all of them if no sentence ends there."""
    s = F.when(F.length(x) > most + 200, F.substring(x, -(most + 200), most + 200)).otherwise(x)
    last = F.regexp_extract(s, r"(?s)[.!?…]\s+([^.!?…]*)$", 1)
    frag = F.when(s.rlike(r"(?s)[.!?…]\s+[^.!?…]*$"), last).otherwise(s)
    return F.ltrim(F.when(F.length(frag) > most, F.substring(frag, -most, most)).otherwise(frag))


def head(x: Column, most: int = SIDE) -> Column:
    """From the second sentence on, at most ``most`` characters; from the start if there is one sentence."""
    s = F.substring(x, 1, most + 200)
    rest = F.regexp_replace(s, r"(?s)^.*?[.!?…]\s+", "")
    return F.rtrim(F.substring(F.when(s.rlike(r"[.!?…]\s"), rest).otherwise(s), 1, most))


def parents(chunks: DataFrame) -> DataFrame:
    """(parent_group, parent_text): the beginning of the first parent row of each group."""
    n = F.row_number().over(W.partitionBy("parent_group").orderBy("id"))
    return chunks.where("is_parent").withColumn("n", n).where("n = 1").select("parent_group", F.substring("text", 1, PARENT).alias("parent_text"))


def children_preview(chunks: DataFrame, first: int = 2) -> DataFrame:
    """(parent_group, preview): the texts of a group's first children."""
    n = F.row_number().over(W.partitionBy("parent_group").orderBy("child_index", "id"))
    some = chunks.where("NOT coalesce(is_parent, false)").withColumn("n", n).where(F.col("n") <= first)
    return some.groupBy("parent_group").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("x")).select("parent_group", F.array_join(F.transform("x", lambda r: r.text), "\n\n").alias("preview"))


def widened(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """``hits`` (query_id, rnk, id) with ``text`` widened for each query's first hits; others keep theirs.

    Neighbours are computed once for all chunks of the groups that hits are in, not once for each hit. These chunks are
    written: two passes over all chunks find them, and none is shuffled while hits are few.
    """
    ids = retrieval._small(hits.select("id").distinct())
    groups = written(chunks.select("id", "parent_group").join(ids, "id", "left_semi").select("parent_group").distinct(), "groups")
    near = chunks.select("id", "text", "parent_group", "child_index", "is_parent", "parent_title", "section").join(retrieval._small(groups), "parent_group", "left_semi")
    near = written(near, "near-chunks")
    side = neighbours(near.where("NOT coalesce(is_parent, false)"), window)
    x = hits.join(near.select("id", "text", "parent_group", "is_parent", "parent_title", "section"), "id").join(side, "id", "left")
    x = x.join(parents(near), "parent_group", "left").join(children_preview(near).withColumnRenamed("parent_group", "_g"), (F.col("parent_group") == F.col("_g")) & F.col("is_parent"), "left")
    # a few rows for each query: written, so that the pieces below don't repeat what makes them
    x = x.withColumn("before", tail(F.col("before"))).withColumn("after", head(F.col("after")))
    x = written(x, "neighbours")
    before, after, body = F.col("before"), F.col("after"), F.col("text")
    title = F.trim(F.coalesce(F.nullif(F.col("parent_title"), F.lit("")), "section", F.lit("")))
    lead = F.when(title != "", F.concat(F.lit("«"), title, F.lit("» — краткий контекст:\n"), F.col("parent_text"))).otherwise(F.col("parent_text"))
    begins = F.startswith(F.ltrim(body), F.ltrim(F.substring(before, -SEAM, SEAM)))
    ends = lambda c: F.endswith(F.rtrim(body), F.rtrim(F.substring(c, 1, SEAM)))
    pieces = F.array(
        F.when(~F.coalesce("is_parent", F.lit(False)), lead), F.when((before != "") & ~begins, F.concat(F.lit("...\n"), before)), body,
        F.when((F.col("preview") != "") & ~ends(F.col("preview")), F.concat("preview", F.lit("\n..."))),
        F.when((after != "") & ~ends(after), F.concat(after, F.lit("\n..."))),
    )
    joined = F.trim(F.regexp_replace(F.array_join(F.filter(pieces, lambda p: p.isNotNull()), "\n\n"), r"\n{3,}", "\n\n"))
    return x.select("query_id", "rnk", "id", F.when(F.col("rnk") <= FIRST_HITS, joined).otherwise(body).alias("text"))
