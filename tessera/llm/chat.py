"""Chat formatting from reply trees, in DataFrame functions alone.

A tree's messages name their parents. Every root-to-leaf path is enumerated by self-joins that
double: after round k each leaf knows its 2^k nearest ancestors and each message its ancestor 2^k
steps up, so a chain of n turns takes log2(n) rounds of joins over narrow rows (ids and scores, no
texts). Paths are ranked within their tree by mean score; each chosen one is one conversation.

Template: ``<|im_start|>role NEWLINE text <|im_end|> NEWLINE`` for each turn. In texts and roles
``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (a newline in a role ``&#10;``), so no text can
open or close a turn, and reading back undoes it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&lt;|"), F.lit("<|")), F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of flat conversations: each turn replies to the one before it.

    Rows go by turn; rows that share a turn (or have none) go by role and text and all stay. Rows
    with a null conv_id are one conversation. Null roles and texts are empty.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", text("role"), text("text"))
    n = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree", n.alias("msg"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(spark: SparkSession, messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, msg, dist): the messages of the chosen paths, ``dist`` steps above their leaf.

    ``branches``: the best so many paths of each tree by mean score, then by leaf (None: all).
    A message whose parent is missing is a root. Messages on a cycle of parents lead to no leaf and
    are left out; a tree of n messages takes at most log2(n) + 1 rounds.
    """
    nodes = Table(spark, messages.select("tree", "msg", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages").df
    link = nodes.select(F.col("tree").alias("t"), "msg", F.col("parent").alias("anc"))
    known = nodes.select(F.col("tree").alias("t2"), F.col("msg").alias("m2"))
    up = Table(spark, link.join(known, F.col("t").eqNullSafe(F.col("t2")) & (F.col("anc") == F.col("m2")), "left_semi"), "up").df
    replied = up.select(F.col("t").alias("t3"), F.col("anc").alias("m3"))
    leaf = nodes.join(replied, F.col("tree").eqNullSafe(F.col("t3")) & (F.col("msg") == F.col("m3")), "left_anti")
    found = Table(spark, leaf.select("tree", F.col("msg").alias("leaf"), "msg", F.lit(0).cast("long").alias("dist")), "paths").df
    deepest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < deepest:
        far = found.join(up, F.col("tree").eqNullSafe(F.col("t")) & (found.msg == up.msg)).select("tree", "leaf", F.col("anc").alias("msg"), (F.col("dist") + step).alias("dist"))
        found = Table(spark, found.unionByName(far), "paths").df
        step *= 2
        if step < deepest:
            above = up.select(F.col("t").alias("t2"), F.col("msg").alias("mid"), F.col("anc").alias("top"))
            up = Table(spark, up.join(above, F.col("t").eqNullSafe(F.col("t2")) & (up.anc == above.mid)).select("t", "msg", F.col("top").alias("anc")), "up").df
    if branches is None:
        return found
    scored = found.join(nodes.select(F.col("tree").alias("t"), F.col("msg").alias("m"), "score"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("msg") == F.col("m")))
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))
    best = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("mean")).withColumn("rank", rank).where(F.col("rank") <= branches)
    best = best.select(F.col("tree").alias("t"), F.col("leaf").alias("l"))
    return found.join(best, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")), "left_semi")


def formatted(spark: SparkSession, messages: DataFrame, branches: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, formatted, loss): one conversation per chosen path.

    ``loss`` lists (start, length) in code points of ``formatted``: the escaped texts of ``loss_role``.
    """
    m = messages.select(F.col("tree").alias("t"), F.col("msg").alias("m"), "role", "text")
    path = paths(spark, messages, branches)
    rows = path.join(m, F.col("tree").eqNullSafe(F.col("t")) & (F.col("msg") == F.col("m")))
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    rows = rows.select("tree", "leaf", "dist", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE + "\n")))
    order = W.partitionBy("tree", "leaf").orderBy(F.desc("dist"))
    rows = rows.withColumn("start", F.sum(F.length("piece").cast("long")).over(order) - F.length("piece") + F.length("head"))
    span = F.when(F.col("role") == loss_role, F.struct("start", F.length("body").cast("long").alias("length")))
    turns = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "piece", span.alias("span")))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda x: x.span), lambda x: x.isNotNull())
    return turns.select("tree", "leaf", F.array_join(F.transform("turns", lambda x: x.piece), "").alias("formatted"), spans.alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """``turns`` (role, text) and ``loss_text`` of formatted conversations, from the output alone."""
    parts = F.slice(F.split("formatted", F.lit(r"<\|im_start\|>"), -1), 2, F.greatest(F.size(F.split("formatted", F.lit(r"<\|im_start\|>"), -1)) - 1, F.lit(0)))
    role = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substr(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(CLOSE) - 1)
    turns = F.transform(parts, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int"))))
    return conversations.select("*", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))
