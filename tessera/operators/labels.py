"""The label dimension, the bridge to documents, filters over both, and safe attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import codes as C

# Thresholds of the tagger and of safe attachment --------------------------------------
ACCEPT, RETAG_FROM = 0.90, 0.85
ANCHOR, LEAF_LEVEL, LEAF_CONF, TRIM_LEVEL, TRIM_CAP = 0.97, 4, 0.93, 3, 0.85
# --------------------------------------------------------------------------------------------------


def extracted(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ns, code, path, conf): a row for each label found in a text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(C.labels(F.col(text_col))).alias("l")).select("doc_id", "l.*")


def merged_labels(rows: DataFrame) -> DataFrame:
    """(ns, code, title, path): one row per label; the last written title and path that aren't null.

    ``rows`` (ns, code, title, path, seq)."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy("ns", "code").agg(last("title"), last("path"))


def attached(rows: DataFrame, how: str = "greatest") -> DataFrame:
    """(doc_id, ns, code, conf): one row per pair; the greatest confidence, or the last one written (``seq``)."""
    conf = F.max("conf") if how == "greatest" else F.max_by("conf", F.when(F.col("conf").isNotNull(), F.col("seq")))
    return rows.groupBy("doc_id", "ns", "code").agg(conf.alias("conf"))


def rollup(bridge: DataFrame) -> DataFrame:
    """(doc_id, labels): a document's labels as a sorted array of structs."""
    return bridge.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ns", "code", "conf"))).alias("labels"))


def having(docs: DataFrame, bridge: DataFrame, ns: str, code: str | None = None, prefix: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Documents with a label of ``ns``: of one code, or below a prefix (``path`` holds it). One semi-join; chain for more."""
    want = bridge.where(F.col("ns") == ns)
    if code is not None:
        want = want.where(F.col("code") == code)
    if prefix is not None:
        want = want.where(F.array_contains("path", prefix))
    want = want.select(F.col("doc_id").alias("_doc"))
    return docs.join(want, docs[id_col] == want["_doc"], "left_semi")


def untagged(docs: DataFrame, bridge: DataFrame, ns: str, compat: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Documents without a label of ``ns``. ``compat``: as a left join over all labels does it, a row for each label of another kind."""
    b = bridge.select(F.col("doc_id").alias("_doc"), "ns")
    if not compat:
        return docs.join(b.where(F.col("ns") == ns), docs[id_col] == F.col("_doc"), "left_anti")
    return docs.join(b, docs[id_col] == F.col("_doc"), "left").where(F.col("ns").isNull() | (F.col("ns") != ns)).drop("_doc", "ns")


def tagged(docs: DataFrame, guesses: DataFrame | None = None, min_conf: float = ACCEPT) -> tuple[DataFrame, DataFrame]:
    """(labels, stored guesses) for ``docs`` (doc_id, section, text), from their first 3000 characters.

    Labels in the text come first. ``guesses`` (doc_id, code, conf, desc) count only for documents without a
    product code; those under ``min_conf`` are stored and not attached.
    """
    body = F.substring(F.concat_ws("\n", F.coalesce("section", F.lit("")), F.coalesce("text", F.lit(""))), 1, 3000)
    found = extracted(docs.select("doc_id", body.alias("text")))
    if guesses is None:
        return found, found.limit(0).select("doc_id", "code", "conf")
    free = guesses.join(found.where("ns = 'okpd'").select("doc_id"), "doc_id", "left_anti").where(F.col("code") != "UNSURE")
    good = free.where(F.col("conf") >= min_conf)
    more = good.select("doc_id", F.lit("okpd").alias("ns"), "code", C.breadcrumbs(C.canonical_code(F.col("code"))).alias("path"), "conf")
    return found.unionByName(more), free.where(F.col("conf") < min_conf).select("doc_id", "code", "conf")


def retagged(bridge: DataFrame, guesses: DataFrame, low: float = RETAG_FROM, high: float = ACCEPT) -> DataFrame:
    """The bridge with product codes in [low, high) replaced where a new guess is surer and reaches ``high``.

    ``bridge`` (doc_id, ns, code, conf), ``guesses`` (doc_id, code, conf)."""
    g = guesses.select(F.col("doc_id").alias("g_doc"), F.col("code").alias("g_code"), F.col("conf").alias("g_conf"))
    x = bridge.join(g, bridge.doc_id == g.g_doc, "left")
    swap = F.coalesce((F.col("ns") == "okpd") & (F.col("conf") >= low) & (F.col("conf") < high) & (F.col("g_conf") > F.col("conf")) & (F.col("g_conf") >= high), F.lit(False))
    return attached(x.select("doc_id", "ns", F.when(swap, F.col("g_code")).otherwise(F.col("code")).alias("code"), F.when(swap, F.col("g_conf")).otherwise(F.col("conf")).alias("conf")))


def nearest_ancestors(items: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(id, code, ancestor, level): the deepest ancestor (or self) of each code that the hierarchy holds; null if none.

    ``items`` (id, code), ``hierarchy`` (code, level)."""
    x = items.select("id", "code", F.posexplode_outer(C.breadcrumbs(F.col("code"))).alias("depth", "up"))
    h = hierarchy.select(F.col("code").alias("up"), "level")
    return x.join(h, "up", "left").groupBy("id", "code").agg(F.max_by("up", F.when(F.col("level").isNotNull(), F.col("depth"))).alias("ancestor"), F.max_by("level", F.when(F.col("level").isNotNull(), F.col("depth"))).alias("level"))


def safely_attached(predictions: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(id, code, conf, predicted, is_final, review) for ``predictions`` (id, code, conf).

    A valid code stands if it is very sure, or a sure leaf. Otherwise its ancestor of the trim level (or the
    nearest valid one above) is attached with a capped confidence, the prediction kept, and a review queued.
    """
    p = predictions.select("id", C.canonical_code(F.col("code")).alias("predicted"), "conf")
    own = hierarchy.select(F.col("code").alias("predicted"), F.col("level").alias("own_level"))
    short = p.select("id", F.array_join(F.slice(F.split("predicted", r"\."), 1, TRIM_LEVEL), ".").alias("code"))
    up = nearest_ancestors(short, hierarchy).select("id", "ancestor")
    x = p.join(own, "predicted", "left").join(up, "id", "left")
    stands = F.coalesce(F.col("own_level").isNotNull() & ((F.col("conf") >= ANCHOR) | ((F.col("own_level") >= LEAF_LEVEL) & (F.col("conf") >= LEAF_CONF))), F.lit(False))
    return x.select("id", F.when(stands, F.col("predicted")).otherwise(F.col("ancestor")).alias("code"), F.when(stands, F.col("conf")).otherwise(F.least("conf", F.lit(TRIM_CAP))).alias("conf"), "predicted", stands.alias("is_final"), (~stands).alias("review"))


def tagging_report(bridge: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: n_docs, n_tagged, n_labels, n_sure, n_unsure, share_tagged, share_sure."""
    b = bridge.agg(F.countDistinct("doc_id").alias("n_tagged"), F.count("*").alias("n_labels"), F.count_if(F.col("conf") >= ACCEPT).alias("n_sure"), F.count_if(F.col("conf") < ACCEPT).alias("n_unsure"))
    share = lambda a, c: F.round(F.coalesce(F.col(a) / F.nullif(F.col(c), F.lit(0)), F.lit(0.0)), 6)
    return docs.agg(F.count("*").alias("n_docs")).crossJoin(b).withColumn("share_tagged", share("n_tagged", "n_docs")).withColumn("share_sure", share("n_sure", "n_labels"))


def guess_groups(guesses: DataFrame, top: int = 20) -> DataFrame:
    """(code, n, avg_conf) of the most frequent stored guesses."""
    return guesses.groupBy("code").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("avg_conf")).orderBy(F.desc("n"), "code").limit(top)


def ranked_by_confidence(bridge: DataFrame) -> DataFrame:
    """The bridge with each label's rank within its document."""
    return bridge.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("conf"), "ns", "code")))
