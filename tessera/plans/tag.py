"""Tagging over stored tables: labels of new documents, their metadata, reports, and a second look at unsure codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import meta
from tessera.operators import labels
from tessera.sources import keyed
from tessera.sources.keyed import Keyed
from tessera.sources.tables import written


class Tags:
    """Tables below ``path``: ``labels`` (ns, code), ``bridge`` (doc_id, ns, code) and ``meta`` (doc_id, JSON text)."""

    def __init__(self, spark: SparkSession, path: str):
        self.labels, self.bridge = keyed.labels(spark, f"{path}/labels"), keyed.bridge(spark, f"{path}/bridge")
        self.meta = Keyed(spark, f"{path}/meta", ["doc_id"], {"meta": meta.merged})

    def tag(self, docs: DataFrame, batch: int, guesses: DataFrame | None = None, materials: DataFrame | None = None, min_conf: float = labels.ACCEPT) -> dict[str, int]:
        """Label ``docs`` (doc_id, section, text) as batch number ``batch``; returns the partitions written, by table.

        Guesses (doc_id, code, conf, desc) that aren't sure enough go into the metadata as ``okpd_guess``; ``materials`` (doc_id,
        material: a struct) as ``material_info``. Both are merged into what is there, key by key.
        """
        found, unsure = labels.tagged(docs, guesses, min_conf)
        found = written(found.groupBy("doc_id", "ns", "code").agg(F.max("path").alias("path"), F.max("conf").alias("conf")), "found")
        said = unsure.groupBy("doc_id").agg(F.max(F.struct("conf", "code")).alias("g"))
        said = said.select("doc_id", F.to_json(F.struct(F.struct(F.col("g.code").alias("code"), F.col("g.conf").alias("conf")).alias("okpd_guess"))).alias("meta"))
        if materials is not None:
            info = materials.select("doc_id", F.to_json(F.struct(F.col("material").alias("material_info"))).alias("more"))
            said = said.join(info, "doc_id", "full").select("doc_id", meta.merged(F.col("meta"), F.col("more")).alias("meta"))
        names = found.groupBy("ns", "code").agg(F.max("path").alias("path")).withColumn("title", F.lit(None).cast("string"))
        return {"labels": self.labels.merge(names, batch), "bridge": self.bridge.merge(found, batch), "meta": self.meta.merge(said, batch)}

    def untagged(self, docs: DataFrame, ns: str = "okpd") -> DataFrame:
        """``docs`` without a label of ``ns``, with the guess that their metadata holds (guess, guess_conf)."""
        free, known, said = docs, self.bridge.read(), self.meta.read()
        if known is not None:
            free = labels.untagged(free, known, ns, id_col="doc_id")
        if said is None:
            return free.select("*", F.lit(None).cast("string").alias("guess"), F.lit(None).cast("double").alias("guess_conf"))
        guess = said.select(F.col("doc_id").alias("_doc"), meta.probe(F.col("meta"), "$.okpd_guess.code").alias("guess"), meta.probe(F.col("meta"), "$.okpd_guess.conf", "double").alias("guess_conf"))
        return free.join(guess, free.doc_id == F.col("_doc"), "left").drop("_doc")

    def guess_report(self, docs: DataFrame, top: int = 20) -> DataFrame:
        """(code, n, avg_conf) of the untagged documents' most frequent guesses."""
        return labels.guess_groups(self.untagged(docs).where("guess IS NOT NULL").select(F.col("guess").alias("code"), F.col("guess_conf").alias("conf")), top)

    def retag(self, guesses: DataFrame) -> None:
        """Replace unsure product codes by surer guesses (doc_id, code, conf); the bridge is written anew."""
        old = self.bridge.read()
        if old is None:
            return
        paths = old.select("doc_id", "ns", "code", "path")
        new = labels.retagged(old, guesses).join(paths, ["doc_id", "ns", "code"], "left")
        new = new.withColumn("path", F.coalesce("path", labels.C.breadcrumbs(labels.C.canonical_code(F.col("code")))))
        place = F.pmod(F.xxhash64(*self.bridge.keys), F.lit(self.bridge.buckets)).cast("int")
        whole = written(new.select("doc_id", "ns", "code", "path", "conf", place.alias(keyed.BUCKET), F.lit(-1).cast("long").alias(keyed.SEEN)), "retagged")
        whole.repartition(keyed.BUCKET).write.mode("overwrite").partitionBy(keyed.BUCKET).parquet(self.bridge.path)
