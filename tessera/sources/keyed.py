"""Stored tables with a row for each key: merges of batches that rewrite only the partitions they touch.

Rows lie in ``buckets`` partitions by a hash of their key. A merge reads the buckets that its batch falls into, joins
old and new rows by key within them, and overwrites these partitions alone (dynamic partition overwrite).
What a key's rows become is declared column by column, as a value that doesn't depend on how often or in which
parts batches come, or with the batch's number beside it: a batch whose number a row has already seen leaves
that row as it is. So a batch that is run again, whole or in part, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import _exists, written

SEEN, BUCKET = "last_batch", "bucket"


def keep_new(old: Column, new: Column) -> Column:
    """The last value that isn't null."""
    return F.coalesce(new, old)


def keep_old(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def add(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


class Keyed:
    """A stored table of ``keys`` and values, merged by ``rules`` (column to a function of its old and new value)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], rules: dict, buckets: int = 64):
        self.spark, self.path, self.keys, self.rules, self.buckets = spark, path, keys, rules, buckets

    def read(self) -> DataFrame | None:
        """The rows, or None before the first merge."""
        return self.spark.read.parquet(self.path).drop(BUCKET, SEEN) if _exists(self.spark, self.path) else None

    def merge(self, rows: DataFrame, batch: int) -> int:
        """Merge ``rows`` (one for each key, keys may be null) as batch number ``batch`` (ascending); returns the partitions written.

        A row that has seen this batch or a later one stays as it is.
        """
        columns = [*self.keys, *self.rules]
        place = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = written(rows.select(*columns).withColumn(BUCKET, place), "batch")
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
        if not touched:
            return 0
        out = new.withColumn(SEEN, F.lit(batch).cast("long"))
        if _exists(self.spark, self.path):
            old = self.spark.read.parquet(self.path).where(F.col(BUCKET).isin(touched))
            x, y = old.alias("x"), new.alias("y")
            same = F.col(f"x.{BUCKET}") == F.col(f"y.{BUCKET}")
            for k in self.keys:
                same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
            came = F.col(f"y.{BUCKET}").isNotNull() & (F.coalesce(F.col(f"x.{SEEN}"), F.lit(-1)) < batch)
            one = lambda c: F.when(F.col(f"x.{BUCKET}").isNull(), F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(c)
            value = [F.when(~came, F.col(f"x.{c}")).when(F.col(f"x.{BUCKET}").isNull(), F.col(f"y.{c}")).otherwise(f(F.col(f"x.{c}"), F.col(f"y.{c}"))).alias(c) for c, f in self.rules.items()]
            seen = F.when(came, F.lit(batch).cast("long")).otherwise(F.col(f"x.{SEEN}")).alias(SEEN)
            out = x.join(y, same, "full").select(*[one(k) for k in self.keys], *value, one(BUCKET), seen)
            out = written(out, "merged")  # read whole before its partitions are overwritten
        out.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return len(touched)


def labels(spark: SparkSession, path: str) -> Keyed:
    """Labels (ns, code): title and path as last written, unless null."""
    return Keyed(spark, path, ["ns", "code"], {"title": keep_new, "path": keep_new})


def bridge(spark: SparkSession, path: str) -> Keyed:
    """Labels of documents: the greatest confidence."""
    return Keyed(spark, path, ["doc_id", "ns", "code"], {"path": keep_new, "conf": lambda a, b: F.greatest(a, b)})


def topics(spark: SparkSession, path: str) -> Keyed:
    """Topics with their total weight and number."""
    return Keyed(spark, path, ["topic"], {"total_weight": add, "n": add, "last_at": lambda a, b: F.greatest(a, b)})


def sessions(spark: SparkSession, path: str) -> Keyed:
    """Sessions: first and last use, messages, and sums that means are made of."""
    first, last = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    return Keyed(spark, path, ["session_id"], {"started_at": first, "ended_at": last, "message_count": add, "confidence_sum": add, "n_confidence": add})
