"""What the operators of this subpackage share: tables in the folder that all executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back, so a
lost executor costs a reread and never a recomputation of the whole job. The folder's name is read
from the session; only where it is unset (tests) a folder of our own is set.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The widest set of keys that is broadcast, and its bytes as JSON; beyond either, a shuffle.
BROADCAST_KEYS, BROADCAST_BYTES = 1_000_000, 32 << 20
_RUN = uuid.uuid4().hex[:12]
_FALLBACK = "/tmp/checkpoints"
_CLEAN: set[str] = set()

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """This run's own folder below the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _FALLBACK
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessera-{_RUN}"
    if path not in _CLEAN:
        _CLEAN.add(path)
        atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session has ended: the cluster's own cleaning of the folder remains
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours by Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


_SCOPES: list[list[Table]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written within are deleted at the end, but for those that say ``stays``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for t in _SCOPES.pop():
            t.drop()


class Table:
    """A written table: ``df`` reads it, ``drop()`` deletes it once nothing reads it any more. One that ``stays`` outlives
    the innermost ``scratch`` that it is written in."""

    def __init__(self, spark: SparkSession, df: DataFrame, name: str, stays: bool = False):
        self.spark, self.path = spark, new_path(spark, name)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        if scopes := _SCOPES[:-1] if stays else _SCOPES:
            scopes[-1].append(self)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def light(df: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """With a broadcast hint if the (written) table has at most ``most`` rows of ``BROADCAST_BYTES`` together: the driver holds it whole."""
    if df.count() > most:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def lower_ascii(col):
    """A-Z to a-z; all other characters stay."""
    return F.translate(col, UPPER, LOWER)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts go to Python ``rows`` at a time: a batch is held off the heap on both sides.

    Sets the session's Arrow batch size, unless it is set below that already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def row_key(*columns: str):
    """64 bits of the columns' values: rows that differ in none of them get one decision, whatever their ids are."""
    return F.xxhash64(*columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
