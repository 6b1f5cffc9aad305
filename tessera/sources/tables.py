"""Tables of the library: loading, and appends that keep keys unique."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_id(table: DataFrame, value, id_col: str = "id") -> DataFrame:
    """One row; the filter reaches the scan."""
    return table.where(F.col(id_col) == value)


def spread(rows: DataFrame, each: int = 5_000) -> DataFrame:
    """``rows`` (of a stored table) dealt to tasks of about ``each`` rows: for narrow tables, few files of which hold much work."""
    n = -(-rows.count() // each)
    return rows.repartition(n) if n > 1 else rows


def append_new(spark: SparkSession, rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table lacks; of rows with one key in the batch, one."""
    new = rows.dropDuplicates(keys)
    if _exists(spark, path):
        old = spark.read.parquet(path).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        new = new.join(old, cond, "left_anti")
    new.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = rows.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_RUN = f"steps-{uuid.uuid4().hex[:12]}"
_OPEN: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the cluster's own cleaning of the folder remains
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below ``spark.checkpoint.dir``, read back: what reads it holds neither its plan nor its cache.

    For short intermediate results that several steps read."""
    path = step_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def step_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. What is there is deleted when the driver ends; on a cluster the folder has to be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    path = f"{base.rstrip('/')}/{_RUN}"
    if path not in _OPEN:
        _OPEN.add(path)
        atexit.register(_delete, spark, path)
    return f"{path}/{name}-{uuid.uuid4().hex[:8]}"


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts go to Python ``rows`` at a time, not 10,000: a worker's memory is that of a batch, however large a partition is.

    Sets the session's Arrow batch size, unless it is set below that already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
