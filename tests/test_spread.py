"""Narrow tables with much work in each row: one file is not one task."""

from pyspark.sql import functions as F

from tessera import catalog
from tessera.sources.tables import spread


def _parts(spark, tmp_path, n):
    rows = spark.range(n).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), "id").alias("p_name"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_items_of_one_file_go_to_several_tasks(spark, tmp_path):
    d = _parts(spark, tmp_path, 12_000)
    tasks = catalog._items(spark, d).select("doc_id", F.spark_partition_id().alias("task"))
    assert tasks.agg(F.countDistinct("task")).first()[0] == 3
    assert tasks.agg(F.count("*"), F.countDistinct("doc_id")).first()[:] == (12_000, 12_000)
    assert catalog.extract_labels(spark, d).select(F.spark_partition_id().alias("task")).distinct().count() == 3


def test_spread_keeps_small_tables(spark):
    assert spread(spark.range(5_000)).count() == 5_000 and spread(spark.range(0)).count() == 0
