"""The operators' queries against their SQL, and the laws of those that SQL can't say, over the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_sharding_laws(spark):
    rows = queries.op1_kd_shards(spark, SF).collect()
    sizes = {r.doc_id: len((r.text or "").encode()) + 16 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.size for r in rows} == sizes and {r.shard for r in rows} == set(range(40))
    for s in range(40):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_packing_covers_each_document_once(spark):
    rows = queries.op4_packing(spark, SF)
    ends = rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.max(F.col("start") + F.col("length")).alias("end"))
    assert ends.where("n <> all OR end <> all").count() == 0
    assert ends.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
