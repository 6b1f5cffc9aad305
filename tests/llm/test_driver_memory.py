import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import bitmap, common, linededup, neardup


def _sets(spark):
    rows = [(bytes([i]), 3, [1, 2 + i % 2, 10 + i]) for i in range(30)]
    return spark.createDataFrame(rows, "key binary, n int, hashes array<long>").localCheckpoint()


def test_class_maps_stay_on_the_driver_one_at_a_time(spark, monkeypatch):
    size, sets = 16 << 20, _sets(spark)
    monkeypatch.setattr(bitmap, "merged", lambda rows, bits, cells: np.zeros(size, np.uint8))
    neardup._class_maps(spark, sets, 28)  # what is imported and cached at first doesn't count
    tracemalloc.start()
    try:
        maps = neardup._class_maps(spark, sets, 28)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(maps) == len(neardup.CLASSES) and peak < 2.5 * size


def test_maps_are_destroyed_once_their_tables_are_written(spark, monkeypatch):
    made, real = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: made.append(real(x)) or made[-1])
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n {i % 3}") for i in range(9)], "doc_id long, text string")
    found = neardup.near_duplicates(spark, docs)
    assert found.count() == 9 and len(made) == 1 + len(neardup.CLASSES)
    assert not any(b._jbroadcast.isValid() for b in made)


def test_few_wide_rows_are_not_broadcast(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    wide = spark.range(40).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert not hinted(common.light(wide)) and hinted(common.light(wide.select("id")))


def test_kept_lines_meet_in_a_shuffle(spark):
    """The tables of roots and kept lines grow with the texts: the driver never holds them."""
    docs = spark.createDataFrame([(i, f"a line that all of the documents share {i % 2}\nand another one, of its own, {i * 7919}") for i in range(20)], "doc_id long, text string")
    out = linededup.judged(spark, docs)
    assert "rightHint=(strategy=broadcast)" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 40 and out.where("kept").count() < 40
