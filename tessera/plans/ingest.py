"""Files or documents to a table of chunks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunking, documents
from tessera.sources import files, tables

KEYS = ["parent_group", "is_parent", "doc_hash"]


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "chars") -> DataFrame:
    """(id, book, section, page, text, doc_hash, importance_score, is_parent, parent_group, child_index, parent_title) of cleaned documents, without duplicates."""
    c = chunking.numbered(chunking.chunks(documents.cleaned(docs, text_col, keep_paragraphs=True), id_col, text_col, mode))
    child = c.select(F.col("doc_id").cast("string").alias("book"), F.col("section_title").alias("section"), "page", "text", F.col("importance").alias("importance_score"), F.lit(False).alias("is_parent"), "parent_group", "child_index", "parent_title")
    p = chunking.parents(c).select(F.col("book").cast("string"), "section", "page", "text", "importance_score", F.lit(True).alias("is_parent"), "parent_group", F.lit(None).cast("int").alias("child_index"), F.col("section").alias("parent_title"))
    both = child.unionByName(p).withColumn("doc_hash", T.content_hash(F.col("text")))
    both = both.withColumn("id", F.xxhash64("parent_group", "is_parent", "doc_hash", "page"))
    return documents.deduplicated(both)


def rows_of(found: DataFrame, folder: str, readers: dict | None = None) -> DataFrame:
    """Chunks of the files that ``found`` (as ``files.scan`` gives them) holds; a document is named by its path below ``folder``."""
    read = files.texts(found, readers).where("text IS NOT NULL")
    below = F.regexp_replace("path", f"^.*?{re.escape(re.sub('^[a-z0-9]+:/*', '/', folder).rstrip('/'))}/+", "")
    docs = read.groupBy(below.alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda r: r.text), "\n\n").alias("text"))
    return chunk_table(docs)


def embedded(rows: DataFrame, embed=None, dim: int = 256) -> DataFrame:
    embed = embed or V.hashing_embedder(dim)
    return rows.withColumn("emb", V.repair(embed(F.concat(F.lit("passage: "), "text")), dim).cast("array<float>"))


def ingest(spark: SparkSession, folder: str, table: str, recursive: bool = True, embed=None, dim: int = 256, readers: dict | None = None) -> DataFrame:
    """Read a folder's files, chunk them, embed only what the table lacks, and append it; returns the table."""
    rows = rows_of(files.scan(spark, folder, recursive), folder, readers)
    if tables._exists(spark, table):
        rows = documents.only_new(rows, spark.read.parquet(table))
    tables.append_new(spark, embedded(rows, embed, dim), table, KEYS)
    return spark.read.parquet(table)


def continuous(spark: SparkSession, folder: str, table: str, checkpoint: str, embed=None, dim: int = 256, readers: dict | None = None, files_at_once: int = 1000):
    """Ingest what lies in a folder and what comes, as a stream; returns the streaming query (it ends when all is read).

    A micro-batch writes its own partition ``batch`` of the table, chunks that no earlier batch has. A batch that
    was cut off runs again with the same files and overwrites its partition, so a restarted stream gives the rows of one that
    was never stopped.
    """
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(folder)

    def put(batch_files: DataFrame, batch: int) -> None:
        rows = rows_of(files.acceptable(batch_files.withColumn("ext", files.extension(F.col("path")))), folder, readers)
        if tables._exists(spark, table):
            rows = documents.only_new(rows, spark.read.parquet(table).where(F.col("batch") < batch))
        rows = tables.written(embedded(rows, embed, dim), "chunks")
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return found.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
