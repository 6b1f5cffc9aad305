"""Packing by power-of-two decomposition.

A document of L tokens (its end id included) is cut into pieces whose lengths are powers of two: as
many of ``longest`` as fit, then the binary digits of the rest, from the largest. Each piece is a
sequence of its own, and batches are drawn from buckets of equal lengths, so no sequence crosses a
document and none needs padding. Rows are made where the text is read: nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .encode import encoder


def lengths(tokens: int, longest: int = 2048) -> list[int]:
    """The pieces' lengths, largest first."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pieces(path: str, end_id: int, longest: int, with_ids: bool):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).batch
        for b in batches:
            every, cut = encode(b.column(1))
            raw, cut = every.tobytes(), (4 * cut).tolist()
            doc, start, length, crc, total, ids = [], [], [], [], [], []
            for k, i in enumerate(b.column(0).to_pylist()):
                all_ids, at = raw[cut[k] : cut[k + 1]] + end, 0
                n = len(all_ids) // 4
                for size in lengths(n, longest):
                    part = all_ids[4 * at : 4 * (at + size)]
                    for to, x in ((doc, i), (start, at), (length, size), (crc, zlib.crc32(part)), (total, n)):
                        to.append(x)
                    if with_ids:
                        ids.append(part)
                    at += size
            cols = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, longest: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset, bucket.

    ``longest`` has to be a power of two. A null or empty text is its end id alone. ``sequence_id``
    is unique (partition and row), ``offset`` is 0, ``bucket`` the log2 of the length; ``ids`` are
    little-endian unsigned 32-bit. Repeated rows are packed each for itself; a null id stays null.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest has to be a power of two")
    small_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_pieces(tokenizer, end_id, longest, with_ids), schema)
    return rows.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), (F.length(F.bin("length")) - 1).alias("bucket"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
