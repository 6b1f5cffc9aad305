"""Token ids on disk: independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, each holding the ids of whole documents (about ``frame_bytes``
of them; a longer document has a frame to itself), then a skippable frame with the document index,
then the seek table of the public seekable format: for each frame its compressed and decompressed
size and the low 32 bits of the XXH64 of its content. Any zstandard reader decompresses the file; a
reader that wants a few documents reads the two tables and then only the frames that hold them.

Files are ranges of doc_id. Texts become ids where they are read, so the shuffle moves ids (two
bytes each where the vocabulary allows it). A file is written under a name of the attempt and then
renamed: a task that runs again, or twice, leaves one whole file.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, new_path, small_batches
from .encode import encoder

#: Fixed values of the public formats.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_CHECKSUMS = 0x80
#: The most tasks that read files at once; beyond it a task reads several.
READERS = 20_000
_NO_ID = -(1 << 63)


def _sum32(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes one file; documents come in ascending order of id. Memory is one frame and the index."""

    def __init__(self, sink, frame_bytes: int = 1 << 18, level: int = 3, width: int = 4):
        self.sink, self.frame_bytes, self.width = sink, frame_bytes, width
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.held_bytes, self.entries = [], 0, []
        self.ids, self.counts, self.frames, self.n_tokens = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held_bytes + len(ids) > self.frame_bytes:
            self._frame()
        self.held.append(ids)
        self.held_bytes += len(ids)
        self.ids.append(_NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids) // self.width)
        self.frames.append(len(self.entries))
        self.n_tokens += len(ids) // self.width

    def _frame(self) -> None:
        raw = b"".join(self.held)
        out = self.zstd.compress(raw)
        self.sink.write(out)
        self.entries.append((len(out), len(raw), _sum32(raw)))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        index = np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes() + np.array(self.frames, "<u4").tobytes()
        body = struct.pack("<IB", len(self.ids), self.width) + zstandard.ZstdCompressor(level=3).compress(index)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.entries.append((len(body) + 8, 0, _sum32(body)))
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), _CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)


class Reader:
    """Reads one file by its tables; ``source`` has size(), seek() and read()."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or not flags & _CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table = self._at(end - 9 - 12 * n, 12 * n)
        self.entries = [struct.unpack_from("<III", table, 12 * k) for k in range(n)]
        self.offsets = np.concatenate([[0], np.cumsum([e[0] for e in self.entries], dtype=np.int64)])
        size, _, check = self.entries[-1]
        body = self._at(int(self.offsets[n - 1]), size)[8:]
        if _sum32(body) != check:
            raise ValueError("document index: wrong checksum")
        docs, self.width = struct.unpack_from("<IB", body)
        index = zstandard.ZstdDecompressor().decompress(body[5:], max_output_size=16 * docs + 1)
        self.ids = np.frombuffer(index, "<i8", docs)
        self.counts = np.frombuffer(index, "<u4", docs, 8 * docs).astype(np.int64)
        self.frames = np.frombuffer(index, "<u4", docs, 12 * docs)
        self.read_frames = 0

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        size, full, check = self.entries[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), size), max_output_size=max(full, 1))
        if len(raw) != full or _sum32(raw) != check:
            raise ValueError(f"frame {k}: wrong checksum")
        self.read_frames += 1
        return raw

    def documents(self, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(position, ids) of all documents, or of those at ``rows`` (ascending); frames are read once."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        starts = np.concatenate([[0], np.cumsum(self.counts)])
        first = np.searchsorted(self.frames, np.arange(len(self.entries)))
        now, raw = -1, b""
        for r in rows:
            if (k := int(self.frames[r])) != now:
                now, raw = k, self.frame(k)
            at = int(starts[r] - starts[first[k]])
            yield int(r), np.frombuffer(raw, f"<u{self.width}", int(self.counts[r]), at * self.width)

    def find(self, doc_id: int) -> np.ndarray:
        """Positions of a document's rows."""
        return np.arange(np.searchsorted(self.ids, doc_id), np.searchsorted(self.ids, doc_id, "right"))


def _open(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _ends(file_bytes: int):
    """The last id of each file, from rows (doc_id, bytes) in order of id. Rows of one id are never parted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, one, last = 0, 0, None  # bytes of the file's whole ids; bytes of the id that is being read

        for b in batches:
            out = []
            for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != last:
                    if last is not None and (held := held + one) + n > file_bytes:
                        out.append(last)
                        held = 0
                    last, one = i, 0
                one += n
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["last"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64())], ["last"])

    return run


def _cuts(spark: SparkSession, rows: DataFrame, file_bytes: int) -> np.ndarray:
    """Ids that end all files but the last: a long for each file, found by tasks that each cut a range of ids of some eight files."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("bytes")
    sizes = Table(spark, rows.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), size), "text-sizes")
    total = sizes.df.agg(F.sum("bytes")).first()[0] or 0
    if total <= file_bytes:
        return np.array([], dtype=np.int64)
    ranges = sizes.df.repartitionByRange(math.ceil(total / (8 * file_bytes)), "doc_id").sortWithinPartitions("doc_id")
    ends = sorted(r["last"] for r in ranges.mapInArrow(_ends(file_bytes), "last long").collect())
    sizes.drop()
    return np.array(ends[:-1], dtype=np.int64)


def _encode(path: str, end_id: int, width: int, cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).batch, end_id.to_bytes(width, "little")
        for b in batches:
            every, cut = encode(b.column(1))
            raw, cut = every.astype(f"<u{width}").tobytes(), (width * cut).tolist()
            ids = [raw[lo:hi] + end for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            bucket = np.searchsorted(cuts.value, b.column(0).fill_null(_NO_ID).to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bucket), pa.array(ids, pa.binary())], ["doc_id", "bucket", "ids"])

    return run


_MANIFEST = "bucket int, path string, n_docs long, n_tokens long, first_id long, last_id long"


def _write(folder: str, frame_bytes: int, level: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        now, writer, sink, temp = None, None, None, ""

        def done() -> pa.RecordBatch:
            writer.close()
            sink.close()
            store.move(temp, f"{base}/tokens-{now:06d}.zst")
            row = {"bucket": now, "path": f"{folder}/tokens-{now:06d}.zst", "n_docs": len(writer.ids), "n_tokens": writer.n_tokens, "first_id": writer.ids[0], "last_id": writer.ids[-1]}
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for b in batches:
            for doc, bucket, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    if writer:
                        yield done()
                    now, temp = bucket, f"{base}/.attempt-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temp)
                    writer = Writer(sink, frame_bytes, level, width)
                writer.add(doc, ids)
        if writer:
            yield done()

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, file_bytes: int = 32 << 20, frame_bytes: int = 1 << 18, level: int = 3) -> DataFrame:
    """Write all rows' ids, each with ``end_id``, in ascending order of doc_id; returns the manifest.

    The manifest (a row per file, in order of ``bucket``) is written beside the files. Null texts
    have their end id only; null ids come first; rows of one id go by their ids' bytes and stay in one file. An empty
    table writes no file. ``file_bytes`` is of text and index (16 bytes a row); a longer text has a file and a frame to itself, and is encoded whole.
    """
    small_batches(spark)
    folder = folder or new_path(spark, "tokens")
    width = 2 if max(_vocabulary(tokenizer), end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cuts = _cuts(spark, rows, file_bytes)
    ids = rows.mapInArrow(_encode(tokenizer, end_id, width, spark.sparkContext.broadcast(cuts)), "doc_id long, bucket int, ids binary")
    # a partition for each file, by its number: hashed numbers would put several files into one task
    placed = ids.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    return Table(spark, placed.select("doc_id", "bucket", "ids").mapInArrow(_write(folder, frame_bytes, level, width), _MANIFEST), "manifest").df


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            store, name = _open(path)
            with store.open_input_file(name) as f:
                r = Reader(f)
                at = start + np.concatenate([[0], np.cumsum(r.counts)])
                for lo in range(0, len(r.ids), 4096):
                    hi = min(lo + 4096, len(r.ids))
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in r.documents(np.arange(lo, hi))]
                    doc = pa.array([None if i == _NO_ID else i for i in r.ids[lo:hi].tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([doc, pa.array(at[lo:hi]), pa.array(r.counts[lo:hi]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files; every checksum is verified."""
    start = (F.sum("n_tokens").over(W.orderBy("bucket")) - F.col("n_tokens")).alias("start")  # a row per file
    files = max(1, manifest.count())
    # a given number of partitions isn't coalesced, however few bytes the manifest has: a task for each few files
    placed = manifest.select("path", "bucket", start).repartitionByRange(min(files, READERS), "bucket")
    return placed.select("path", "start").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(path: str, doc_ids: list[int]) -> list[tuple[int, list[int]]]:
    """(doc_id, ids) of the requested documents in one file; only their frames are decompressed."""
    store, name = _open(path)
    with store.open_input_file(name) as f:
        r = Reader(f)
        rows = np.unique(np.concatenate([r.find(i) for i in doc_ids] or [np.array([], int)]).astype(int))
        return [(int(r.ids[k]), ids.tolist()) for k, ids in r.documents(rows)]
