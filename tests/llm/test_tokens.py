import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, tokencount, tokenfile
from tessera.llm.encode import Encoder

from . import fixtures as X

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def whole(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_the_ids_of_whole_texts(path):
    encoder, lib = Encoder(path, kept=50), Tokenizer.from_file(path)
    for t in X.texts():
        assert encoder.ids(t).tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_batches_and_a_full_table():
    import pyarrow as pa

    lib, encoder = Tokenizer.from_file(BYTE), Encoder(BYTE, kept=200)
    texts = X.texts()[:20] * 2
    for _ in range(3):
        ids, cut = encoder.batch(pa.array(texts, pa.string()), most=500)
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


_LIB = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
_ENC = {p: Encoder(p) for p in (BYTE, WORD)}
_COUNT = tokencount.Counter(BYTE)
_ODD = st.lists(st.sampled_from([*" \n\t\r\x0b\x0c\x1c\x85\xa0  　ab'stlreZ.,!1", "\xe9", "é", "́", "\xdf", "Σ", "東", "\U0001f389", "<|endoftext|>"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(_ODD)
def test_odd_texts(text):
    for p in (BYTE, WORD):
        assert _ENC[p].ids(text).tolist() == _LIB[p].encode(text, add_special_tokens=False).ids
    assert _COUNT.count(text) == len(_LIB[BYTE].encode(text, add_special_tokens=False).ids)


def test_counts(spark):
    got = {r["doc_id"]: r for r in tokencount.token_counts(X.documents(spark), BYTE).collect()}
    for i, t, *_ in X.rows():
        n = len(whole(BYTE, t))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)
    assert tokencount.token_counts(X.empty(spark), BYTE).count() == 0


def test_counts_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs, BYTE).collect()}
    assert got == {r["doc_id"]: len(_LIB[BYTE].encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000, 4096])
def test_lengths(n):
    parts = packing.lengths(n)
    assert sum(parts) == n and all(x & (x - 1) == 0 and x <= 2048 for x in parts) and len(parts) <= n // 2048 + 11


def test_packing_loses_no_id(spark):
    rows = packing.pack(X.documents(spark), BYTE).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    for i, t, *_ in X.rows():
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        ids = whole(BYTE, t) + [1]
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in mine), "<u4").tolist() == ids
        at = 0
        for r in mine:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] == 1 << r["bucket"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
    assert packing.pack(X.empty(spark), BYTE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(X.documents(spark), BYTE, longest=1000)


def test_files(spark, tmp_path):
    docs = X.documents(spark)
    manifest = tokenfile.write_tokens(spark, docs, WORD, str(tmp_path / "t"), file_bytes=20_000, frame_bytes=2_000)
    assert manifest.count() > 2
    got = tokenfile.read_tokens(manifest).orderBy("start").collect()
    want, at = [], 0
    for i, t, *_ in sorted(X.rows(), key=lambda r: -1 if r[0] is None else r[0]):
        ids = whole(WORD, t) + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    # a few documents cost their frames only
    m = manifest.orderBy(F.desc("n_docs")).first()
    with open(m["path"], "rb") as f:
        raw = f.read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    some = [m["first_id"] if m["first_id"] >= 0 else 0, m["last_id"]]
    for i, ids in tokenfile.read_documents(m["path"], some):
        assert ids == whole(WORD, dict((r[0], r[1]) for r in X.rows())[i]) + [1]
    assert len(plain) == 2 * m["n_tokens"]
    # a flipped byte is noticed
    bad = tmp_path / "bad.zst"
    bad.write_bytes(raw[:5] + bytes([raw[5] ^ 1]) + raw[6:])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.read_documents(str(bad), [m["last_id"], m["first_id"], *range(60)])
    assert tokenfile.read_tokens(tokenfile.write_tokens(spark, X.empty(spark), WORD)).count() == 0


def test_many_files(spark, tmp_path):
    docs = spark.range(0, 4000, 1, 6).select((F.col("id") * F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(docs.where("doc_id = 100").crossJoin(spark.range(50).select()))
    manifest = tokenfile.write_tokens(spark, docs, WORD, str(tmp_path / "t"), file_bytes=500)
    files = manifest.orderBy("bucket").collect()
    assert len(files) >= 200 and [m["bucket"] for m in files] == list(range(len(files)))
    assert all(a["last_id"] < b["first_id"] for a, b in zip(files, files[1:]))
    # all files but that of the repeated id are near their size
    assert sorted(m["n_docs"] for m in files)[-2] <= 25
    assert sum(m["n_docs"] for m in files) == 4050
    got = tokenfile.read_tokens(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([i * i for i in range(4000)] + [100] * 50)


def test_ends_of_files():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "bytes"]) for x, n in (([1, 2, 2], [6, 3, 3]), ([2, 3], [9, 4]), ([], []), ([5], [30]), ([9], [1]))]
    assert [e for b in tokenfile._ends(10)(iter(batches)) for e in b.column(0).to_pylist()] == [2, 3, 5, 9]


def test_reader_skips_frames(tmp_path):
    path = tmp_path / "x.zst"
    with open(path, "wb") as f:
        w = tokenfile.Writer(f, frame_bytes=400, width=4)
        for i in range(100):
            w.add(i * 2, np.arange(i, i + 30, dtype="<u4").tobytes())
        w.close()
    import pyarrow.fs as fs

    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        r = tokenfile.Reader(f)
        assert [x.tolist() for _, x in r.documents(r.find(40))] == [list(range(20, 50))]
        assert r.read_frames == 1 and len(r.entries) > 20 and not len(r.find(41))
