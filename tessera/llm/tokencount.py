"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

The symbols of a pre-token form a doubly linked list and all adjacent pairs that have a rank lie in
a heap. The lowest-ranked pair (the leftmost of equals) is popped; if its symbols are still as they
were, they merge, and the pairs with the new symbol's neighbours are pushed. The count is the number
of initial symbols less the merges. n symbols take O(n log n) steps, however long a pre-token is.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .encode import CHUNK, CHUNKS_KEPT, _Memo

#: GPT-2's published pre-tokenizer pattern (a fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols that are left of ``symbols`` after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    sym, left, right = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue  # one of the two has merged meanwhile
        sym[i], sym[j] = a + b, ""
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get((sym[i], sym[k]))) is not None:
                heapq.heappush(heap, (r, i, sym[i], sym[k]))
        h = left[i]
        if h >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
            heapq.heappush(heap, (r, h, sym[h], sym[i]))
        merges += 1
    return n - merges


class Counter:
    """Token counts of whole texts under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, kept: int = CHUNKS_KEPT):
        spec = json.load(open(path, encoding="utf-8"))
        merges = spec["model"]["merges"]
        self.ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): r for r, m in enumerate(merges)}
        self.symbol = byte_symbols()
        special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special = special
        self.piece = _Memo(self._piece, kept)
        self.memo = _Memo(lambda c: sum(map(self.piece.__getitem__, PIECES.findall(c))), kept)

    def _piece(self, piece: str) -> int:
        return merged_count([self.symbol[b] for b in piece.encode("utf-8", "surrogatepass")], self.ranks)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):  # each is one token; what lies between is a text of its own
            return len(self.cut.findall(text)) + sum(self.plain(x) for x in self.cut.split(text))
        return self.plain(text)

    def plain(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, CHUNK.findall(text)))


_COUNTERS: dict[str, Counter] = {}


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        count = _COUNTERS[path].count
        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row; null and empty texts have 0. No shuffle."""
    small_batches(docs.sparkSession)
    size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), size.alias("n_bytes"))
    return rows.mapInArrow(_counts(tokenizer), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
