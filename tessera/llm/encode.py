"""Whole texts to ids with the tokenizers library, with a bounded memo of chunks.

A text is cut before each run of white space that follows other characters. Neither of the two
public pre-tokenizers has a piece that crosses such a place (each piece that is not white space
ends there, and what a run of white space becomes depends on what follows it), and no normalizer
joins characters over it. So the ids of a text are those of its chunks, and a chunk that has been
seen needs no second call. Texts that hold an added token's string, or white space beyond ASCII, go
to the library whole.

The memo is a hash table in numpy: all chunks of a batch are cut, hashed (to 128 bits) and looked up
at once over the Arrow buffer, and only chunks that it lacks are strings for a moment.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .windows import SPACE, Polynomial, texts

#: White_Space of Unicode, as the tokenizers' patterns take it.
_WS = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CHUNK = re.compile(rf"[{_WS}]*[^{_WS}]+|[{_WS}]+")
CHUNKS_KEPT = 500_000
_LONGEST = 64


class Encoder:
    """ids of whole texts; keep one for each process."""

    def __init__(self, path: str, kept: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        # a tokenizer that drops white space can do without it in its chunks
        self.bare = bool(spec["model"].get("end_of_word_suffix"))
        self.encode = Tokenizer.from_file(path).encode
        self.hashes = [Polynomial(11), Polynomial(12)]
        self.kept = kept
        self._clear()

    def _clear(self) -> None:
        self.table = ChunkTable(self.kept)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def batch(self, column: pa.Array, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column in order, and where each text's begin (n + 1 offsets); null is empty."""
        ids, sizes = [], []
        data, starts = texts(column)
        at = 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
            a, n = self._part(data[starts[at] : starts[to]], starts[at : to + 1] - starts[at])
            ids.append(a)
            sizes.append(n)
            at = to
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), np.concatenate([[0], np.cumsum(sizes)])

    def ids(self, text: str | None) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]

    def _part(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_texts = len(starts) - 1
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(n_texts, np.int64)
        raw = data.tobytes()
        whole = self._odd(data, starts, raw)
        space = SPACE[data]
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        opens = ~space & before if self.bare else space & ~before
        opens[starts[:-1][starts[:-1] < len(data)]] = True  # a text begins a chunk
        if self.bare:
            opens &= ~space
        first = np.flatnonzero(opens)
        if self.bare:
            closes = space & ~before
            closes[0] = False
            closes[starts[1:-1][starts[1:-1] < len(data)]] |= ~before[starts[1:-1][starts[1:-1] < len(data)]]
            last = np.append(np.flatnonzero(closes), [] if space[-1] else [len(data)]).astype(np.int64)
        else:
            last = np.append(first[1:], len(data))
        text = np.searchsorted(starts, first, "right") - 1
        if whole.any():
            keep = ~whole[text]
            first, last, text = first[keep], last[keep], text[keep]
        if self.table.used > self.kept:
            self._clear()
        entry = self.table.entries(*(h(data, first, last) for h in self.hashes), lambda k: self.library(raw[first[k] : last[k]].decode("utf-8")))
        size, from_ = self.table.size[entry].astype(np.int64), self.table.start[entry]
        per_text = np.bincount(text, size, n_texts).astype(np.int64)
        run = np.cumsum(size) - size
        out = self.table.pool[np.repeat(from_ - run, size) + np.arange(int(size.sum()))]
        if whole.any():
            parts, cut = [], np.concatenate([[0], np.cumsum(per_text)])
            for k in range(n_texts):
                parts.append(self.library(raw[starts[k] : starts[k + 1]].decode("utf-8")) if whole[k] else out[cut[k] : cut[k + 1]])
                per_text[k] = len(parts[-1])
            out = np.concatenate(parts)
        return out, per_text

    def _odd(self, data: np.ndarray, starts: np.ndarray, raw: bytes) -> np.ndarray:
        """Texts that the library gets whole."""
        out = np.zeros(len(starts) - 1, dtype=bool)
        places = [m.start() for m in _WIDE_SPACE.finditer(raw)]
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                places.append(at)
                at = raw.find(s, at + 1)
        if places:
            out[np.searchsorted(starts, places, "right") - 1] = True
        return out


#: White space beyond ASCII, in UTF-8.
_WIDE_SPACE = re.compile("|".join(chr(c) for c in [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]).encode())


class ChunkTable:
    """Entries by a 128-bit key, in open addressing: each has a run of ``pool``."""

    def __init__(self, kept: int):
        self.slots = 1 << (kept * 4 // 3).bit_length()
        self.key1, self.key2 = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.entry = np.full(self.slots, -1, np.int32)
        self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.pool, self.filled, self.used = np.zeros(1 << 18, "<u4"), 0, 0

    def entries(self, h1: np.ndarray, h2: np.ndarray, make) -> np.ndarray:
        """The entry of each key; ``make(k)`` gives the values of the k-th key where it is new."""
        out = np.full(len(h1), -1, np.int32)
        slot = (h1 & np.uint64(self.slots - 1)).astype(np.int64)
        open_ = np.arange(len(h1))
        missing = []
        while len(open_):
            s = slot[open_]
            e = self.entry[s]
            hit = (e >= 0) & (self.key1[s] == h1[open_]) & (self.key2[s] == h2[open_])
            out[open_[hit]] = e[hit]
            missing.append(open_[e < 0])
            open_ = open_[(e >= 0) & ~hit]
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
        missing = np.concatenate(missing) if missing else np.zeros(0, np.int64)
        if len(missing):
            order = missing[np.lexsort((missing, h2[missing], h1[missing]))]
            same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            new = np.concatenate([[True], ~same])
            given = self._add(h1[order[new]], h2[order[new]], [make(int(k)) for k in order[new]])
            out[order] = given[np.cumsum(new) - 1]
        return out

    def _add(self, h1: np.ndarray, h2: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
        n, size = len(values), np.fromiter(map(len, values), np.int64, len(values))
        total = int(size.sum())
        self.pool = _grown(self.pool, self.filled + total)
        self.start, self.size = _grown(self.start, self.used + n), _grown(self.size, self.used + n)
        if total:
            self.pool[self.filled : self.filled + total] = np.concatenate(values)
        entry = np.arange(self.used, self.used + n, dtype=np.int32)
        self.start[entry], self.size[entry] = self.filled + np.cumsum(size) - size, size
        self.filled += total
        self.used += n
        if self.used > self.slots * 3 // 4:
            old = np.flatnonzero(self.entry >= 0)
            k1, k2, e = self.key1[old], self.key2[old], self.entry[old]
            while self.used > self.slots * 3 // 4:
                self.slots *= 2
            self.key1, self.key2 = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
            self.entry = np.full(self.slots, -1, np.int32)
            self._place(k1, k2, e)
        self._place(h1, h2, entry)
        return entry

    def _place(self, h1: np.ndarray, h2: np.ndarray, entry: np.ndarray) -> None:
        slot, left = (h1 & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(h1))
        while len(left):  # of those that want one free slot the first gets it
            s = slot[left]
            free = self.entry[s] < 0
            _, first = np.unique(np.where(free, s, -1), return_index=True)
            won = np.zeros(len(left), dtype=bool)
            won[first] = True
            won &= free
            k = left[won]
            self.key1[slot[k]], self.key2[slot[k]], self.entry[slot[k]] = h1[k], h2[k], entry[k]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (self.slots - 1)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, len(a) * 3 // 2), a.dtype)
    out[: len(a)] = a
    return out


class _Memo(dict):
    def __init__(self, make, kept: int):
        self.make, self.kept = make, kept

    def __missing__(self, chunk: str):
        out = self.make(chunk)
        if len(self) < self.kept and len(chunk) <= _LONGEST:
            self[chunk] = out
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
