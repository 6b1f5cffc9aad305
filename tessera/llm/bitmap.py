"""Bit maps over all rows: each partition sets bits, equal segments are united by a shuffle, the driver gets 2^bits bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_U = np.uint64
SEGMENT = 1 << 16  # bytes of the map in a row
_ROWS = "segment int, bits binary"


def _row(segment: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([bits.tobytes()])], ["segment", "bits"])


def _of_task(cells: Callable[[pa.RecordBatch], np.ndarray], held: int = 1 << 22):
    def out(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell = np.unique(np.concatenate(parts))
        segment = (cell >> _U(3)) // _U(SEGMENT)
        edges = np.append(np.flatnonzero(np.diff(segment, prepend=segment[:1] + _U(1))), len(segment))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = np.zeros(SEGMENT * 8, bool)
            part[(cell[lo:hi] % _U(SEGMENT * 8)).astype(np.int64)] = True
            yield _row(int(segment[lo]), np.packbits(part, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for b in batches:
            parts.append(cells(b).astype(np.uint64))
            if sum(map(len, parts)) > held:
                yield from out(parts)
                parts.clear()
        if sum(map(len, parts)):
            yield from out(parts)

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their segment: one united row for each."""
    now, bits = None, None
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(x, np.uint8)
            if k != now:
                if now is not None:
                    yield _row(now, bits)
                now, bits = k, x.copy()
            else:
                bits |= x
    if now is not None:
        yield _row(now, bits)


def merged(rows: DataFrame, bits: int, cells: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """A map of 2^bits bits (a segment at least) with the ``cells`` of all batches of ``rows`` set."""
    each = rows.mapInArrow(_of_task(cells), _ROWS)
    each = each.repartition("segment").sortWithinPartitions("segment").mapInArrow(_united, _ROWS)
    out = np.zeros(max(1 << max(bits - 3, 0), SEGMENT), np.uint8)
    for r in each.toLocalIterator():
        out[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def has(bitmap: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bitmap[(cell >> _U(3)).astype(np.int64)] >> (cell & _U(7)).astype(np.uint8)) & 1 == 1
