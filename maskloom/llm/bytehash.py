"""Vectorised rolling hashes over the bytes of many texts at once (numpy, one Arrow batch at a time).

A slice's hash is its polynomial in an odd base modulo 2^64, taken from prefix sums, then mixed.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n; kept per process, grown when a longer text comes."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(n, 1 << 16)
        grown = []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            out = np.full(size, base, U)
            out[0] = 1
            grown.append(np.multiply.accumulate(out))
        _powers[which] = grown[0], grown[1]
    return _powers[which]


class Rolling:
    """Hashes of arbitrary slices of one byte buffer."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _power_tables(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:len(data)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of ``width`` bytes."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of at most ``limit`` bytes of text (a longer text comes alone): (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = texts_of(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
            at = end
