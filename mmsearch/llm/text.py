"""Vectorised words and shingles of whole texts, for use inside Arrow tasks.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``. Each word gets a 64-bit tabulation
hash, each run of n words a 64-bit hash of its word hashes. Texts are handled in chunks of about
1 MB, so a task's memory follows the chunk (or the longest single text), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    with np.errstate(over="ignore"):
        z = x + _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


_SPAN = 64
_TABLE = splitmix(np.arange(256 * _SPAN, dtype=np.uint64) + _U(0x51ED))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _spans(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets) of row runs holding about ``limit`` bytes each."""
    raw, at = _spans(batch.column(text))
    row = 0
    while row < len(at) - 1:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, stop, raw[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


class Words:
    """Words of a chunk: hash, row within the chunk, and byte span, in text order."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = False):
        raw = _LOWER[raw] if lower else raw
        self.raw, self.at, self.rows = raw, at, len(at) - 1
        inside = np.zeros(len(raw) + 1, bool)
        inside[:-1] = ~_SPACE[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[at] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | first[1:]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.inside = inside
        self.count = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        total = int(size.sum())
        head = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(total, dtype=np.int32) - np.repeat(head.astype(np.int32), size)  # a chunk or text is under 2 GB
        cell = _TABLE[(place & (_SPAN - 1)) * 256 + self.raw[self.inside[:-1]]]
        with np.errstate(over="ignore"):
            if size.max() > _SPAN:
                cell = cell * ((place // _SPAN).astype(np.uint64) * _U(2) + _U(1))
                cell = np.where(place >= _SPAN, splitmix(cell), cell)
            return splitmix(np.add.reduceat(cell, head) + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of first word) of every run of n words inside one row."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[n - 1 :] == self.row[: len(h) - n + 1])
        with np.errstate(over="ignore"):
            acc = h[: len(h) - n + 1].copy()
            for j in range(1, n):
                acc *= _U(0xA0761D6478BD642F)
                acc += h[j : len(h) - n + 1 + j]
            return splitmix(acc + _U(n))[at], at

    def shingle_sets(self, n: int) -> list[np.ndarray]:
        """Per row the sorted distinct n-word shingles; a row of 1 to n-1 words has its whole sequence as its one shingle."""
        grams, at = self.grams(n)
        row = self.row[at]
        cut = np.searchsorted(row, np.arange(self.rows + 1))
        out = []
        for r in range(self.rows):
            if cut[r] < cut[r + 1]:
                s = np.sort(grams[cut[r] : cut[r + 1]])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif self.count[r]:
                with np.errstate(over="ignore"):
                    acc = _U(0)
                    for x in self.hash[self.first[r] : self.first[r + 1]]:
                        acc = acc * _U(0xA0761D6478BD642F) + x
                    out.append(splitmix(np.array([acc + _U(self.count[r])], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending 64-bit values as byte planes of their differences: the empty high planes cost a shuffle next to nothing."""
    d = np.diff(sorted_values.astype(np.uint64), prepend=_U(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Unsorted values as byte planes."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(blob: bytes, dtype) -> np.ndarray:
    wide = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(wide, -1).T).view(dtype).ravel()
