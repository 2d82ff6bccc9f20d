"""Vectorised helpers over the UTF-8 bytes of Arrow string columns, used inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
# odd base of the polynomial hashes and its inverse modulo 2**64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, _U(base % (1 << 64)))
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give free memory back at the end of a task: the worker lives on beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of text, `rows` rows at most, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(size.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = run[start - 1] if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(run, before + most, "right"))))
            yield batch.slice(start, end - start)
            start = end
    release()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Words:
    """Words of a slice of texts: A-Z lower-cased, runs of digits, letters a-z and bytes over 0x7F.

    doc: row of each word; start, end: byte positions in `data` (lower-cased); hash: 64 bits
    each; first: words before each row, n + 1 entries. A word never crosses texts.
    """

    def __init__(self, column: pa.Array):
        raw, self.at = utf8(column)
        self.data = _FOLD[raw]
        inside = np.zeros(len(raw) + len(self.at), bool)  # a gap byte after every text
        rows = len(self.at) - 1
        shift = np.repeat(np.arange(rows), np.diff(self.at))
        inside[np.arange(len(raw)) + shift] = _WORD[self.data]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        gaps = self.at[1:] + np.arange(rows)  # places of the gap bytes
        self.doc = np.searchsorted(gaps, start)
        self.start, self.end = start - self.doc, end - self.doc
        self.first = np.searchsorted(self.doc, np.arange(rows + 1))
        n = len(raw)
        prefix = np.zeros(n + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * powers(INVERSE, n), out=prefix[1:])
        self.prefix, self.power = prefix, powers(BASE, n + 1)
        self.hash = self.head(np.arange(len(self.start)), self.end - self.start)

    def __len__(self) -> int:
        return len(self.start)

    def head(self, which: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hash of the first bytes of some words; the whole word's hash is its own."""
        start = self.start[which]
        whole = (self.end[which] - start == size).astype(_U)
        return mix((self.prefix[start + size] - self.prefix[start]) * self.power[start] + _U(2) * np.asarray(size).astype(_U) + whole)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words inside one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        value = np.zeros(len(at), _U)
        for j in range(k):
            value = value * _U(BASE) + self.hash[at + j]
        return at, mix(value + _U(k))
