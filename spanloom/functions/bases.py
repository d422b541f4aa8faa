"""Bases of Arrow string columns as flat NumPy arrays: digits, k-mer codes and codon numbers of whole batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Digit of each byte in the orders acgt (k-mers) and TCAG (codons); 4 for all other bytes.
_ACGT, _TCAG = np.full(256, 4, np.uint8), np.full(256, 4, np.uint8)
for _k, _c in enumerate("acgt"):
    _ACGT[[ord(_c), ord(_c.upper())]] = _k
for _k, _c in enumerate("TCAG"):
    _TCAG[[ord(_c), ord(_c.lower())]] = _k
_TCAG[[ord("U"), ord("u")]] = 0

#: Longest part by which windows are dealt out.
PART = 12


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(one byte a character, offsets) of a string column; nulls are empty, characters beyond ASCII become '?'."""
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    flat, offsets = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
    if len(flat) and flat.max() > 127:
        lead = (flat & 0xC0) != 0x80
        offsets = np.concatenate([[0], np.cumsum(lead)])[offsets]
        flat = flat[lead]
        flat = np.where(flat > 127, np.uint8(63), flat)
    return flat, offsets


#: Letters that a worker takes apart at once.
LETTERS = 1 << 20


def few_letters(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of LETTERS bytes of column `text` at most behind their first row: rows of long texts would fill a worker."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // LETTERS
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for i, j in pairwise(cut):
            yield batch.slice(i, j - i)


def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As `letters`, but with the code points of columns that hold more than ASCII."""
    flat, off = letters(column)
    if not (flat == 63).any():
        return flat, off
    whole = "".join(x or "" for x in column.to_pylist())
    return (flat, off) if whole.isascii() else (np.frombuffer(whole.encode("utf-32-le"), np.uint32), off)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the stretches of `size` letters from `start`, one stretch after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def pieces(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches from `start` to `end` in lower case as a string column."""
    got = flat[spans(start, end - start)]
    got = np.where((got >= 65) & (got <= 90), got + np.uint8(32), got)
    off = np.concatenate([[0], np.cumsum(end - start)])
    if got.dtype == np.uint8:
        return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(got))]).cast(pa.string())
    whole = got.astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([whole[i:j] for i, j in zip(off[:-1], off[1:], strict=True)], pa.string())


def least_parts(total: np.ndarray, down: np.ndarray, k: int) -> np.ndarray:
    """For each k-long window the smallest hash of the parts of PART letters, or half as many as it has, that it holds."""
    m = max(1, min(k // 2, PART))
    n = len(total) - m
    if n <= 0:
        return np.zeros(0, np.int64)
    low, width = hashes(total, down, np.arange(n), np.arange(n) + m), 1
    while width < k - m + 1:
        step = min(width, k - m + 1 - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low


def inside(offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts of all k-long windows that lie within one row."""
    n = int(offsets[-1])
    mark = np.zeros(n + 1, np.int64)
    size = np.diff(offsets)
    some = size >= k
    np.add.at(mark, offsets[:-1][some], 1)
    np.add.at(mark, offsets[:-1][some] + size[some] - k + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[:n] > 0)


def plain_windows(flat: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts of k-long windows of a, c, g and t only, each within one row."""
    at = inside(offsets, k)
    other = np.concatenate([[0], np.cumsum(_ACGT[flat] == 4)])
    return at[other[at + k] == other[at]]


def codes(flat: np.ndarray, at: np.ndarray, k: int | list[int]) -> np.ndarray:
    """Two bits a base of the k-mers that begin at `at`, or of the places in `k` behind it, first base highest; at most 31 bases."""
    d = _ACGT[flat].astype(np.int64)
    out = np.zeros(len(at), np.int64)
    for j in range(k) if isinstance(k, int) else k:
        out = out << 2 | d[at + j]
    return out


#: Base of the polynomials of `sums`, and its inverse modulo 2**64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def sums(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial of all letters, lower-cased, and the powers that shift a stretch of it to its start."""
    lower = np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)
    values = (lower.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    up, down = np.full(len(flat) + 1, np.uint64(_FACTOR)), np.full(len(flat) + 1, np.uint64(_INVERSE))
    up[0] = down[0] = 1
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(values * np.cumprod(up)[:-1], out=total[1:])
    return total, np.cumprod(down)


def hashes(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches from `start` to `end`, equal for equal letters; others may share one, so compare what meets."""
    h = (total[end] - total[start]) * down[start]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def strings(flat: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    """The windows in lower case as a string column."""
    lower = np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)
    if not len(at):
        return pa.array([], pa.string())
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(lower, k)[at])
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32)), pa.py_buffer(windows)])


def codon_numbers(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each place the codon that begins there, and that of the other strand that ends there: 0 to 63, or 64 if a base is unknown."""
    d = _TCAG[flat].astype(np.int64)
    x, y, z = d[:-2], d[1:-1], d[2:]
    known = (x < 4) & (y < 4) & (z < 4)
    forward = np.where(known, 16 * x + 4 * y + z, 64)
    backward = np.where(known, 16 * (z ^ 2) + 4 * (y ^ 2) + (x ^ 2), 64)
    return forward, backward
