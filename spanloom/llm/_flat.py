"""Vectorised text primitives over the flat byte buffer of an Arrow column.

A batch of texts is one uint8 array plus offsets. Words, word hashes and n-gram hashes come from
a handful of NumPy passes over that buffer, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Values that are summed up at once, and values of the longest span that has a polynomial.
CHUNK, LONG = 1 << 20, 511
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: Random odd 64-bit value of each byte.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _class(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


#: Bytes of words: ASCII letters and digits, and all bytes of other characters.
ALNUM = _class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Everything but ASCII white space.
NON_SPACE = _class(lambda b: not (b == 32 or 9 <= b <= 13))


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        if pa.types.is_string(column.type):
            column = column.cast(pa.binary())
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(buf: np.ndarray, off: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole rows of about `limit` bytes: (first row, end row, bytes, offsets)."""
    i, rows = 0, len(off) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse: one bounded table for every worker."""
    if len(_POWERS[0]) < 2:
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(CHUNK + LONG + 1, U64(base))
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xA0761D6478BD642F)
    return h ^ (h >> U64(32))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each pair.

    Spans of up to LONG values have a polynomial modulo 2**64, mixed; some regular strings of more
    values have equal polynomials for every base, so longer spans are hashed byte by byte. The
    values are taken CHUNK at a time, which bounds the tables whatever the length of the text.
    """
    size = end - start
    out = np.zeros(len(start), U64)
    short = np.flatnonzero(size <= LONG)
    up, down = powers()
    part = start[short] // CHUNK
    if len(part) and part[0] != part[-1] and (part[1:] < part[:-1]).any():
        order = np.argsort(part, kind="stable")
        short, part = short[order], part[order]
    cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        mine = short[i:j]
        base = int(part[i]) * CHUNK
        x = values[base : base + CHUNK + LONG]
        total = np.zeros(len(x) + 1, U64)
        np.cumsum(x * up[: len(x)], out=total[1:])
        out[mine] = mix((total[end[mine] - base] - total[start[mine] - base]) * down[start[mine] - base])
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(values[start[k] : end[k]].tobytes())
    return out


def words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes of class `inside`; runs never cross rows."""
    w = inside[buf]
    n = len(buf)
    heads = off[:-1][off[:-1] < n]
    edge = np.zeros(n + 1, bool)
    edge[heads] = True
    edge[n] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:n]
    last = w.copy()
    if n:
        last[:-1] &= ~w[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def ngrams(word_hash: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of `n` words of one group."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(group[:m] == group[n - 1 :])
    h = np.zeros(m, U64)
    for k in range(n):
        h = h * U64(0x9FB21C651E98DF25) + word_hash[k : k + m]
    return at, mix(h[at])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
