"""Byte-level BPE over flat buffers: vectorised pre-tokenisation, each distinct piece encoded once a block.

The pieces are those of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
found from runs of character classes. The vocabulary is a tokenizers JSON file, whose path is a
parameter; tests compare all ids with that library's own.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np

from spanloom.llm import _flat

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Characters with the property White_Space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that go with an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[_WHITE] = SPACE
    return out


def pieces(chars: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Start of each piece in code points `chars`; `heads` are the starts of non-empty texts."""
    n = len(chars)
    cls = _classes()[chars]
    flag = np.ones(n, bool)
    flag[1:] = cls[1:] != cls[:-1]
    flag[heads] = True
    start = np.flatnonzero(flag)
    end = np.append(start[1:], n)
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    kind = cls[start]
    # White space before other text keeps its last character apart; a plain blank joins what follows.
    before = end[(kind == SPACE) & ~head[end]]
    flag[before - 1] = True
    flag[before[chars[before - 1] == 32]] = False
    # A lone apostrophe that no blank precedes takes a short ending of the letters after it.
    lone = np.flatnonzero((kind == OTHER) & (end - start == 1) & (chars[start] == 39) & flag[start] & ~head[end])
    lone = lone[kind[lone + 1] == LETTER] if len(lone) else lone
    for at, stop in zip(start[lone].tolist(), end[lone + 1].tolist(), strict=True):
        after = "".join(map(chr, chars[at + 1 : min(at + 3, stop)].tolist()))
        size = next((len(x) for x in _ENDINGS if after.startswith(x)), 0)
        if size:
            flag[at + 1] = False
            if at + 1 + size < stop:
                flag[at + 1 + size] = True
    return np.flatnonzero(flag)


def _same(buf: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> bool:
    """Whether each piece has the bytes of piece like[k]."""
    size = end - start
    if (size != size[like]).any():
        return False
    within = np.arange(len(buf)) - np.repeat(start, size)
    return bool((buf == buf[np.repeat(start[like], size) + within]).all())


class Encoder:
    """Ids of texts by the vocabulary of a tokenizers JSON file of kind byte-level BPE."""

    LIMIT = 300_000

    def __init__(self, path: str, added: bool = True) -> None:
        """With `added` false, added tokens written out in a text are text like any other."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        every = spec.get("added_tokens", [])
        if any(x.get(k) for x in every for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that take in what is beside them are not known here")
        special = {x["content"] for x in every}
        self._added = {x["content"].encode(): [x["id"]] for x in every} if added else {}
        self._find = re.compile(b"|".join(re.escape(x) for x in sorted(self._added, key=len, reverse=True))) if self._added else None
        # Byte-level vocabularies write a byte as itself if printable, else as the next free character from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._bpe = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._known: dict[bytes, list[int]] = dict(self._added)

    def _occurrences(self, data: bytes, off: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the added tokens written out in the texts: each is one id, whatever stands beside it."""
        if self._find is None or not self._find.search(data):
            return []
        return [m.span() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) for m in self._find.finditer(data, a, z)]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block one after another, number of ids of each text)."""
        rows = len(off) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        data = buf.tobytes()
        chars = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        heads = off[:-1]
        apart = np.array(self._occurrences(data, off), np.int64).reshape(-1, 2)
        heads = np.unique(np.concatenate([heads, apart.ravel()]))
        heads = heads[heads < len(buf)]
        start = at[pieces(chars, np.searchsorted(at, heads))]
        if len(apart):
            k = np.searchsorted(apart[:, 0], start, "right") - 1
            start = start[(k < 0) | (start == apart[k, 0]) | (start >= apart[k, 1])]
        end = np.append(start[1:], len(buf))
        _, first, which = np.unique(_flat.span_hashes(_flat.BYTE_VALUES[buf], start, end), return_index=True, return_inverse=True)
        if not _same(buf, start, end, first[which]):
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(data[s:e], len(number)) for s, e in zip(start.tolist(), end.tolist(), strict=True)])
            first = np.unique(which, return_index=True)[1]
        if len(self._known) > self.LIMIT:
            self._known = dict(self._added)
        known, lists = self._known, []
        for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True):
            piece = data[s:e]
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = self._bpe.encode_ordinary(piece.decode("utf-8", "replace"))
            lists.append(ids)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))
        head = np.cumsum(size) - size
        count = size[which]
        total = int(count.sum())
        ids = flat[np.repeat(head[which] - (np.cumsum(count) - count), count) + np.arange(total)]
        row = np.searchsorted(off, start, "right") - 1
        return ids, np.bincount(row, count, rows).astype(np.int64)


@cache
def encoder(path: str, added: bool = True) -> Encoder:
    """One encoder for each vocabulary in each worker process."""
    return Encoder(path, added)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
