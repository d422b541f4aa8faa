"""Sequences packed at two bits a base, with what is no plain base beside them: a table of a quarter of the size that many jobs read again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.functions import bases

_LETTERS = np.frombuffer(b"acgt", np.uint8)


def packed(seqs: DataFrame) -> DataFrame:
    """(seqnum, length, codes, other_start, other) of sequences (seqnum, seq), lower-cased: two bits a base, first base in the lowest bits.

    Stretches of other letters are kept apart with their starts, and count as a in the codes. Null sequences stay null.
    """
    kind = seqs.schema["seqnum"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1).to_pylist():
                if text is None:
                    rows.append((None, None, None, None))
                    continue
                # One byte a character for the codes; other characters come from the text itself.
                flat, _ = bases.letters(pa.array([text]))
                digit = bases._ACGT[flat]
                odd = digit > 3
                edge = np.flatnonzero(np.diff(np.concatenate([[0], odd.astype(np.int8), [0]])))
                quads = np.append(np.where(odd, 0, digit), np.zeros(-len(digit) % 4, np.uint8)).reshape(-1, 4)
                codes = (quads << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes()
                rows.append((len(text), codes, edge[::2].tolist(), [_lower(text[s:e]) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["seqnum", "length", "codes", "other_start", "other"])

    return seqs.select("seqnum", "seq").mapInArrow(run, f"seqnum {kind}, length long, codes binary, other_start array<long>, other array<string>")


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def unpacked(table: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """(seqnum, seq) of packed sequences, or of their letters from `start` to `end` (0-based, half-open): only those are decoded."""
    kind = table.schema["seqnum"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, codes, starts, other in zip(*(batch.column(c).to_pylist() for c in ("length", "codes", "other_start", "other")), strict=True):
                if n is None:
                    out.append(None)
                    continue
                x, y = min(start, n), n if end is None else max(min(end, n), min(start, n))
                quads = np.frombuffer(codes, np.uint8)[x // 4 : -(-y // 4)]
                text = _LETTERS[(quads[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3].ravel()[x % 4 : x % 4 + y - x].tobytes().decode()
                for s, letters in zip(starts, other, strict=True):
                    p, q = max(s, x), min(s + len(letters), y)
                    if p < q:
                        text = text[: p - x] + letters[p - s : q - s] + text[q - x :]
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("seqnum"), pa.array(out, pa.string())], names=["seqnum", "seq"])

    return table.select("seqnum", "length", "codes", "other_start", "other").mapInArrow(run, f"seqnum {kind}, seq string")


def write_encoded(seqs: DataFrame, path: str) -> None:
    packed(seqs).write.mode("error").parquet(path)


def read_encoded(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    return unpacked(spark.read.parquet(path), start, end)
