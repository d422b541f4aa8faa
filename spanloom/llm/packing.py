"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Pieces of one size are interchangeable, so the packing is computed on the histogram of sizes (at
most `capacity` numbers) and not on the pieces: a segment tree over remaining capacities finds the
tightest open sequence in logarithmic time for a whole run of equal pieces. The plan it gives is
the one that piece-by-piece best-fit decreasing gives, its size depends on the capacity only, and
each piece finds its place in it from its rank among the pieces of its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import _flat
from spanloom.llm._base import free_names, materialize, table
from spanloom.llm.tokens import default_path, encoder

#: Parts of a size class that are ranked apart, so that no task ranks a whole class.
PARTS = 512


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf counts the open bins that have it left."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << (capacity + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, bins: int) -> None:
        i = remaining + self.leaves
        while i:
            self.count[i] += bins
            i >>= 1

    def tightest(self, size: int) -> int | None:
        """Smallest remaining capacity of an open bin that holds `size`."""
        i = size + self.leaves
        if self.count[i]:
            return size
        while i > 1:  # up to the first right sibling that is not empty, then down its left edge
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


@dataclass
class Plan:
    """Rows: pieces of `size` from rank `first` on go `per` to a bin, to bins from `bin` on, from `offset` on."""

    size: np.ndarray
    first: np.ndarray
    per: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Rows are in order of size descending and rank, so one search over a joint key finds the row.
        low = np.searchsorted(-self.size, -size, "left")
        high = np.searchsorted(-self.size, -size, "right")
        while (wide := high - low > 1).any():
            mid = (low + high) // 2
            right = wide & (self.first[np.minimum(mid, len(self.first) - 1)] <= rank)
            low, high = np.where(right, mid, low), np.where(wide & ~right, mid, high)
        k = rank - self.first[low]
        return self.bin[low] + k // self.per[low], self.offset[low] + k % self.per[low] * size


def best_fit_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing of histogram[size] pieces of each size in 1..capacity."""
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[list[int]]] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def leave(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_bins.setdefault(remaining, []).append([first, n])
            tree.add(remaining, n)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -n)
            per = room // size
            full = min(n, left // per)
            over = min(per, left - full * per) if full < n else 0
            if full:
                rows.append((size, rank, per, first, capacity - room))
                leave(room - per * size, first, full)
            if over:
                rows.append((size, rank + full * per, per, first + full, capacity - room))
                leave(room - over * size, first + full, 1)
            used = full + (over > 0)
            leave(room, first + used, n - used)
            left -= full * per + over
            rank += full * per + over
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*cols, bins)


def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, start, length) of texts of `counts` ids; only longer ones are cut, the first piece may be shorter."""
    parts = -(-counts // capacity)
    row = np.repeat(np.arange(len(counts)), parts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    head = (counts - 1) % capacity + 1
    start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
    return row, piece, start, np.where(piece == 0, head[row], capacity)


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids) of every document; `ids` are little-endian unsigned 32-bit."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            buf, off = _flat.buffer_of(batch.column(1))
            for i, j, b, o in _flat.blocks(buf, off, 1 << 21):
                ids, counts = enc.encode(b, o)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, 0).astype("<u4")
                begin = ends - counts + np.arange(j - i)
                row, piece, start, length = cut(counts + 1, capacity)
                at = begin[row] + start
                data = ids.tobytes()
                raw = [data[4 * x : 4 * y] for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary()),
                ], names=["id", "piece", "start", "length", "ids_crc32", "ids"])

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """`items` with sequence_id and offset added: best-fit decreasing of their `length` (1..capacity).

    `items` must give the same rows each time it is read, such as a written table. No row is
    dropped; equal rows get places of their own; no items give no rows.
    """
    names = items.columns
    part, n, begin, nth, rank = free_names(items, "part", "n", "begin", "nth", "rank")
    quoted = [f"`{c}`" for c in names]
    items = items.withColumn(part, F.pmod(F.xxhash64(*quoted), F.lit(PARTS)).cast("int"))
    sizes = materialize(items.groupBy("length", part).agg(F.count("*").alias(n)), "sizes")
    plan = best_fit_plan({r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum(n)).collect()}, capacity)
    # At most capacity * PARTS rows: where each part's ranks begin.
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(begin))
    inside = Window.partitionBy("length", part).orderBy(*quoted)
    ranked = items.withColumn(nth, F.row_number().over(inside)).join(starts, ["length", part])
    ranked = ranked.select(*quoted, (F.col(begin) + F.col(nth) - 1).alias(rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(names.index("length")).to_numpy(), b.column(len(names)).to_numpy())
            where, offset = plan.place(size, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(where), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*quoted).schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null text is empty and has its end id only; null and repeated doc_ids are packed like any
    other; other columns are ignored; an empty table gives no rows. The ids themselves come from
    `pieces`; the packing moves sizes only, never texts or ids.
    """
    items = materialize(pieces(docs, path, capacity).drop("ids").withColumnRenamed("id", "doc_id"), "pieces")
    return pack(items, capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; null and empty texts are a piece of the closing id alone.

    Repeated and null ids are rows like others, which of equal pieces goes where is any of them; an empty table gives no rows.
    """
    return packed_documents(table(spark, sf_dir, "documents"), default_path())
