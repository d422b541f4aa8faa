"""Sharding: indivisible groups go to fixed-capacity shards by best-fit decreasing through a balanced tree.

Groups of one size are interchangeable, so best fit runs over the histogram of sizes: each size
takes the shard with the least room that still holds it, found in a balanced tree, for as many of
its groups as fit there. That is what taking them one by one gives, but the driver's work depends
on the number of sizes. Sizes up to EXACT bytes are classes of their own; larger ones share a
class with sizes at most 0.1 % smaller, so there are about 100,000 classes at any size of input. The
capacity is the smallest found at which no more shards are needed than there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm._base import materialize, table, text_key

#: Rows of a shard, or groups of a class, that are numbered together, about.
PART_ROWS = 100_000
#: Sizes up to this are classes of their own; of larger ones the leading BITS bits count.
EXACT, BITS = 1 << 16, 10


class Treap:
    """Balanced search tree of (remaining capacity, bin); priorities come from a fixed sequence."""

    __slots__ = ("root", "_state")

    def __init__(self) -> None:
        self.root, self._state = None, 1

    def insert(self, key: tuple[int, int]) -> None:
        self._state = self._state * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self._state, None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest (remaining, bin) with remaining >= size."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        path, node = [], high
        while node[2] is not None:
            path.append(node)
            node = node[2]
        if path:
            path[-1][2] = node[3]
        else:
            high = node[3]
        self.root = self._merge(low, high)
        return node[0]

    def _split(self, node, key):
        """Keys below `key`, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return high if low is None else low
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high


def best_fit(classes: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing of (size, count) classes, taken in the order given (decreasing sizes).

    Returns ((class, first rank, count, bin) rows, bins). A size over the capacity has a bin of its own.
    """
    tree, bins, out = Treap(), 0, []
    for k, (size, count) in enumerate(classes):
        rank = 0
        while rank < count:
            found = tree.take_tightest(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
            n = min(count - rank, found[0] // size)
            out.append((k, rank, n, found[1]))
            rank += n
            tree.insert((found[0] - n * size, found[1]))
    return out, bins


def fit_into(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(class, first rank, count, bin) rows with bins 0..shards-1, at the smallest capacity found for which best fit needs no more.

    A size of at least an even share of what is left has a bin of its own, and the others share the rest of the bins.
    """
    total, alone, begin = sum(s * n for s, n in classes), [], []
    for k, (size, count) in enumerate(classes):
        n = 0
        while n < count and len(alone) < shards - 1 and size * (shards - len(alone)) >= total:
            alone.append((k, n, 1, len(alone)))
            total -= size
            n += 1
        begin.append(n)
    rest, bins = [(s, c - n) for (s, c), n in zip(classes, begin, strict=True)], shards - len(alone)
    low = max([-(-total // bins), *(s for s, n in rest if n)], default=1)
    # Small sizes fill what large ones leave, so a little over the mean is enough: look there first, then close in.
    high, step = low, 1
    while (got := best_fit(rest, high))[1] > bins:
        low, high, step = high + 1, high + step, 4 * step
    best = got[0]
    while low < high:
        mid = (low + high) // 2
        rows, needed = best_fit(rest, mid)
        if needed <= bins:
            best, high = rows, mid
        else:
            low = mid + 1
    return sorted([*alone, *((k, first + begin[k], n, len(alone) + b) for k, first, n, b in best)])


def size_class(size: str) -> Column:
    """The size itself up to EXACT; above, the size rounded up to BITS leading bits."""
    unit = F.expr(f"shiftleft(1L, greatest(length(bin({size})) - {BITS}, 0))")
    return F.when(F.col(size) <= EXACT, F.col(size)).otherwise(((F.col(size) + unit - 1) / unit).cast("long") * unit)


def numbered(rows: DataFrame, by: str, order: list[str], parts: int, name: str) -> DataFrame:
    """`rows` (a written table) with `name`: 0, 1, 2, ... within each value of `by`, counted in `parts` parts by hash of `order`."""
    part = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = part.groupBy(by, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select(by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    nth = F.row_number().over(Window.partitionBy(by, "part").orderBy(*order))
    return part.withColumn("nth", nth).join(begin, [by, "part"]).withColumn(name, F.col("begin") + F.col("nth") - 1).drop("part", "nth", "begin")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; equal texts share a shard, sizes of shards are near equal.

    A size is the UTF-8 length of the text plus 8. A null text counts as empty, and as equal to
    an empty one. Groups of equal size are told apart by the MD5 of their text; slot numbers a
    shard's rows from 0 without gaps. Null and repeated ids are rows like others; an empty table
    gives no rows; other columns are ignored. A group of more than an even share of all bytes has
    a shard of its own that is that much larger, as groups are never cut.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        text_key(F.col(text_col)).alias("group"),
    )
    rows = materialize(rows, "sizes")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes")).select("group", size_class("bytes").alias("class"))
    groups = materialize(groups, "groups")
    # At most EXACT + 2**(BITS - 1) * 47 classes, whatever the input.
    histogram = {r[0]: r[1] for r in groups.groupBy("class").agg(F.count("*")).collect()}
    classes = sorted(histogram.items(), reverse=True)
    plan = np.array(fit_into(classes, shards) if classes else [], np.int64).reshape(-1, 4)
    sizes = np.array([s for s, _ in classes], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = int(plan[:, 1].max(initial=0)) + 1 << 1
        key = plan[:, 0] * stride + plan[:, 1]
        for b in batches:
            k = np.searchsorted(-sizes, -b.column(1).to_numpy())
            at = np.searchsorted(key, k * stride + np.minimum(b.column(2).to_numpy(), stride - 1), "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(plan[at, 3].astype(np.int32))], names=["group", "shard"])

    n, most = rows.count(), max(histogram.values(), default=0)
    ranked = numbered(groups, "class", ["group"], -(-most // PART_ROWS) or 1, "rank")
    placed = materialize(ranked.select("group", "class", "rank").mapInArrow(place, "group binary, shard int"), "placed")
    # A group may hold a third of all rows; the join is on its key alone, which adaptive execution splits.
    out = materialize(rows.join(placed, "group"), "shards")
    return numbered(out, "shard", ["id", "group"], -(-n // (shards * PART_ROWS)) or 1, "slot").select("id", "size", "text_crc32", "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    r = shard(table(spark, sf_dir, "documents"), 24)
    return r.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
