"""Integer vectors: floor(scale * x) of every component, with exact sums and squared distances proven to fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm._base import materialize


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int, **others: str) -> DataFrame:
    """(id, v, others...): v holds floor(scale * x), x as double, as longs; `others` are further columns by their new names.

    Vectors that are null or hold null or non-finite components are left out. Null and repeated ids stay.
    """
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    picked = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v"), *[F.col(f"`{c}`").alias(n) for n, c in others.items()])
    return picked.where(fine).withColumn("v", F.transform("v", lambda c: F.floor(c.cast("double") * scale)))


def stored(vectors: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """(written table, rows, longest vector); vectors so large that sums or distances could pass 2**62 are refused."""
    x = materialize(vectors, name)
    low, high = F.min(F.array_min("v")), F.max(F.array_max("v"))
    rows, dim, low, high = x.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(0))).first()
    top = max(high, -low)
    if max(dim, 1) * (2 * top + 1) ** 2 >= 1 << 62 or top >= 1 << 31 or rows * top >= 1 << 62:
        raise ValueError(f"components up to {top} in {rows} vectors of {dim}: sums or squared distances would not be exact")
    return x, rows, dim


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows x width of a list column whose lists all have that length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def totals(group: np.ndarray, x: np.ndarray, weight: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(weighted sums of the rows of each group, weights of each group), as exact integers."""
    sums, count = np.zeros((groups, x.shape[1]), np.int64), np.zeros(groups, np.int64)
    if len(x):
        order = np.argsort(group, kind="stable")
        g = group[order]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        sums[g[first]] = np.add.reduceat(x[order] * weight[order, None], first, axis=0)
        count[g[first]] = np.add.reduceat(weight[order], first)
    return sums, count


def total_rows(sums: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Rows (g, i, total, n) of the groups that have any weight: what a task adds to the sums of all."""
    g = np.flatnonzero(count)
    width = sums.shape[1]
    cols = [np.repeat(g, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(g)), sums[g].ravel(), np.repeat(count[g], width)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["g", "i", "total", "n"])


TOTALS = "g int, i int, total long, n long"


def means(parts: DataFrame, old: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each group of `parts`, rows of all tasks' total_rows; `old` where a group has none.

    What comes to the driver has at most as many rows as `old` has numbers.
    """
    new = old.copy()
    for r in parts.groupBy("g", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        new[r.g, r.i] = int(r.total) // r.n
    return new
