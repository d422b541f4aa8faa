"""Exact top-k search by inner product: multi-resolution segment statistics, coarse to fine, then exact scores.

A vector is cut into equal segments; each segment keeps its mean and its deviation. For two
segments of length L, sum(q*x) <= L*(mean_q*mean_x + dev_q*dev_x) (Cauchy-Schwarz on what is
left after the means), so the sum over segments bounds the inner product from above - the same as
bounding the distance |q-x|^2 = |q|^2 + |x|^2 - 2qx from below. Few segments give a cheap, loose
bound; more segments a tighter one. Only pairs whose bound reaches the k-th best exact score so
far are scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm._base import materialize, table

#: Segments at each resolution, coarse to fine.
RESOLUTIONS = (2, 8, 16)


def _segments(x: np.ndarray, n: int) -> np.ndarray:
    """Per row: sqrt(L)*mean and sqrt(L)*deviation of each of n segments, so that a dot product is the bound."""
    pad = -x.shape[1] % n
    x = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), n, -1)
    mean, length = x.mean(2), x.shape[2]
    dev = np.sqrt(np.maximum((x * x).mean(2) - mean * mean, 0))
    return np.concatenate([mean, dev], 1) * math.sqrt(length)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def top_pairs(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, k: int, known: np.ndarray, rows: int = 64):
    """(query index, candidate index, score) of each query's k best candidates but its own row; ties to the smaller id, then row.

    `known` is a score that k other candidates of a query reach (or -inf): what cannot reach it is left out.
    """
    order = np.lexsort((x_row, x_id))
    x, x_row = x[order], x_row[order]
    qs, xs = [_segments(q, n) for n in RESOLUTIONS], [_segments(x, n) for n in RESOLUTIONS]
    out = []
    for a in range(0, len(q), rows):
        part = slice(a, a + rows)
        own = q_row[part, None] == x_row[None, :]
        bound = qs[0][part] @ xs[0].T
        bound[own] = -np.inf
        m = min(k, len(x))
        lead = np.argpartition(-bound, m - 1, axis=1)[:, :m] if m else np.zeros((len(bound), 0), int)
        exact = np.einsum("qd,qmd->qm", q[part], x[lead])
        exact[np.take_along_axis(own, lead, 1)] = -np.inf
        low = np.maximum(exact.min(1), known[part]) if m == k else known[part]
        slack = 1e-9 * (1 + np.abs(bound[np.isfinite(bound)]).max(initial=0))
        live = np.flatnonzero((bound >= low[:, None] - slack).any(0))
        for s, t in zip(qs[1:], xs[1:], strict=True):
            bound = s[part] @ t[live].T
            bound[own[:, live]] = -np.inf
            live = live[(bound >= low[:, None] - slack).any(0)]
        score = q[part] @ x[live].T
        score[own[:, live]] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        val = np.take_along_axis(score, best, 1)
        r, c = np.nonzero(np.isfinite(val))
        out.append((r + a, order[live[best[r, c]]], val[r, c]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str, block: int = 32768, integers: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k other rows with the largest inner product for each row where `is_query` holds.

    Rows are cut into blocks of about `block`; a task holds one block of candidates and one of
    queries, so memory is bounded at any size, and returns at most k rows a query. One block of
    candidates goes first: the k-th best score found there spares most of the others their exact
    scores. Shorter vectors count as padded with zeros. A query is a row: it never answers itself,
    but rows that share its id or its vector do, and each of several query rows with one id has its
    own ranks. Null ids, null vectors and vectors with null or non-finite components take no part;
    empty tables give no rows; other columns are ignored. Scores are sums of doubles: with `integers`, components must be whole
    numbers, and a table whose sums could pass 2**53 is refused with a ValueError, as they would not be exact.
    """
    whole = "{i} IS NOT NULL AND {v} IS NOT NULL AND NOT exists({v}, c -> c IS NULL OR isnan(c) OR abs(c) = double('Infinity'))"
    x = vectors.where(whole.format(i=f"`{id_col}`", v=f"`{vec_col}`"))
    x = x.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda c: c.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # The number of a row is fixed by writing it.
    x = materialize(x.withColumn("row", F.monotonically_increasing_id()), "vectors")
    largest = F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))
    n, m, dim, top = x.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v")), F.coalesce(largest, F.lit(0.0))).first()
    dim = dim or 1
    if integers and dim * top * top >= 2.0**53:
        raise ValueError(f"components up to {top:g} in vectors of {dim}: sums of products would not be exact")
    xb, qb = max(1, math.ceil(n / block)), max(1, math.ceil(m / block))
    mine = lambda blocks, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(blocks)).cast("int")
    x = x.withColumn("xb", mine(xb, 0))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        cols = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        if left.num_rows and right.num_rows:
            xv, qv = (_matrix(t["v"].chunk(0), dim) for t in (left, right))
            xr, qr, xi, qi = left["row"].to_numpy(), right["row"].to_numpy(), left["id"].to_numpy(), right["id"].to_numpy()
            r, c, s = top_pairs(qv, qr, xv, xr, xi, k, right["known"].to_numpy())
            cols = [qr[r], qi[r], xi[c], s]
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), cols, strict=True)))

    def met(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        left = candidates.select("id", "v", "row", "xb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
        return left.groupBy("xb", "qb").cogroup(queries.groupBy("xb", "qb")).applyInArrow(search, "row long, query_id long, vec_id long, score double")

    # Names of its own keep the two sides of the self-join apart.
    asked = x.where("asks").select(*[F.col(c).alias(c) for c in ("id", "v", "row")], mine(qb, 1).alias("qb"))
    found = met(x.where("xb = 0"), asked.select("*", F.lit(0).alias("xb"), F.lit(float("-inf")).alias("known")))
    if xb > 1:
        found = materialize(found, "first-block")
        lows = found.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("low"))
        others = asked.join(lows, "row", "left").select("id", "v", "row", "qb", F.coalesce("low", F.lit(float("-inf"))).alias("known"))
        others = others.select("*", F.explode(F.sequence(F.lit(1), F.lit(xb - 1))).alias("xb"))
        found = found.unionByName(met(x.where("xb > 0"), others))
    # Spark limits each task's rows of a query to k before the shuffle.
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products, on floor(256 * x), of every 50th vector against all others; vectors too large for exact sums are refused."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # Null and non-finite components stay as they are, for the operator to leave those vectors out.
    scaled = e.select("vec_id", F.transform("embedding", lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), c.cast("double")).otherwise(F.floor(c.cast("double") * 256).cast("double"))).alias("v"))
    r = exact_top_k(scaled, F.col("vec_id") % 50 == 0, 5, "vec_id", "v", integers=True)
    return r.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


OP10_SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id,
    CAST(list_sum([a.x * a.y FOR a IN list_transform(range(1, len(q.v) + 1), lambda i: {'x': q.v[i], 'y': e.v[i]})]) AS BIGINT) AS score
  FROM e q JOIN e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
