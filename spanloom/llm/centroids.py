"""Centroid clustering on integer vectors, with centroids screened by block norms.

A vector is cut into segments and the norm of each is kept beside it. For a vector x and a centroid c,
Cauchy-Schwarz in each segment gives |x - c|^2 >= sum over segments of (|x_s| - |c_s|)^2, so the few norms
of both bound the distance from below. Centroids are taken in the order of their bounds, and one gets an exact
integer distance only while its bound does not exceed the best exact distance found so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import _vectors
from spanloom.llm._base import materialize, table

SEGMENTS = 8
#: Rows that are compared with all centroids at once.
ROWS = 8192


def segment_norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Euclidean norm of each segment of each row."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % segments))).reshape(len(x), segments, -1).astype(np.float64)
    return np.sqrt(np.einsum("nsl,nsl->ns", x, x))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid of each row, exact squared distance, distances computed); ties go to the smaller number."""
    found, apart, computed = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    own = segment_norms(centroids)
    for a in range(0, len(x), ROWS):
        v, n = x[a : a + ROWS], norms[a : a + ROWS]
        squares = (n * n).sum(1)[:, None] + (own * own).sum(1)
        # What floating point may add to a bound is taken off it again.
        bound = squares - 2 * (n @ own.T) - 1e-11 * (squares + 1)
        order = np.argsort(bound, axis=1)
        best, which = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64)
        left = np.arange(len(v))
        for j in range(len(centroids)):
            c = order[left, j]
            live = bound[left, c] <= best[left]  # an equal bound may be an equal distance of a smaller number
            left, c = left[live], c[live]
            if not len(left):
                break
            d = v[left] - centroids[c]
            d = np.einsum("nd,nd->n", d, d)
            computed += len(left)
            better = (d < best[left]) | ((d == best[left]) & (c < which[left]))
            best[left[better]], which[left[better]] = d[better], c[better]
        found[a : a + ROWS], apart[a : a + ROWS] = which, best
    return found, apart, computed


def cluster(vectors: DataFrame, id_col: str, vec_col: str, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every kept vector, final centroids).

    Kept are vectors of `dim` components, none null or non-finite, as floor(scale * x). The first centroids are the k
    vectors with the smallest sha256 of "seed:id" (ties by their components, null ids last); fewer vectors give fewer
    centroids. Repeated rows and ids count each; equal centroids leave the later ones empty, and an empty one
    stays where it is. An empty table gives no rows; other columns are ignored, whatever their names. Components so
    large that a squared distance could pass 2**62 are refused with a ValueError. The driver holds k * dim numbers.
    """
    fit = _vectors.scaled(vectors, id_col, vec_col, scale).where(F.size("v") == dim)
    kind = fit.schema["id"].dataType.simpleString()

    def with_norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = segment_norms(_vectors.rows_of(b.column(1), dim))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * SEGMENTS, pa.int32()), pa.array(n.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "v", "norms"])

    x, _, _ = _vectors.stored(fit.mapInArrow(with_norms, f"id {kind}, v array<long>, norms array<double>"), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = x.orderBy(F.asc_nulls_last(hashed), "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dim)

    def assigned(b: pa.RecordBatch, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = _vectors.rows_of(b.column("v"), dim)
        norms = b.column("norms").flatten().to_numpy(zero_copy_only=False).reshape(-1, SEGMENTS)
        return v, *nearest(v, norms, c)[:2]

    def moved(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, count = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in batches:
                v, which, _ = assigned(b, c)
                s, n = _vectors.totals(which, v, np.ones(len(v), np.int64), len(c))
                sums, count = sums + s, count + n
            yield _vectors.total_rows(sums, count)

        return run

    def placed(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, which, d = assigned(b, c)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(which.astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])

        return run

    for _ in range(rounds if len(first) else 0):
        centroids = _vectors.means(x.mapInArrow(moved(centroids), _vectors.TOTALS), centroids)
    return x.mapInArrow(placed(centroids), f"id {kind}, cluster int, distance long"), centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of 16 centroids of every kept vector, with the sums of its cluster and of all.

    Null and repeated ids are rows like any; no kept vectors give no rows; see `cluster`.
    """
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rows = materialize(rows, "assigned")
    # At most one row for each of the 16 centroids.
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = [(j, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = 3) -> str:
    kept = """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) <= 16
)"""
    steps = [kept]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'j': j}}) AS m
  FROM (SELECT r, vec_id, v, j, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM kept CROSS JOIN c{t}) GROUP BY r
)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT o.j, coalesce(n.c, o.c) AS c FROM c{t} o LEFT JOIN (
    SELECT j, list(x ORDER BY i) AS c FROM (
      SELECT j, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
        SELECT m.j AS j, i, sum(v[i]) AS s, count(*) AS n FROM a{t} CROSS JOIN range(1, 65) AS t(i) GROUP BY m.j, i)) GROUP BY j
  ) n USING (j)
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT a.vec_id, CAST(a.m.j AS INTEGER) AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.m.j = c.j
"""


OP11_SQL = _sql()
