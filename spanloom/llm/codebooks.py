"""Vector codes: each vector is cut into equal parts, and each part becomes the number of its codebook's nearest entry.

Equal integer parts of one position are one row with a weight, so Lloyd's rounds run over distinct values only; the codes
and errors of distinct parts are joined back to the vectors that hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import _vectors
from spanloom.llm._base import look_up, materialize, table

#: Rows that are compared with all entries of a codebook at once.
ROWS = 4096
#: A part or label with at least one in so many rows goes out by broadcast: no more than that many of a position.
HOT = 1024


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry of each row, exact squared distance); ties go to the lower index."""
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), ROWS):
        d = x[a : a + ROWS, None, :] - book[None, :, :]
        d = np.einsum("nej,nej->ne", d, d)
        code[a : a + ROWS] = d.argmin(1)
        error[a : a + ROWS] = d.min(1)
    return code, error


def _coded(b: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, part, code, error) of each row (pos, part, ...)."""
    pos = b.column("pos").to_numpy(zero_copy_only=False)
    x = _vectors.rows_of(b.column("part"), books.shape[2])
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for p in np.unique(pos).tolist():
        mine = np.flatnonzero(pos == p)
        code[mine], error[mine] = nearest(x[mine], books[p])
    return pos, x, code, error


def compress(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None = None, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """((row, id, label, codes, error) of every kept vector, codebooks as parts x entries x width).

    Vectors that are null or hold null or non-finite components are left out; the others become floor(scale * x). Shorter vectors
    count as padded with zeros up to the longest, and that up to a multiple of `parts`. Each codebook starts as that part
    of the `entries` smallest ids, ascending (repeated ids by their components, null ids last); fewer vectors give fewer entries.
    Ties go to the lower entry, an unused entry stays. Repeated rows are rows of their own. An empty table gives no rows;
    other columns are ignored, whatever their names. Components so large that a sum could pass 2**62 are refused with a
    ValueError. The driver holds the codebooks: entries * dimension numbers.
    """
    others = {"label": label_col} if label_col else {}
    x, rows, dim = _vectors.stored(_vectors.scaled(vectors, id_col, vec_col, scale, **others).withColumn("row", F.monotonically_increasing_id()), "vectors")
    if not label_col:
        x = x.withColumn("label", F.lit(None).cast("int"))
    width = max(1, -(-dim // parts))
    zeros = F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("v"))
    x = x.withColumn("v", F.concat(F.transform("v", lambda c: c.cast("int")), zeros))
    split = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * width + 1, width))
    spread = x.select("row", "id", "label", F.posexplode(split).alias("pos", "part"))
    distinct = materialize(spread.groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")

    first = x.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)

    def moved(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = books.shape[1]
            sums, count = np.zeros((parts * size, width), np.int64), np.zeros(parts * size, np.int64)
            for b in batches:
                pos, part, code, _ = _coded(b, books)
                s, n = _vectors.totals(pos * size + code, part, b.column("n").to_numpy(), len(count))
                sums, count = sums + s, count + n
            yield _vectors.total_rows(sums, count)

        return run

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, code, error = _coded(b, books)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int32)), pa.array(error)], names=["pos", "part", "n", "code", "error"])

    for _ in range(rounds if len(first) else 0):
        books = _vectors.means(distinct.mapInArrow(moved(books), _vectors.TOTALS), books.reshape(-1, width)).reshape(books.shape)
    coded = materialize(distinct.mapInArrow(final, "pos int, part array<int>, n long, code int, error long"), "coded")
    # At most HOT parts of a position reach that share of the rows.
    found = look_up(spread, coded, ["pos", "part"], F.col("n") * HOT >= rows)
    whole = found.groupBy("row", "id", "label").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("c"), F.sum("error").alias("error"))
    return whole.select("row", "id", "label", F.transform("c", lambda c: c["code"]).alias("codes"), "error"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every kept vector; see `compress`. Labels that are null are one group."""
    rows, books = compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    label = [F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("named")]
    rows = materialize(rows.select("*", *label), "codes")
    sums = rows.groupBy("none", "named").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    found = look_up(rows, sums, ["none", "named"], F.col("n") * HOT >= rows.count())
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return found.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(rounds: int = 2) -> str:
    steps = ["""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept CROSS JOIN range(16) AS t(p)
), seeds AS (
  SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY row_number() OVER (ORDER BY vec_id NULLS LAST, v) <= 64
), c0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN seeds USING (r))"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS m
  FROM (SELECT r, p, x, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM parts JOIN c{t} USING (p)) GROUP BY r, p
)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT o.p, o.e, coalesce(n.c, o.c) AS c FROM c{t} o LEFT JOIN (
    SELECT p, e, list(y ORDER BY i) AS c FROM (
      SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS y FROM (
        SELECT p, m.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{t}) GROUP BY p, m.e, i)) GROUP BY p, e
  ) n USING (p, e)
)""")
    return "WITH " + ", ".join(steps) + f""", coded AS (
  SELECT r, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
), digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (r) CROSS JOIN digest
"""


OP13_SQL = _sql()
