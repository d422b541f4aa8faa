"""Centroids and vector codes against plain Python, and on nulls, other lengths, ties, repeated rows and clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest

from spanloom.llm import centroids, codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, row int, pos int, n string, code string"


def table(spark, rows):
    return spark.createDataFrame([(i, x, lab, "x", 1, 2, 3, "y", "z") for i, x, lab in rows], SCHEMA)


def f32(x):
    return float(np.float32(x))


def vectors(seed, n, dim, odd=True):
    """Vectors with repeated rows, repeated ids, equal vectors, null ids, and ones that take no part."""
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 0.4) for _ in range(dim)] for _ in range(7)]
    rows = [(i, [f32(a + rng.gauss(0, 0.1)) for a in rng.choice(heads)], rng.choice([None, 1, 2, 3])) for i in range(n)]
    rows += [rows[3], rows[3], (rows[5][0], rows[6][1], 1), *[(1000 + k, rows[9][1], None) for k in range(30)], (None, rows[2][1], 2), (None, rows[2][1], 2)]
    if odd:
        bad = [math.nan, math.inf, -math.inf, None]
        rows += [(2000 + k, [*rows[k][1][:-1], x], 1) for k, x in enumerate(bad)] + [(3000, None, 1)]
    rng.shuffle(rows)
    return rows


def clean(x):
    return x is not None and all(c is not None and math.isfinite(c) for c in x)


def test_nearest_is_exact_and_prunes():
    rng = np.random.default_rng(5)
    heads = rng.normal(0, 30, (16, 64))
    x = np.rint(heads[rng.integers(0, 16, 3000)] + rng.normal(0, 3, (3000, 64))).astype(np.int64)
    c = np.rint(heads).astype(np.int64)
    c[9] = c[4]  # equal centroids: the smaller number
    which, apart, computed = centroids.nearest(x, centroids.segment_norms(x), c)
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (which == d.argmin(1)).all() and (apart == d.min(1)).all() and computed < 0.6 * d.size
    zero = np.zeros((5, 64), np.int64)
    assert centroids.nearest(zero, centroids.segment_norms(zero), np.stack([zero[0] + 1, zero[0] - 1, zero[0] + 1]))[0].tolist() == [0] * 5


@pytest.mark.parametrize(("n", "k"), [(120, 16), (12, 60)])
def test_clusters(spark, n, k):
    rows = vectors(n, n, 64) + [(4000, [0.5] * 63, 1), (4001, [0.5] * 65, 1), (4002, [], 1)]
    kept = [(i, [math.floor(64 * c) for c in x]) for i, x, _ in rows if clean(x) and len(x) == 64]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [x for _, x in seeds]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(3):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else m for j, m in enumerate(c)]
    got, means = centroids.cluster(table(spark, rows), "vec_id", "embedding", k=k)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert means.tolist() == c
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=key)


def test_no_vectors_and_too_large_ones(spark):
    empty = table(spark, []).where("false")
    assert centroids.cluster(empty, "vec_id", "embedding")[0].count() == 0
    assert codebooks.compress(empty, "vec_id", "embedding", "label")[0].count() == 0
    huge = table(spark, [(1, [1e30] * 64, 1)])
    for f in (centroids.cluster, codebooks.compress):
        with pytest.raises(ValueError, match="not be exact"):
            f(huge, "vec_id", "embedding")


@pytest.mark.parametrize(("n", "dim", "hot"), [(150, 64, 1024), (150, 64, 20), (20, 37, 1024), (150, 8, 20)])
def test_codes(spark, monkeypatch, n, dim, hot):
    monkeypatch.setattr(codebooks, "HOT", hot)
    rows = vectors(n + dim, n, dim) + ([(5000, [], None), (5001, [0.25] * 5, 2)] if dim != 64 else [])
    width = -(-dim // 16)
    kept = [(i, [math.floor(256 * c) for c in x] + [0] * (16 * width - len(x)), lab) for i, x, lab in rows if clean(x)]
    cut = lambda x: [x[p * width : (p + 1) * width] for p in range(16)]
    # Padding goes by the vector's end, as ties by components do before it.
    first = sorted(((i, [math.floor(256 * c) for c in x] + [0] * (16 * width - len(x))) for i, x, _ in rows if clean(x)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[cut(x)[p] for _, x in first] for p in range(16)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        groups = {}
        for _, x, _ in kept:
            for p, y in enumerate(cut(x)):
                groups.setdefault((p, near(p, y)[1]), []).append(y)
        books = [[[sum(col) // len(groups[p, k]) for col in zip(*groups[p, k], strict=True)] if (p, k) in groups else e for k, e in enumerate(b)] for p, b in enumerate(books)]
    want = [(i, lab, [near(p, y)[1] for p, y in enumerate(cut(x))], sum(near(p, y)[0] for p, y in enumerate(cut(x)))) for i, x, lab in kept]
    got, found = codebooks.compress(table(spark, rows), "vec_id", "embedding", "label")
    assert found.tolist() == books
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[1] is None, r[1] or 0)
    assert sorted(((r.id, r.label, r.codes, r.error) for r in got.collect()), key=key) == sorted(want, key=key)


def test_products_that_would_not_be_exact_are_refused(spark, tmp_path):
    from spanloom.llm import topk

    def query(value):
        path = tmp_path / str(value)
        table(spark, [(0, [value] * 4, 1), (1, [1.0] * 4, 1)]).write.parquet(f"{path}/embeddings.parquet")
        return topk.op10_topk_search(spark, str(path))

    assert [r.score for r in query(2.0**17).collect()] == [4 * 2**17 * 2**16]
    with pytest.raises(ValueError, match="not be exact"):
        query(2.0**20)
