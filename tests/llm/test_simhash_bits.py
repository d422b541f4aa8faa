"""Links between fingerprints whose differing bits include the highest one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import simhash


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _pairs(seed):
    """(fingerprint, another one at most 4 bits away or 5 bits away, whether they link), with bit 63 among the bits."""
    rng = random.Random(seed)
    out = []
    for others in range(6):
        for _ in range(6):
            bits = [63, *rng.sample(range(63), others)]
            x = rng.getrandbits(64)
            out.append((x, x ^ sum(1 << b for b in bits), len(bits) <= 4))
    return out


def test_connect_counts_the_highest_bit():
    for x, y, linked in _pairs(1):
        a, _ = simhash.connect(np.array([_signed(x), _signed(y)]))
        assert len(a) == linked, (hex(x ^ y), linked)


@pytest.mark.parametrize("bucket", [4096, 1])
def test_links_of_buckets_count_the_highest_bit(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    pairs = _pairs(2)
    fps = spark.createDataFrame([(_signed(v),) for p in pairs for v in p[:2]], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.links(fps).collect()}
    assert got == {frozenset((_signed(x), _signed(y))) for x, y, linked in pairs if linked}


def test_one_of_two_that_differ_in_the_highest_bit_stays(spark, monkeypatch):
    pairs = _pairs(3)
    values = [_signed(v) for p in pairs for v in p[:2]]
    texts = spark.createDataFrame([(k, f"text {k}", v) for k, v in enumerate(values)], "doc_id long, text string, v long")
    own = texts.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("id"), F.col("v").alias("fp"))
    monkeypatch.setattr(simhash, "with_fingerprint", lambda docs, id_col, text_col: own)
    kept = {r.doc_id for r in simhash.keep_one(texts).collect()}
    assert kept == {k for k in range(len(values)) if k % 2 == 0 or not pairs[k // 2][2]}
