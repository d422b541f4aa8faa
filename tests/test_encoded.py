"""Packed sequences give their letters back, whole and in part."""

import random

from spanloom.sources import encoded


def test_round_trip(spark, tmp_path):
    rng = random.Random(95)
    texts = ["".join(rng.choice(rng.choice(["acgt", "ACGT", "n", "ryé"])) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 63, 400)] + [None, "NNNN", "acgtN"]
    df = spark.createDataFrame(list(enumerate(texts)), "seqnum long, seq string")
    encoded.write_encoded(df, str(tmp_path / "x"))
    low = [t if t is None else "".join(c.lower() if c.isascii() else c for c in t) for t in texts]
    for start, end in ((0, None), (3, 50), (2, 2), (100, 7), (390, 900)):
        got = {r.seqnum: r.seq for r in encoded.read_encoded(spark, str(tmp_path / "x"), start, end).collect()}
        assert got == {k: t if t is None else t[start:end] if end is None or end > start else "" for k, t in enumerate(low)}
