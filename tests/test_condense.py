"""Condensed sets give all letters back, and a search in them finds what one of all sequences finds."""

import random

import pytest

from spanloom.operators import condense as C


@pytest.fixture(autouse=True)
def _shared(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "check"))


def bases(rng, n):
    return "".join(rng.choice("acgt") for _ in range(n))


def mutated(rng, s, rate):
    out = []
    for c in s:
        r = rng.random()
        out.append(rng.choice("acgt") if r < rate / 3 else "" if r < 2 * rate / 3 else c + rng.choice("acgt") if r < rate else c)
    return "".join(out)


def test_scripts():
    assert C.script_of("3=1X2I2=1D1=", "acgtttaca") == "3=1Xt2Itt2=1D1="
    assert C.replay("acgaacxg", "3=1Xt2Itt2=1D1=") == "acgtttacg"


def test_round_trip_and_search(spark):
    rng = random.Random(81)
    core, other = bases(rng, 400), bases(rng, 300)
    seqs = {0: core, 1: bases(rng, 50) + mutated(rng, core, 0.04) + bases(rng, 70), 2: bases(rng, 200), 3: other, 4: mutated(rng, other, 0.03) + bases(rng, 40) + mutated(rng, core[100:300], 0.02)}
    seqs |= {5: core, 6: core.upper(), 7: None, 8: "", 9: "acgt", 10: "n" * 30 + core[:200] + "n" + core[200:], 11: mutated(rng, seqs[1], 0.02)}
    df = spark.createDataFrame(list(seqs.items()), "seqnum long, seq string")
    c = C.compress(df)
    low = {k: s if s is None else s.lower() for k, s in seqs.items()}
    assert {r.seqnum: r.seq for r in C.decompress(c).collect()} == low
    assert {r.seqnum: r.seq for r in C.decompress(c, spark.createDataFrame([(4,), (7,)], "seqnum long")).collect()} == {4: low[4], 7: None}
    info = C.information(c).first()
    assert info.letters == sum(len(s) for s in low.values() if s) and info.links >= 6 and info.unique_letters < 0.6 * info.letters
    words = [core[i : i + 12] for i in range(0, 380, 7)] + [low[k][i : i + 12] for k in (1, 4, 11) for i in range(0, len(low[k]) - 12, 5)] + ["a" * 12, "short", core[:12].upper()]
    want = {(w.lower(), k, p) for w in words if len(w) == 12 for k, s in low.items() if s for p in range(len(s) - 11) if s[p : p + 12] == w.lower() and "n" not in w}
    assert {tuple(r) for r in C.search(c, spark.createDataFrame([(w,) for w in words], "word string")).collect()} == want
