"""Small functions, formats and sinks that no query touches, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import ranges as R
from spanloom.functions import sequences as S
from spanloom.functions import stats
from spanloom.operators import alignments as L
from spanloom.operators import annotation as A
from spanloom.operators import sequences as Q
from spanloom.sources import sequences as Z


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scores_and_distances(spark):
    lam, k = 1.3, 0.7
    r = one(spark, stats.bit_score(F.lit(30.0), lam, k).alias("b"), stats.raw_score(F.lit(50.0), lam, k).alias("r"), stats.e_value(F.lit(30.0), F.lit(1e6), lam, k).alias("e"), stats.log_sum(F.lit(-1000.0), F.lit(-1001.0)).alias("s"), stats.jukes_cantor(F.lit(0.3)).alias("j"), stats.jukes_cantor(F.lit(0.8)).alias("i"))
    assert r.b == pytest.approx((30 * lam - math.log(k)) / math.log(2)) and r.r == pytest.approx((50 * math.log(2) + math.log(k)) / lam)
    assert r.e == pytest.approx(1e6 * k * math.exp(-lam * 30)) and r.s == pytest.approx(-1000 + math.log1p(math.exp(-1)))
    assert r.j == pytest.approx(-0.75 * math.log(1 - 0.4)) and r.i == math.inf


def test_qualities_and_composition(spark):
    r = one(spark, S.phred_scores(F.lit("!+I")).alias("q"), S.solexa_to_phred(F.lit(10.0)).alias("s"), S.error_probability(F.lit(20)).alias("e"), S.gc_content(F.lit("ggcatn")).alias("g"), S.gc_content(F.lit("nn")).alias("n"), S.only_iupac(F.lit("acgtN")).alias("y"), S.only_iupac(F.lit("acg!")).alias("z"), S.positions(F.lit("aaa"), F.lit("aa")).alias("p"))
    assert list(r.q) == [0, 10, 40] and r.s == pytest.approx(10 * math.log10(11)) and r.e == pytest.approx(0.01)
    assert r.g == pytest.approx(0.6) and r.n is None and r.y and not r.z and list(r.p) == [1, 2]


def test_wildcards_and_masks(spark):
    df = spark.createDataFrame([(1, "acNNNgtRYa"), (2, None), (3, "")], "seqnum long, seq string")
    assert {r.seqnum: r.seq for r in Q.contract_wildcards(df).collect()} == {1: "acngtna", 2: None, 3: ""}
    rng = random.Random(71)
    plain = "".join(rng.choice("acgt") for _ in range(40))
    df = spark.createDataFrame([(1, plain + "a" * 30 + plain), (2, None), (3, "ac")], "seqnum long, seq string")
    got = {r.seqnum: r.seq for r in Q.dust_mask(df, 32, 2.0).collect()}
    assert got[2] is None and got[3] == "AC" and got[1].upper() == (plain + "a" * 30 + plain).upper()
    assert got[1][42:68].islower() and got[1][:30].isupper() and got[1][-30:].isupper()


def test_homopolymer_correction(spark):
    reads = spark.createDataFrame([(1, 9, 0, "acaaaagtccg", "+" * 11), (2, 9, 0, "acaaaagtccg", "I" * 11), (3, 9, 2, "aagtccc", "+" * 7), (4, 9, 0, "ttt", "+++"), (5, 9, 0, "agaaaagatccg", "+" * 12)], "seqnum long, ref long, ref_start long, seq string, qual string")
    ref = spark.createDataFrame([(9, "acaaagtcccg")], "seqnum long, seq string")
    got = {r.seqnum: (r.seq, r.edits, len(r.qual)) for r in Q.correct_homopolymers(reads, ref).collect()}
    assert got[1] == ("acaaagtcccg", 2, 11) and got[2] == ("acaaaagtccg", 0, 11) and got[3] == ("aaagtccc", 1, 8) and got[4] == ("ttt", 0, 3)
    # A replaced and an added base leave the runs behind them with their partners.
    assert got[5] == ("agaaagatcccg", 2, 12)


def test_flat_file_formats(spark, tmp_path):
    (tmp_path / "a.gb").write_text("LOCUS x\nDEFINITION  first thing\n            goes on\nACCESSION y\nORIGIN\n        1 acgt acg\n        8 tt\n//\nLOCUS z\nDEFINITION  second\nACCESSION w\nORIGIN\n        1 gg\n//\n")
    assert {tuple(r) for r in Z.read_genbank(spark, str(tmp_path / "a.gb")).collect()} == {("first thing goes on", "acgtacgtt"), ("second", "gg")}
    (tmp_path / "a.embl").write_text("ID   x\nDE   first thing\nDE   goes on\nSQ   Sequence 9 BP;\n     acgt acg   7\n     tt         9\n//\n")
    assert {tuple(r) for r in Z.read_embl(spark, str(tmp_path / "a.embl")).collect()} == {("first thing goes on", "acgtacgtt")}


def test_orders_names_and_drawing(spark):
    rows = [("10", 1, 5, 1), ("9", 3, 4, 2), ("x", 1, 2, 3), ("9", 1, 9, 4)]
    df = spark.createDataFrame(rows, "seqid string, start long, end long, ord long")
    assert [r.ord for r in df.orderBy(*A.numeric_sort_key()).collect()] == [4, 2, 1, 3]
    mapping = spark.createDataFrame([("9", "nine"), ("10", "ten")], "seqid string, new_seqid string")
    assert [r.seqid for r in A.unmapped_sequences(df, mapping).collect()] == ["x"]
    placed = {(r.seqid, r.ord): r.line for r in A.sketch_lines(df).collect()}
    assert placed["9", 4] != placed["9", 2] and placed["10", 1] == 0


def test_arrays_of_ranges(spark):
    df = spark.sql("SELECT array(named_struct('start', 5L, 'end', 9L), named_struct('start', 1L, 'end', 3L), named_struct('start', 5L, 'end', 9L)) AS a, cast(array() AS array<struct<start:bigint,end:bigint>>) AS e")
    r = df.select(R.ranges_are_sorted("a").alias("s"), R.ranges_do_not_overlap("a").alias("o"), R.unique_range_counts("a").alias("c"), R.total_range_length("a").alias("t"), R.spanned_range_length("a").alias("p"), R.spanned_range_length("e").alias("z"), R.ranges_do_not_overlap("e").alias("n"), R.ranges_do_not_overlap(R.unique_ranges("a")).alias("u")).first()
    assert (r.s, r.o, list(r.c), r.t, r.p, r.z, r.n, r.u) == (False, False, [1, 2], 13, 9, 0, True, True)


def test_exact_repeat_candidates(spark):
    rng = random.Random(72)
    arm, body = ("".join(rng.choice("acgt") for _ in range(n)) for n in (30, 100))
    # What stands beside the two arms differs, so neither is longer.
    before, after = ("a" if x != "a" else "c" for x in (body[-1], body[0]))
    seqs = spark.createDataFrame([(1, before * 3 + arm + body + arm + after * 3)], "seqnum long, seq string")
    found = L.repeat_candidates(L.repeats(seqs, 15), seqs, 50, 300, 20, 100, 85.0).collect()
    assert [(r.seqnum, r.start, r.end, r.similarity) for r in found] == [(1, 4, 163, 100.0)]
    two = spark.createDataFrame([(1, 1, 9, 90.0), (1, 5, 12, 95.0), (1, 20, 30, 85.0)], "seqnum long, start long, end long, similarity double")
    assert sorted(r.start for r in L.best_of_overlapping(two).collect()) == [5, 20] and [r.start for r in L.best_of_overlapping(two, none=True).collect()] == [20]


@pytest.mark.parametrize("overlaps", [False, True])
def test_chains_equal_all_subsets(overlaps):
    rng = random.Random(74)
    for _ in range(120):
        n = rng.randrange(1, 7)
        f = [(x, x + rng.randrange(1, 9), y, y + rng.randrange(1, 9), rng.randrange(1, 30)) for x, y in ((rng.randrange(30), rng.randrange(30)) for _ in range(n))]
        best = 0.0
        for mask in range(1, 1 << n):
            part = sorted((f[k] for k in range(n) if mask >> k & 1), key=lambda z: (z[0], z[2]))
            total, ok = 2 * part[0][4], True
            for p, q in zip(part, part[1:], strict=False):
                g1, g2 = q[0] - p[1], q[2] - p[3]
                ok &= (p[0] < q[0] and p[2] < q[2] and p[1] < q[1] and p[3] < q[3]) if overlaps else (g1 > 0 and g2 > 0)
                total += 2 * q[4] - max(g1, 0) - max(g2, 0) - (max(1 - g1, 0) + max(1 - g2, 0) if overlaps else 0)
            best = max(best, total) if ok else best
        (score, members), *_ = L.chain_fragments(*(np.array(c) for c in zip(*f, strict=True)), overlaps=overlaps, factor=2.0)
        assert score == best and members == sorted(members, key=lambda k: f[k][0])


def test_selected_chains():
    chains = [(9.0, [1]), (9.0, [2]), (7.0, [3]), (4.0, [4])]
    assert L.select_chains(chains, best=2) == chains[:3] and L.select_chains(chains, min_score=8) == chains[:2]
    assert L.select_chains(chains, percent=25) == chains[:3] and L.select_chains([], percent=25) == []


def test_low_complexity_by_its_definition():
    import pyarrow as pa

    from spanloom.functions import bases

    rng = random.Random(91)
    texts = ["".join(rng.choice(rng.choice(["acgt", "ac", "a", "acgtn"])) for _ in range(rng.randrange(0, 40))) for _ in range(25)] + ["a" * 30, "ac" * 20, "", "at"]
    flat, off = bases.letters(pa.array(texts))
    got = Q.low_complexity(flat, off, 20, 1.5, 1)
    for t, x, y in zip(texts, off[:-1], off[1:], strict=True):
        triplets = [t[i : i + 3] for i in range(len(t) - 2)]

        def score(i, j, triplets=triplets):
            part = [w for w in triplets[i:j] if "n" not in w]
            return sum(part[p] == part[q] for q in range(len(part)) for p in range(q)) / (j - i - 1) if j - i > 1 else 0

        low = [False] * len(t)
        for i in range(len(triplets)):
            for j in range(i + 2, min(i + 18, len(triplets)) + 1):
                s = score(i, j)
                if s > 1.5 and all(score(p, q) <= s for p in range(i, j) for q in range(p + 2, j + 1)):
                    low[i : j + 2] = [True] * (j + 2 - i)
        for k in range(1, len(t) - 1):
            if low[k - 1] and not low[k] and low[k + 1]:
                low[k] = True
        assert np.array_equal(got[x:y], low), t
