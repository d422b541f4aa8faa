"""Elements with planted duplications, tracts and binding sites."""

import itertools
import random

import numpy as np
import pytest

from spanloom.operators import elements as E


@pytest.fixture(autouse=True)
def _shared(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "check"))


def bases(rng, n):
    return "".join(rng.choice("acgt") for _ in range(n))


def turned(s):
    return s[::-1].translate(str.maketrans("acgt", "tgca"))


def element(rng, tsd="gattaca", ppt="agaaggagaggaga", trna=None):
    """(sequence, candidate row) with a long terminal repeat of 120 letters that begins tg and ends ca, between two copies of `tsd`."""
    ltr = "tg" + bases(rng, 116) + "ca"
    inner = "cc" + (turned(trna)[:18] if trna else bases(rng, 18)) + bases(rng, 250) + "tttttttttttt" + "cac" + ppt
    before, after = bases(rng, 150) + "c", "g" + bases(rng, 150)
    seq = before + tsd + ltr + inner + ltr + tsd + after
    start = len(before) + len(tsd) + 1
    return seq, (start, start + 2 * len(ltr) + len(inner) - 1, start + len(ltr) - 1, start + len(ltr) + len(inner)), len(inner)


CANDIDATES = "seqnum long, start long, end long, left_end long, right_start long"


def test_duplications_are_found_by_search_of_all():
    rng = random.Random(61)
    for _ in range(40):
        w, x, y, z = bases(rng, 9), bases(rng, 5), bases(rng, 5), bases(rng, 9)
        left, right = w + x, y + z
        best = None
        for size in range(3, 6):
            for i in range(len(left) - size + 1):
                for j in range(len(right) - size + 1):
                    if left[i : i + size] == right[j : j + size]:
                        s, e = i + size - len(w), j - len(y)
                        rank = (abs(s) + abs(e), -size, s)
                        best = min(filter(None, (best, (rank, (s, e, size)))))
        assert E.target_sites(w, x, y, z, 3, 5, None, 0) == (best and best[1])


@pytest.mark.parametrize("off", [0, 3, -4])
def test_borders_move_to_the_duplication(spark, off):
    rng = random.Random(62 + off)
    rows, seqs = [], []
    for n in range(4):
        seq, (s, e, le, rs), _ = element(rng)
        seqs.append((n, seq))
        rows.append((n, s + off, e + off, le, rs))
    seqs.append((9, bases(rng, 400)))
    rows.append((9, 100, 300, 150, 250))
    c, q = spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame(seqs, "seqnum long, seq string")
    got = {r.seqnum: (r.start, r.end, r.tsd_length) for r in E.with_target_sites(c, q, min_tsd=6, motif="tgca").collect()}
    assert {k: v for k, v in got.items() if k != 9} == {n: (r[1] - off, r[2] - off, 7) for n, r in enumerate(rows[:4])}
    assert E.with_target_sites(c, q, min_tsd=6, motif="tgca", required=False).count() == 5


def test_the_likeliest_path_of_all():
    rng = random.Random(63)
    move = np.log(np.where(np.eye(3) > 0, 1 - E.LEAVE, E.LEAVE / 2))
    emit = np.append(np.log(E.EMITS), np.full((3, 1), np.log(0.25)), axis=1)
    texts = [rng.choice(["", "n"]) + "".join(rng.choice("agagtttc") for _ in range(rng.randrange(0, 8))) for _ in range(25)] + [""]

    def worth(t, path):
        digits = ["acgt".find(c) % 5 for c in t]
        return sum(emit[s, d] for s, d in zip(path, digits, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(path))

    for t, path in zip(texts, E.decode(texts), strict=True):
        assert len(path) == len(t)
        assert worth(t, path) == pytest.approx(max(worth(t, p) for p in itertools.product(range(3), repeat=len(t))))


@pytest.mark.parametrize("strand", ["+", "-"])
def test_tracts_binding_sites_and_strands(spark, strand):
    rng = random.Random(64)
    trnas = [(f"t{k}", bases(rng, 70) + "cca") for k in range(5)]
    rows, seqs, inner = [], [], {}
    for n in range(4):
        seq, (s, e, le, rs), size = element(rng, trna=trnas[n][1])
        inner[n] = size
        if strand == "-":
            seq, (s, e, le, rs) = turned(seq), tuple(len(seq) + 1 - p for p in (e, s, rs, le))
        seqs.append((n, seq))
        rows.append((n, s, e, le, rs))
    c, q = spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame(seqs, "seqnum long, seq string")
    ppt = E.polypurine_tracts(c, q)
    pbs = E.binding_sites(c, q, spark.createDataFrame(trnas, "trna string, seq string"))
    for n, _, _, le, rs in rows:
        hits = {r.strand: r for r in ppt.where(f"seqnum = {n}").collect()}
        r = hits[strand]
        assert (rs - 1 - r.ppt_end if strand == "+" else r.ppt_start - le - 1) <= 1 and 13 <= r.ppt_end - r.ppt_start + 1 <= 16 and r.box >= 8
        b = {r.strand: r for r in pbs.where(f"seqnum = {n}").collect()}[strand]
        assert b.trna == f"t{n}" and b.offset == 2 and b.trna_offset == 0 and b.pbs_end - b.pbs_start + 1 >= 18
        assert (b.pbs_start - le - 1 if strand == "+" else rs - 1 - b.pbs_end) == 2
    assert {r.strand for r in E.assign_strands(c, ppt, pbs).collect()} == {strand}
    assert {r.strand for r in E.assign_strands(c, ppt.where("false")).collect()} == {"?"}
