"""Greedy extension against dynamic programming, and its table of columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import sequences as S
from spanloom.functions import stats
from spanloom.operators import extensions as X


def bases(rng, n):
    return "".join(rng.choice("acgt") for _ in range(n))


def mutated(rng, s, rate):
    out = []
    for c in s:
        r = rng.random()
        out.append(rng.choice("acgt") if r < rate / 3 else "" if r < 2 * rate / 3 else c + rng.choice("acgt") if r < rate else c)
    return "".join(out)


def replay(u, v, ops):
    """Letters of both that the operations take, checked column by column; and their edits."""
    i = j = edits = 0
    for n, op in re.findall(r"(\d+)([=XID])", ops):
        n = int(n)
        if op in "=X":
            assert all((u[i + k] == v[j + k]) == (op == "=") for k in range(n))
        i, j, edits = i + n * (op != "I"), j + n * (op != "D"), edits + n * (op != "=")
    return i, j, edits


def distances(u, v):
    d = np.zeros((len(u) + 1, len(v) + 1), int)
    d[0], d[:, 0] = np.arange(len(v) + 1), np.arange(len(u) + 1)
    for i in range(1, len(u) + 1):
        for j in range(1, len(v) + 1):
            d[i, j] = min(d[i - 1, j - 1] + (u[i - 1] != v[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
    return d


@pytest.mark.parametrize("identity", [50.0, 70.0, 90.0])
def test_without_limits_the_best_of_all_prefixes(identity):
    rng = random.Random(11)
    for n in range(150):
        u = bases(rng, rng.randrange(0, 40))
        v = mutated(rng, u, 0.25) + bases(rng, rng.randrange(0, 9)) if n % 3 else bases(rng, rng.randrange(0, 30))
        i, j, d, ops = X.extend(X.letters(u, 252), X.letters(v, 253), identity, least=0.0, lag=10**6)
        table = distances(u, v)
        worth = np.add.outer(np.arange(len(u) + 1), np.arange(len(v) + 1)) - table * 2 / (1 - identity / 100)
        assert table[i, j] == d and worth[i, j] == pytest.approx(worth.max()) and replay(u, v, X.cigar(ops)) == (i, j, d)


def test_limits_keep_a_good_alignment_and_end_in_noise():
    rng = random.Random(12)
    for _ in range(20):
        core = bases(rng, 600)
        u, v = core + bases(rng, 300), mutated(rng, core, 0.08) + bases(rng, 300)
        i, j, d, ops = X.extend(X.letters(u, 252), X.letters(v, 253), 80.0)
        assert 560 <= i <= 660 and replay(u, v, X.cigar(ops)) == (i, j, d)
        assert d <= distances(u[:i], v[:j])[i, j] + 2


def test_letters_other_than_bases_equal_nothing():
    assert X.extend(X.letters("acgtnacgt", 252), X.letters("acgtnacgt", 253), 60.0, least=0.0)[3] == "====X===="
    assert X.extend(X.letters("", 252), X.letters("acgt", 253))[:3] == (0, 0, 0)


def test_parameters_of_scores():
    for scores, want in (((1, -2), (1.33, 0.621, 1.12)), ((1, -3), (1.374, 0.711, 1.31)), ((1, -1), (1.0986, 0.333, 0.549))):
        assert stats.karlin_altschul(*scores) == pytest.approx(want, rel=0.01)


@pytest.mark.parametrize("strand", ["+", "-"])
def test_columns_and_identity(spark, strand):
    rng = random.Random(13)
    core = bases(rng, 400)
    turned = core if strand == "+" else core[::-1].translate(str.maketrans("acgt", "tgca"))
    a = spark.createDataFrame([(0, bases(rng, 50) + core + bases(rng, 70)), (2, bases(rng, 200)), (4, None)], "seqnum long, seq string")
    b = spark.createDataFrame([(1, bases(rng, 90) + mutated(rng, turned, 0.06).upper() + bases(rng, 30)), (3, "")], "seqnum long, seq string")
    rows = X.front_extensions(a, b, 12, 50, 100, reverse=True).collect()
    assert len(rows) == 1
    r = rows[0]
    u = a.where("seqnum = 0").first().seq
    v = b.where("seqnum = 1").select((S.ascii_lower("seq") if strand == "+" else S.reverse_complement(S.ascii_lower("seq"))).alias("s")).first().s
    u, v = u[r.a_start : r.a_end + 1], v[r.b_start : r.b_end + 1]
    assert (r.strand, r.a, r.b) == (strand, 0, 1) and len(u) > 380 and replay(u, v, r.cigar) == (len(u), len(v), r.distance)
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([=XID])", r.cigar)]
    count = lambda kinds: sum(n for n, op in ops if op in kinds)
    assert (r.matches, r.mismatches, r.indels, r.length) == (count("="), count("X"), count("ID"), count("=XID"))
    assert r.score == 2 * r.matches - r.mismatches - 2 * r.indels and r.evalue < 1e-20 < 20 < r.bit_score
    assert r.gap_opens == sum(op in "ID" for _, op in ops)
    mean = X.average_identity(spark.createDataFrame(rows), F.lit("x"), F.lit("y")).first()
    assert mean.identity == pytest.approx(r.matches / r.length) and 0.9 < mean.identity < 1
