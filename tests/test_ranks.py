"""Suffix ranks and what they tell about matches, against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import stats
from spanloom.operators import genomes as G
from spanloom.operators import ranks as R

SEQS = "g int, seqnum long, seq string"


def bases(rng, n):
    return "".join(rng.choice("acgt") for _ in range(n))


def runs(seq):
    """(place, rest of its run of plain bases)."""
    return [(m.start() + i, m[0].lower()[i:]) for m in re.finditer("[ACGTacgt]+", seq) for i in range(len(m[0]))]


def hard_cases(rng):
    """Long repeats, runs of one base, wildcards, equal and empty sequences, capital letters."""
    unit = bases(rng, 80)
    return [(0, 0, unit + "n" + unit.upper() + bases(rng, 20)), (1, 1, bases(rng, 15) + unit + unit), (0, 2, "a" * 70), (1, 3, "a" * 50 + "N" + "a" * 40), (1, 4, unit), (0, 5, unit), (0, 6, ""), (1, 7, None), (0, 8, "NNN"), (1, 9, "ac")]


@pytest.mark.parametrize("part", [1 << 20, 90])
def test_ranks_and_common_prefixes(spark, monkeypatch, part):
    monkeypatch.setattr(R, "PART", part)
    R.with_checkpoints(spark)
    rows = hard_cases(random.Random(1))
    df = spark.createDataFrame(rows, SEQS)
    at = R.places(df).checkpoint()
    every = {(n, p): s for _, n, seq in rows for p, s in runs(seq or "")}
    assert {(r.seqnum, r.pos): r.left for r in at.collect()} == {k: len(s) for k, s in every.items()}
    ranks, levels = R.ranked(at)
    ordered = sorted(every.values())
    first = {s: i + 1 for i, s in reversed(list(enumerate(ordered)))}
    assert {(r.seqnum, r.pos): r["rank"] for r in ranks.collect()} == {k: first[s] for k, s in every.items()}
    got = R._with_common(R._sorted_links(at, ranks, len(every)), levels, at).orderBy("part", "i").collect()
    names = [(r.seqnum, r.pos) for r in got]
    assert [every[k] for k in names] == ordered
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert [r.lcp for r in got] == [0] + [share(a, b) for a, b in zip(ordered, ordered[1:], strict=False)]


def test_common_bases_of_codes():
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(31)]
        n = rng.randrange(32)
        b = a[:n] + [(x + 1) % 4 for x in a[n : n + 1]] + [rng.randrange(4) for _ in a[n + 1 :]]
        pairs.append((int("".join(map(str, a)), 4), int("".join(map(str, b)), 4), n))
    a, b, n = np.array(pairs).T
    assert (R._common(a, b) == n).all()


def test_nearest_rows_of_a_genome():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, count = int(rng.integers(2, 40)), 3
        g, link = rng.integers(0, count, n), rng.integers(0, 9, n)
        link[0] = 0
        cuts = np.unique([0, *rng.integers(0, n, 3), n])
        parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        given = R.handed_on([{b: R.summary(g[p], link[p], b) for b in range(count)} for p in parts], count)
        for b in range(count):
            one = np.concatenate([R.nearest(g[p], link[p], b, *c[b])[0] for p, c in zip(parts, given, strict=True)])
            two = np.concatenate([R.nearest(g[p], link[p], b, *c[b])[1] for p, c in zip(parts, given, strict=True)])
            for i in range(n):
                before = [j for j in range(i) if g[j] == b][::-1]
                near = [int(link[j + 1 : i + 1].min()) for j in before[:2]] + [0, 0]
                assert (one[i], two[i]) == tuple(near[:2])


def test_matches_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(R, "PART", 600)
    rng = random.Random(4)
    core = bases(rng, 3000)
    changed = core[:1500] + ("a" if core[1500] != "a" else "c") + core[1501:]
    queries = [(0, core[500:2600]), (1, "nn" + core[:40] + "n" + bases(rng, 30)), (2, None)]
    target = [(0, changed), (1, "")]
    frame = lambda x: spark.createDataFrame(x, "seqnum long, seq string")
    text = "|".join(t for _, t in target)
    longest = {}
    for n, seq in queries:
        for p, s in runs(seq or ""):
            low, high = 0, len(s)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if s[:mid] in text else (low, mid - 1)
            longest[n, p] = (low, s)
    assert {(r.seqnum, r.pos): r.length for r in R.longest_matches(frame(queries), frame(target), 0).collect()} == {k: v[0] for k, v in longest.items()}
    once = {}
    for k, (size, s) in longest.items():
        low, high = 1, size + 1  # the number of occurrences falls as the prefix grows
        while low < high:
            mid = (low + high) // 2
            first = text.find(s[:mid])
            low, high = (low, mid) if text.find(s[:mid], first + 1) < 0 else (mid + 1, high)
        if low <= size:
            once[k] = low
    assert {(r.seqnum, r.pos): r.length for r in R.unique_prefixes(frame(queries), frame(target)).collect()} == once


def test_distances_of_whole_genomes(spark):
    rng = random.Random(5)
    one = bases(rng, 2000)
    near = "".join(rng.choice("acgt") if rng.random() < 0.02 else c for c in one)
    df = spark.createDataFrame([("x", one), ("same", one), ("near", near), ("far", bases(rng, 2000))], "genome string, seq string")
    got = {(r.a, r.b): r for r in G.distances(df).collect()}
    assert got["x", "same"].kr == 0 == got["same", "x"].divergence
    share = sum(a != b for a, b in zip(one, near, strict=True)) / len(one)
    assert 0.6 * share < got["x", "near"].divergence < 1.5 * share
    assert got["x", "far"].divergence > 0.4


def test_no_places(spark):
    empty = spark.createDataFrame([(0, ""), (1, None)], "seqnum long, seq string")
    assert R.longest_matches(empty, empty).count() == 0 and R.unique_prefixes(empty.where("false"), empty).count() == 0
    assert G.shustring_sums(empty.select(F.col("seqnum").alias("genome"), "seq")).count() == 0


def test_expected_shulen_ends():
    assert stats.expected_shulen(0.0, 0.25, 500) == 500
    assert 900 < stats.expected_shulen(0.001, 0.25, 10**6) < 1100
    assert abs(stats.divergence(200, 0.25, 10_000) - 0.005) < 0.001
