"""Extended seeds, repeated ends, coding parts, consensus, contigs, genome comparison and joins against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import sequences as S
from spanloom.operators import alignments as L
from spanloom.operators import annotation as A
from spanloom.operators import genomes as G
from spanloom.operators import joins as J
from spanloom.operators import predictions as P
from spanloom.operators import sequences as Q


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


def test_extension_without_limit_is_the_best_of_all_prefixes():
    rng = random.Random(51)
    for _ in range(150):
        u, v = bases(rng, rng.randrange(0, 12)), bases(rng, rng.randrange(0, 12))
        if rng.random() < 0.5:
            v = mutated(rng, u, 0.3)
        table = {(0, 0): 0}
        for i in range(len(u) + 1):
            for j in range(len(v) + 1):
                if i or j:
                    table[i, j] = max(
                        table[i - 1, j - 1] + (2 if u[i - 1] == v[j - 1] else -2) if i and j else -99, table[i - 1, j] - 3 if i else -99, table[i, j - 1] - 3 if j else -99,
                    )
        a, b, score = P.extend(u, v, drop=10_000)
        assert score == max(table.values()) == table[a, b]
        # A limit gives up cells, never invents any.
        a, b, less = P.extend(u, v, drop=4)
        assert less <= score and less <= table[a, b]


def test_edits():
    rng = random.Random(52)
    for _ in range(60):
        u, v = bases(rng, rng.randrange(0, 10)), bases(rng, rng.randrange(0, 10))
        d = [[i + j if not i * j else 0 for j in range(len(v) + 1)] for i in range(len(u) + 1)]
        for i in range(1, len(u) + 1):
            for j in range(1, len(v) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (u[i - 1] != v[j - 1]))
        assert P.edits(u, v) == d[-1][-1]


def test_seed_extensions_find_planted_similarities(spark):
    rng = random.Random(53)
    core = [bases(rng, 120) for _ in range(5)]
    a = spark.createDataFrame([(k, bases(rng, 40) + c + bases(rng, 40)) for k, c in enumerate(core)], "seqnum long, seq string")
    b = spark.createDataFrame([(k, bases(rng, 60) + mutated(rng, c, 0.04) + bases(rng, 20)) for k, c in enumerate(core)], "seqnum long, seq string")
    rows = P.seed_extensions(a, b, 12, 8, 90, 80.0).collect()
    assert {(r.a, r.b) for r in rows} == {(k, k) for k in range(5)}
    us, vs = ({r.seqnum: r.seq for r in df.collect()} for df in (a, b))
    for r in rows:
        u, v = us[r.a][r.a_start : r.a_end + 1], vs[r.b][r.b_start : r.b_end + 1]
        assert r.distance == P.edits(u, v) and r.identity == pytest.approx(100 * (1 - 2 * r.distance / (len(u) + len(v)))) and r.a_start <= 48 and r.a_end >= 150


@pytest.mark.parametrize("inverted", [False, True])
def test_repeated_ends(spark, inverted):
    rng = random.Random(54)
    arm = bases(rng, 60)
    other = arm[:20] + ("a" if arm[20] != "a" else "c") + arm[21:]
    right = other[::-1].translate(str.maketrans("acgt", "tgca")) if inverted else other
    s = bases(rng, 100) + arm + bases(rng, 300) + right + bases(rng, 100)
    df = spark.createDataFrame([(1, s), (2, bases(rng, 600)), (3, ""), (4, None)], "seqnum long, seq string")
    rows = P.repeated_ends(df, seed=12, min_arm=50, max_arm=90, min_distance=200, max_distance=500, inverted=inverted).collect()
    assert [r.seqnum for r in rows] == [1]
    r = rows[0]
    assert abs(r.start - 101) <= 3 and abs(r.left_end - 160) <= 3 and abs(r.right_start - 461) <= 3 and abs(r.end - 520) <= 3 and r.similarity > 90


def test_coding_parts_map_back(spark):
    rng = random.Random(55)
    seqs = [bases(rng, 700) for _ in range(8)]
    exons = [(k, k, 1 + 100 * j, 60 + 100 * j, "+-"[k % 2]) for k in range(8) for j in range(7)]
    e = spark.createDataFrame(exons, "parent long, seqnum long, start long, end long, strand string")
    s = spark.createDataFrame(list(enumerate(seqs)), "seqnum long, seq string")
    t = Q.spliced(e, s).select("parent", "seq")
    got = {}
    for r in P.cds_parts(e.drop("seqnum"), t, 5).collect():
        got.setdefault(r.parent, []).append((r.start, r.end, r.phase))
    code, back = S.codon_map(1), str.maketrans("acgt", "tgca")
    for k, seq in enumerate(seqs):
        places = [p for j in range(7) for p in range(1 + 100 * j, 61 + 100 * j)]
        if k % 2:
            places = places[::-1]
        letters = "".join(seq[p - 1].translate(back) if k % 2 else seq[p - 1] for p in places)
        best = None
        for f in range(3):
            aa = "".join(code[letters[i : i + 3].upper()] for i in range(f, len(letters) - 2, 3))
            i = 0
            while (i := aa.find("M", i)) >= 0 and (z := aa.find("*", i)) >= 0:
                if z - i + 1 >= 5 and (best is None or z - i + 1 > best[0]):
                    best = (z - i + 1, f + 3 * i)
                i = z
        want = set()
        if best:
            want = set(places[best[1] : best[1] + 3 * best[0]])
        parts = got.get(k, [])
        assert {p for a, z, _ in parts for p in range(a, z + 1)} == want
        read = 0
        for a, z, phase in sorted(parts, key=lambda x: -x[1] if k % 2 else x[0]):
            assert phase == -read % 3
            read += z - a + 1


def test_consensus_of_spliced_alignments(spark):
    # Re-created rows of a known case, two alignments of one gene: the second is held by the first.
    one, two = [(5414975, 5415294), (5415423, 5415589), (5415672, 5415790)], [(5415008, 5415294), (5415423, 5415564)]
    assert P.compatible(one, two) and P.compatible(two, one) and P.splice_forms([one, two]) == [[0, 1]]
    other = [(5415008, 5415290), (5415423, 5415564)]
    assert not P.compatible(one, other) and P.splice_forms([one, other]) == [[0], [1]]
    chain = [[(1, 10), (20, 30)], [(22, 30), (40, 50)], [(45, 50), (60, 70)]]
    assert P.splice_forms(chain) == [[0, 1, 2]]
    rows = [(f"r{k}", "s", "+", a, b) for k, x in enumerate([*chain, [(200, 210)]]) for a, b in x]
    got = P.consensus_alignments(spark.createDataFrame(rows, "root_id string, seqid string, strand string, start long, end long")).collect()
    assert sorted((r.cluster, r.start, r.end, r.n_alignments) for r in got) == [(1, 1, 10, 3), (1, 20, 30, 3), (1, 40, 50, 3), (1, 60, 70, 3), (200, 200, 210, 1)]


def test_contigs(spark):
    rng = random.Random(56)
    genome = bases(rng, 400)
    reads = spark.createDataFrame([(i, genome[i : i + 60]) for i in range(0, 341, 20)], "seqnum long, seq string")
    edges = spark.createDataFrame([(i, i + 20, 40) for i in range(0, 321, 20)] + [(900, 901, 5), (900, 902, 5)], "a long, b long, length int")
    assert [(r.contig, r.n_reads, r.seq) for r in P.contigs(reads, edges).collect()] == [(0, 18, genome[:400])]


def test_genome_comparison(spark):
    rng = random.Random(57)
    one = bases(rng, 300)
    rows = [("x", one[:200]), ("x", one[200:]), ("y", mutated(rng, one, 0.1)), ("z", bases(rng, 250))]
    df = spark.createDataFrame(rows, "genome string, seq string")
    texts = {g: [s for h, s in rows if h == g] for g in "xyz"}
    for r in G.shustring_sums(df).collect():
        total = sum(max(k for k in range(301) if k <= len(s) - i and any(s[i : i + k] in t for t in texts[r.b])) for s in texts[r.a] for i in range(len(s)))
        assert (r.sum, r.n) == (total, sum(map(len, texts[r.a])))
    kr = {(r.a, r.b): r.kr for r in G.distances(df).collect()}
    assert kr["x", "y"] == kr["y", "x"] < kr["x", "z"]


def test_unique_matches_and_prefixes(spark):
    rng = random.Random(58)
    core = bases(rng, 30)
    a, b = [bases(rng, 20) + core + bases(rng, 20), bases(rng, 50)], [bases(rng, 15) + core, bases(rng, 40), bases(rng, 9) + bases(rng, 30)]
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "seqnum long, seq string")
    count = lambda w, x: sum(t[i : i + len(w)] == w for t in x for i in range(len(t)))
    want = set()
    for i, s in enumerate(a):
        for j, t in enumerate(b):
            for p in range(len(s)):
                for q in range(len(t)):
                    if p and q and s[p - 1] == t[q - 1]:
                        continue
                    n = 0
                    while p + n < len(s) and q + n < len(t) and s[p + n] == t[q + n]:
                        n += 1
                    if n >= 5 and count(s[p : p + n], a) == 1 == count(s[p : p + n], b):
                        want.add((i, j, p, q, n))
    assert {tuple(r) for r in G.unique_matches(frame(a), frame(b), 5).collect()} == want
    short = {(i, p): next((k for k in range(1, 80) if p + k <= len(s) and count(s[p : p + k], b) == 1), None) for i, s in enumerate(a) for p in range(len(s))}
    assert {(r.seqnum, r.pos): r.length for r in G.unique_prefixes(frame(a), frame(b)).collect()} == {k: v for k, v in short.items() if v}


def test_descendants_and_cycles(spark):
    rows = [("a", []), ("b", ["a"]), ("c", ["b", "a"]), ("d", ["c"])]
    got = {(r.ancestor, r.descendant): r.depth for r in J.descendants(spark.createDataFrame(rows, "id string, parent_ids array<string>")).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 1, ("c", "d"): 1, ("b", "d"): 2, ("a", "d"): 2}
    with pytest.raises(ValueError, match="nested"):
        J.descendants(spark.createDataFrame([("a", ["b"]), ("b", ["a"])], "id string, parent_ids array<string>"))


def test_parts_targets_and_dropped_rows(spark):
    rows = [("s", "x", 5, 9, 1, "t 1 2 -"), ("s", "x", 1, 3, 2, "t 1 2 +"), ("s", "y", 1, 2, 3, "t 1 2,u 3 4 -"), ("s", None, 1, 2, 4, None)]
    df = spark.createDataFrame(rows, "seqid string, id string, start long, end long, ord long, target string")
    assert [r.part_no for r in A.name_parts(df).orderBy("ord").collect()] == [2, 1, None, None]
    assert sorted(r.ord for r in A.select_target_strand(df, "+").collect()) == [2, 3, 4]
    kept, gone = A.split_by(df, F.col("id") == "x")
    assert (kept.count(), gone.count()) == (2, 2)


def test_tags_with_gaps_equal_a_full_search(spark):
    rng = random.Random(73)
    target = [bases(rng, 150) for _ in range(3)]
    tags = [mutated(rng, target[k % 3][20 * k : 20 * k + 24], 0.08)[:24].ljust(24, "a") for k in range(6)]
    t = spark.createDataFrame(list(enumerate(tags)), "tag long, seq string")
    got = {tuple(r) for r in L.map_tags_with_gaps(t, spark.createDataFrame(list(enumerate(target)), "seqnum long, seq string"), 2, 8).collect()}
    back = str.maketrans("acgt", "tgca")
    want = set()
    for k, tag in enumerate(tags):
        for strand, s in (("+", tag), ("-", tag[::-1].translate(back))):
            for n, text in enumerate(target):
                for end in range(1, len(text) + 1):
                    d, start = min((P.edits(s, text[x:end]), -x) for x in range(max(0, end - 27), end + 1))
                    if d <= 2:
                        want.add((k, strand, n, -start, end, d))
    assert got == want and len(want) > 3


def test_supermaximal_repeats(spark):
    rng = random.Random(75)
    core = bases(rng, 14)
    seqs = [bases(rng, 20) + core + bases(rng, 9) + core[3:11] + bases(rng, 6), core + bases(rng, 12) + core[:9], "acacacacac"]
    places = {}
    for n, s in enumerate(seqs):
        for i in range(len(s)):
            for j in range(i + 4, len(s) + 1):
                places.setdefault(s[i:j], []).append((n, i))
    repeated = {w: p for w, p in places.items() if len(p) > 1}
    want = {w: len(p) for w, p in repeated.items() if not any(w != x and w in x for x in repeated)}
    got = {r.word: r.places for r in G.supermaximal_repeats(spark.createDataFrame(list(enumerate(seqs)), "seqnum long, seq string"), 4).collect()}
    assert got == want
