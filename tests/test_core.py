"""Ranges, sequences, annotation and alignment operators against hand-made cases and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import sequences as S
from spanloom.functions import stats
from spanloom.operators import alignments as L
from spanloom.operators import annotation as A
from spanloom.operators import joins as J
from spanloom.operators import kmers as K
from spanloom.operators import sequences as Q

COLS = "root_id string, seqid string, type string, start long, end long, score double, strand string, ord long"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def exons(spark, ranges, root="r", seqid="s"):
    return frame(spark, [(root, seqid, "exon", s, e, 1.0, "+", k) for k, (s, e) in enumerate(ranges)])


def test_merge_two_adjacent_exons(spark):
    got = A.merge_features(exons(spark, [(1000, 5000), (5001, 10000)])).collect()
    assert [(r.start, r.end, r.score, r.parts) for r in got] == [(1000, 10000, None, 2)]


def test_gap_rule_passes_over_overlapping_siblings(spark):
    rng = random.Random(3)
    for _ in range(6):
        ranges = [(a, a + rng.randrange(0, 12)) for a in (rng.randrange(1, 60) for _ in range(rng.randrange(1, 8)))]
        want, order = [], sorted((s, e, k) for k, (s, e) in enumerate(ranges))
        last = order[0][1]
        for s, e, _ in order[1:]:
            if s > last + 1:
                want.append((last + 1, s - 1))
                last = e
        assert sorted((r.start, r.end) for r in A.inter_features(exons(spark, ranges), "exon", "intron").collect()) == want


def test_islands_by_blocks_equal_one_sweep(spark):
    rng = random.Random(5)
    ranges = [(a, a + rng.randrange(0, 30)) for a in (rng.randrange(1, 500) for _ in range(60))]
    want = []
    for s, e in sorted(ranges):
        if want and s <= want[-1][1] + 3:
            want[-1] = (want[-1][0], max(want[-1][1], e), want[-1][2] + 1)
        else:
            want.append((s, e, 1))
    got = A.islands(exons(spark, ranges), 3, block=50).collect()
    assert sorted((r.start, r.end, r.n_features) for r in got) == want


def test_overlap_join_equals_nested_loops(spark):
    rng = random.Random(7)
    a = [(rng.randrange(0, 300), k) for k in range(40)]
    a = [(s, s + rng.randrange(0, 90), k) for s, k in a]
    b = [(s, s + rng.randrange(0, 90), k) for s, k in ((rng.randrange(0, 300), k) for k in range(40))]
    x = spark.createDataFrame([("c", *r) for r in a], "k string, start long, end long, i long")
    y = spark.createDataFrame([("c", *r) for r in b], "k string, start2 long, end2 long, j long")
    got = sorted((r.i, r.j) for r in J.overlap_join(x, y, ["k"]).collect())
    assert got == sorted((i, j) for s, e, i in a for t, u, j in b if s <= u and e >= t)


def test_unique_trees_keep_the_higher_score(spark):
    rows = [("a", "s", "gene", 1, 1000, 0.5, "+", 1), ("b", "s", "gene", 1, 1000, 0.7, "+", 2), ("c", "s", "gene", 1, 1000, 0.7, "-", 3)]
    assert sorted(r.root_id for r in A.unique_trees(A.tree_signature(frame(spark, rows))).collect()) == ["b", "c"]


def test_accuracy_of_nothing_is_one(spark):
    none = exons(spark, [(1, 2)]).where("false").select("seqid", "strand", "start", "end")
    r = J.exact_accuracy(none, none, ["seqid", "strand"]).first()
    assert (r.true_n, r.sensitivity, r.specificity) == (0, 1.0, 1.0)


def test_translation_in_all_codes(spark):
    codons = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
    df = spark.createDataFrame([("".join(codons),)], "seq string")
    for code, (_, aminos, _) in S.GENETIC_CODES.items():
        assert df.select(S.translate_dna("seq", 0, code)).first()[0] == aminos
    assert df.select(S.translate_dna(F.lit("ATGNNNTA"))).first()[0] == "MX"
    assert S.resolved_codons()["GGN"] == "G" and "ATN" not in S.resolved_codons()


def test_open_frames_against_plain_python(spark):
    import re

    rng = random.Random(11)
    seqs = ["".join(rng.choice("acgt") for _ in range(rng.randrange(0, 200))) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(seqs)), "seqnum long, seq string")
    code = S.codon_map()
    want = set()
    for i, s in enumerate(seqs):
        rc = s[::-1].translate(str.maketrans("acgt", "tgca"))
        for sign, x in ((1, s), (-1, rc)):
            for f in range(3):
                aa = "".join(code[x[k : k + 3].upper()] for k in range(f, len(x) - 2, 3))
                want |= {(i, sign * (f + 1), m.start() + 1, len(m[0])) for m in re.finditer(r"M[^*]*\*", aa) if len(m[0]) >= 3}
    assert {tuple(r) for r in Q.open_frames(df, 3).collect()} == want


def test_escapes_round_trip(spark):
    text = "a;b=c&d,e%41+f\tg"
    df = spark.createDataFrame([(text,)], "x string")
    got = df.select(S.escape_gff3("x").alias("e")).select("e", S.unescape_gff3("e").alias("u")).first()
    assert got.u == text and ";" not in got.e and "\t" not in got.e


def test_longest_matches(spark):
    q = spark.createDataFrame([(0, "acgtacgg")], "seqnum long, seq string")
    t = spark.createDataFrame([(0, "ttacgtag")], "seqnum long, seq string")
    want = [max(k for k in range(0, 9) if "acgtacgg"[p : p + k] in "ttacgtag" and p + k <= 8) for p in range(8)]
    assert [r.length for r in K.longest_matches(q, t, 0).orderBy("pos").collect()] == want


def test_alignment_scores():
    rng = random.Random(2)
    for _ in range(40):
        u, v = ("".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(2))
        h = {(i, 0): -2 * i for i in range(len(u) + 1)} | {(0, j): -2 * j for j in range(len(v) + 1)}
        for i in range(1, len(u) + 1):
            for j in range(1, len(v) + 1):
                h[i, j] = max(h[i - 1, j - 1] + (2 if u[i - 1] == v[j - 1] else -1), h[i - 1, j] - 2, h[i, j - 1] - 2)
        assert L.align_pair(u, v)[0] == h[len(u), len(v)]


def test_alignments_of_whole_texts(spark, tmp_path):
    import re

    from spanloom.plans import match_queries as M

    rng = random.Random(6)
    texts = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (150, 0, 190, 170)]
    texts.append(texts[3][:60] + "b" + texts[3][65:])
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def score(u, v, gap_open, gap, local):
        low, edge = -(10**9), lambda k: 0 if local or not k else gap_open + gap * k
        h, f, best = [edge(j) for j in range(len(v) + 1)], [low] * (len(v) + 1), 0
        for i, x in enumerate(u, 1):
            row, e = [edge(i)], low
            for j, y in enumerate(v, 1):
                f[j] = max(f[j], h[j] + gap_open) + gap
                e = max(e, row[j - 1] + gap_open) + gap
                row.append(max(h[j - 1] + (2 if x == y else -1), e, f[j], 0 if local else low))
            h, best = row, max(best, *row)
        return best if local else h[-1]

    for query, how in ((M.global_alignments, (0, -2, False)), (M.local_alignments, (-3, -1, True))):
        rows = query(spark, str(tmp_path)).collect()
        assert {r.pair_id: r.score for r in rows} == {k: score(texts[k], texts[k + 1], *how) for k in range(4)}
        for r in rows if not how[2] else []:
            runs = re.findall(r"(\d+)(.)", r.cigar)
            assert [sum(int(n) for n, o in runs if o in used) for used in ("=XD", "=XI")] == [len(texts[r.pair_id]), len(texts[r.pair_id + 1])]


def test_chain_takes_the_colinear_fragments(spark):
    rows = [(0, 0, 1, 10, 1, 10, 50.0), (0, 0, 12, 20, 13, 21, 40.0), (0, 0, 5, 30, 40, 60, 30.0)]
    r = L.chain(spark.createDataFrame(rows, "a long, b long, a_start long, a_end long, b_start long, b_end long, weight double")).first()
    assert (r.score, r.n) == (50 + 40 - (2 + 3), 2)


def test_chains_of_many_pairs(spark):
    """Thousands of pairs, some over several batches, in seconds; each as its fragments alone give."""
    import time

    import numpy as np

    rng = random.Random(31)
    rows = []
    for a in range(8000):
        for _ in range(40 if a % 1000 == 7 else rng.randrange(1, 3)):
            x, y, n = rng.randrange(200), rng.randrange(200), rng.randrange(20, 40)
            rows.append((None if a == 5 else a, a % 3 or None, x, x + n, y, y + n, float(n)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b long, a_start long, a_end long, b_start long, b_end long, weight double").cache()
    df.count()
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2], r[4])):
        groups.setdefault(r[:2], []).append(r[2:])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for how in ({}, {"max_gap": 60, "local": True, "min_score": 25}):
            began = time.time()
            got = {(r.a, r.b, r.chain): tuple(r)[3:] for r in L.chain(df, **how).collect()}
            assert time.time() - began < 25
            want = {}
            for key, g in groups.items():
                cols = [np.array(c) for c in zip(*g, strict=True)]
                args = {k: v for k, v in how.items() if k != "min_score"}
                for k, (score, members) in enumerate(L.select_chains(L.chain_fragments(*cols, **args), how.get("min_score"))):
                    m = [g[i] for i in members]
                    want[*key, k] = (score, len(m), min(x[0] for x in m), max(x[1] for x in m), min(x[2] for x in m), max(x[3] for x in m))
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert L.chain(df.where("false")).count() == 0


def test_single_linkage(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6)], "a long, b long")
    assert {tuple(r) for r in L.single_linkage(edges).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (5, 5), (6, 5)}


def test_single_linkage_of_a_long_path(spark):
    path = [(k, k + 1) for k in range(1, 200)] + [(200, 0), (300, 300), (None, 301)]
    got = {r.node: r.cluster for r in L.single_linkage(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(201), 0) | {300: 300, 301: 301}


def test_reads_reach_the_end(spark, tmp_path):
    from spanloom.plans import match_queries as M
    from spanloom.plans import sequence_queries as P

    rng = random.Random(8)
    texts = ["".join(rng.choice("acgt") for _ in range(n)) for n in (0, 40, 100, 101, 160, 161, 279, 1000)]
    texts += [texts[7][:300] + texts[7][500:]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    code = str.maketrans("abcdefghijklmnopqrstuvwxyz", ("acgt" * 7)[:26])
    bases = [t.translate(code) for t in texts]
    want = {}
    for d, s in enumerate(bases):
        at = 0
        while s and (at == 0 or at + 40 < len(s)):
            want[d * 10**8 + at // 60] = s[at : at + 100]
            at += 60
    assert {r.seqnum: r.seq for r in P.reads(spark, str(tmp_path)).collect()} == want
    assert P.mutated_reads(spark, str(tmp_path)).count() == len(want)
    # Overlaps past letter 280 join all reads of the long text into one cluster.
    long = {r.node: r.cluster for r in M.read_clusters(spark, str(tmp_path)).collect()}
    assert {long[7 * 10**8 + k] for k in range(16)} == {7 * 10**8}
    assert max(r.a % 10**8 for r in M.global_chains(spark, str(tmp_path)).collect()) > 4
    assert {r.tag for r in M.mapped_tags(spark, str(tmp_path)).collect()} == {d * 10**8 for d, s in enumerate(bases) if len(s) >= 48}


def test_karlin_altschul_lambda():
    import math

    x = stats.karlin_altschul_lambda(1, -2)
    assert 0.25 * math.exp(x) + 0.75 * math.exp(-2 * x) == pytest.approx(1)


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_irreducible_overlaps_equal_plain_loops(spark):
    rng = random.Random(41)
    edges = sorted({(rng.randrange(9), rng.randrange(9), rng.randrange(3, 9)) for _ in range(70)})
    want = {
        (a, b, n) for a, b, n in edges
        if not any(x == a and c not in (a, b) and m > n and (c, b) in {(p, q) for p, q, k in edges if k > n} for x, c, m in edges)
    }
    got = K.irreducible(spark.createDataFrame(edges, "a long, b long, length int")).collect()
    assert {(r.a, r.b, r.length) for r in got} == want


def test_kmer_tables_equal_plain_python(spark):
    rng = random.Random(42)
    seqs = ["".join(rng.choice("acgtACGTn" if k % 2 else "acgt") for _ in range(rng.randrange(0, 60))) for k in range(20)] + ["", None, "é" * 3 + "acgtacgt"]
    df = spark.createDataFrame(list(enumerate(seqs)), "seqnum long, seq string")
    for k in (1, 3, 31, 33):
        want = [(s[i : i + k].lower(), n, i) for n, s in enumerate(seqs) if s for i in range(len(s) - k + 1) if set(s[i : i + k].lower()) <= set("acgt")]
        assert sorted((r.kmer, r.seqnum, r.pos) for r in K.positions(df, k).collect()) == sorted(want)
        tally = {}
        for x, _, _ in want:
            tally[x] = tally.get(x, 0) + 1
        assert {r.kmer: r.n for r in K.counts(df, k).collect()} == tally
    back = str.maketrans("acgt", "tgca")
    asked = spark.createDataFrame([(7, "ACGTTGCAAC"), (8, "nnn")], "seqnum long, seq string")
    three = {}
    for s in seqs:
        for i in range(len(s or "") - 2):
            three[s[i : i + 3].lower()] = three.get(s[i : i + 3].lower(), 0) + 1
    want = [(7, sign, i, three[w if sign == "+" else w[::-1].translate(back)], w) for sign in "+-" for i in range(8) for w in ["acgttgcaac"[i : i + 3]] if (w if sign == "+" else w[::-1].translate(back)) in three]
    assert sorted(tuple(r) for r in K.search(df, asked, 3).collect()) == sorted(want)


def test_six_frames_on_odd_sequences(spark):
    seqs = ["", "a", "acg", "ACGUN", "atgaaatagccc", None]
    rows = Q.six_frames(spark.createDataFrame(list(enumerate(seqs)), "seqnum long, seq string")).collect()
    code, back = S.codon_map(1), str.maketrans("ACGTN", "TGCAN")
    for r in rows:
        s = (seqs[r.seqnum] or "").upper().replace("U", "T")
        s = s if r.frame > 0 else s[::-1].translate(back)
        f = abs(r.frame) - 1
        assert r.protein == "".join(code.get(s[i : i + 3], "X") for i in range(f, len(s) - 2, 3))
    assert len(rows) == 6 * len(seqs)


def test_pattern_places(spark):
    rows = Q.find_pattern(spark.createDataFrame([(1, "aaa é aaaa"), (2, ""), (3, None), (4, "xaa")], "seqnum long, seq string"), "aa").collect()
    assert {r.seqnum: r.places for r in rows} == {1: [1, 2, 7, 8, 9], 2: [], 3: [], 4: [2]}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id AS seqnum", "repeat('a', int(id % 7)) AS seq")
    one, many = (sorted(r.seqnum for r in Q.sample_total_length(df.repartition(n), 100, 5).collect()) for n in (1, 9))
    assert one == many
    draws = sorted((r[0], r[1], r[2]) for r in df.select(Q.draw(5, "seqnum"), "seqnum", F.length("seq")).collect())
    total, want = 0, []
    for _, i, n in draws:
        if total >= 100:
            break
        want.append(i)
        total += n
    assert one == sorted(want)


def test_expected_shulen_of_long_sequences():
    assert 8 < stats.expected_shulen(0.1, 0.25, 10_000) < 16
    # Against whole numbers of a binomial sum where floating point still holds it.
    import math

    def plain(d, p, n):
        total, before = 0.0, 0.0
        for x in range(1, n + 1):
            now = sum(math.comb(x, k) * 2**x * (w := p**k * (0.5 - p) ** (x - k)) * (1 - w) ** n for k in range(x + 1)) * (1 - (1 - d) ** x)
            total, before = total + x * (now - before), now
            if now > 1 - 1e-9:
                break
        return total

    assert stats.expected_shulen(0.5, 0.2, 30) == pytest.approx(plain(0.5, 0.2, 30))
    assert stats.divergence(50.0, 0.25, 10_000) > 0
