"""What is dealt out, and what meets, where inputs grow."""

import random
import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.operators import annotation as A
from spanloom.operators import assembly as M
from spanloom.operators import joins as J
from spanloom.operators import kmers as K
from spanloom.operators import predictions as P
from spanloom.operators import sequences as Q
from spanloom.plans.assembly_queries import QUERIES


def _bases(rng, n):
    return "".join(rng.choice("acgt") for _ in range(n))


def test_rare_windows_leave_as_stretches(spark):
    rng = random.Random(1)
    seqs = {i: _bases(rng, 400) for i in range(5)} | {9: "a" * 100}
    rows = M.rare_windows(spark.createDataFrame(list(seqs.items()), "seqnum long, seq string"), 15, 2).collect()
    assert sorted((r.seqnum, p) for r in rows for p in range(r.first, r.last + 1)) == [(i, p) for i in range(5) for p in range(386)]
    assert len(rows) < 5 * 386 / 2


def _alignments(rng, n, reach):
    out = []
    for _ in range(n):
        at, exons = rng.randrange(reach), []
        for _ in range(rng.randrange(1, 4)):
            size = rng.choice((10, 20, 30))
            exons.append((at, at + size))
            at += size + rng.choice((5, 10))
        out.append(exons)
    return sorted(out, key=lambda x: (x[0][0], x[-1][1]))


def _plain_forms(al):
    """Splice forms by sets, one pair after the other."""
    n = len(al)
    span = [(x[0][0], x[-1][1]) for x in al]
    fits = [[i == j or P.compatible(al[i], al[j]) for j in range(n)] for i in range(n)]
    held = [frozenset(j for j in range(n) if fits[i][j] and span[i][0] <= span[j][0] and span[j][1] <= span[i][1]) for i in range(n)]

    def reach(order, sign):
        sets = {}
        for i in order:
            near = [j for j in range(n) if j in sets and fits[i][j] and sign * span[j][0] < sign * span[i][0] and sign * span[j][1] < sign * span[i][1]]
            sets[i] = max((sets[j] | held[i] for j in near), key=len, default=held[i])
        return sets

    left, right = reach(range(n), 1), reach(range(n - 1, -1, -1), -1)
    left_out, forms = set(range(n)), []
    while left_out:
        i = max(sorted(left_out), key=lambda i: len(left[i] | right[i]))
        forms.append(sorted(left[i] | right[i]))
        left_out -= left[i] | right[i]
    return forms


def test_splice_forms_are_those_of_plain_sets():
    rng = random.Random(2)
    for n, reach in ((1, 5), (7, 40), (40, 60), (70, 300), (130, 400)):
        al = _alignments(rng, n, reach)
        assert P.splice_forms(al) == _plain_forms(al)


def test_splice_forms_of_a_large_cluster_take_bits():
    al = [[(3 * i, 3 * i + 4000)] for i in range(1500)]
    tracemalloc.start()
    assert P.splice_forms(al) == [list(range(1500))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20


def test_overlap_totals_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    rows = lambda n: [("k%d" % rng.randrange(3), s, s + rng.randrange(40)) for s in (rng.randrange(-30, 300) for _ in range(n))]
    x, y = rows(80), [*rows(70), ("other", 1, 2)]
    a, b = spark.createDataFrame(x, "k string, start long, end long"), spark.createDataFrame(y, "k string, start2 long, end2 long")
    want = {}
    for k, s, e in x:
        for k2, s2, e2 in y:
            if k == k2 and s <= e2 and e >= s2:
                n, c = want.get(k, (0, 0))
                want[k] = (n + 1, c + min(e, e2) - max(s, s2) + 1)
    for block in (7, 1 << 20):
        assert {r.k: (r.pairs, r.common) for r in J.overlap_totals(a, b, ["k"], block).collect()} == want


def test_spaced_counts_are_those_of_all_places(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, _bases(rng, 60)) for i in range(9)] + [(10, "acgtnacgtacgtaACGTA"), (11, None)], "seqnum long, seq string")
    want = {r.kmer: r["count"] for r in K.spaced_seeds(df, "110101").groupBy("kmer").count().collect()}
    assert {r.kmer: r.n for r in K.spaced_counts(df, "110101").collect()} == want


def test_ids_are_made_in_blocks_of_many_features(spark):
    """Numbers far apart, as those of the tables are: blocks of fixed width would hold one feature each."""
    rows = [("exon" if i % 3 else "CDS", i * 7_000_000 + i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "type string, ord long").withColumn("id", F.lit(None).cast("string"))
    want, n = {}, {}
    for kind, at in rows:
        n[kind] = n.get(kind, 0) + 1
        want[at] = f"{kind}{n[kind]}"
    for size in (7, 100_000):
        assert {r.ord: r.id for r in A.add_ids(df, rows=size).collect()} == want
    assert A.add_ids(df.where("false")).count() == 0


def test_delta_join_is_that_of_all_pairs(spark):
    rng = random.Random(5)
    rows = lambda n: [("k%d" % rng.randrange(2), i, s, s + rng.randrange(9)) for i, s in enumerate(rng.randrange(-20, 60) for _ in range(n))]
    x, y = rows(60), rows(60)
    a, b = spark.createDataFrame(x, "k string, i long, start long, end long"), spark.createDataFrame(y, "k string, j long, start2 long, end2 long")
    for delta in (0, 2):
        want = sorted((i, j) for k, i, s, e in x for k2, j, s2, e2 in y if k == k2 and abs(s - s2) <= delta and abs(e - e2) <= delta)
        assert sorted((r.i, r.j) for r in J.delta_join(a, b, ["k"], delta).collect()) == want


def test_sequences_without_bases_do_not_mutate(spark):
    df = spark.createDataFrame([(i, "") for i in range(30)] + [(99, None)], "seqnum long, seq string")
    assert {r.seq for r in Q.mutate(df, 100.0, 5).collect()} == {"", None}


def test_changes_meet_their_sequence_once(spark):
    # Every change looked for its codon from the first base on: a million bases with a change at every seventh did not end.
    s = _bases(random.Random(27), 1_000) * 1_000
    cds = spark.createDataFrame([(1, s)], "cds_id long, seq string")
    snps = spark.range(0, len(s), 7).select(F.lit(1).cast("long").alias("cds_id"), F.col("id").alias("pos"), F.lit("G").alias("alt"))
    began = time.time()
    rows = Q.variant_effects(snps, cds).where("codon <> upper(codon) OR length(new_codon) <> 3").count(), Q.variant_effects(snps, cds).count()
    assert rows == (0, len(range(0, len(s) // 3 * 3, 7))) and time.time() - began < 60


def test_effects_of_odd_changes(spark):
    cds = spark.createDataFrame([(1, "atgtaaAUGnéac"), (2, None), (3, ""), (4, "tga")], "cds_id int, seq string")
    snps = [(1, 0, "c"), (1, 4, "G"), (1, 5, "c"), (1, 8, "a"), (1, 9, "a"), (1, 10, "a"), (1, 12, "a"), (1, 2, None), (1, 3, None), (1, None, "a"), (2, 0, "a"), (3, 0, "a"), (4, 1, "A"), (4, 0, "C"), (5, 0, "a"), (4, 2, "é"), (1, 6, "u")]
    got = Q.variant_effects(spark.createDataFrame(snps, "cds_id int, pos int, alt string"), cds).collect()
    assert sorted(((r.cds_id, r.pos, r.codon, r.new_codon, r.aa, r.new_aa, r.effect) for r in got), key=str) == sorted([
        (1, 0, "ATG", "CTG", "M", "L", "missense_variant"), (1, 2, "ATG", None, "M", None, "missense_variant"), (1, 3, "TAA", None, "*", None, "stop_lost"),
        (1, 4, "TAA", "TGA", "*", "*", "stop_retained_variant"), (1, 5, "TAA", "TAC", "*", "Y", "stop_lost"), (1, 6, "AUG", "UUG", "M", "L", "missense_variant"),
        (1, 8, "AUG", "AUA", "M", "I", "missense_variant"), (1, 9, "NéA", "AéA", "X", "X", "synonymous_variant"), (1, 10, "NéA", "NAA", "X", "X", "synonymous_variant"),
        (4, 0, "TGA", "CGA", "*", "R", "stop_lost"), (4, 1, "TGA", "TAA", "*", "*", "stop_retained_variant"), (4, 2, "TGA", "TGé", "*", "X", "stop_lost"),
    ], key=str)


def test_annotated_variants_read_texts_once(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "check"))
    spark.createDataFrame([(i, "Some text, " * 20 * i) for i in range(4)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES["variant_annotations"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("regexp_replace") <= 2


def test_spliced_odd_parts(spark):
    seqs = spark.createDataFrame([(1, "acgtacgtéacgTN"), (2, None), (3, ""), (4, "ggcc")], "seqnum int, seq string")
    parts = [("a", 1, 7, 10, "+"), ("a", 1, 1, 2, "+"), ("a", 1, 13, 40, "+"), ("a", 1, 90, 95, "+"), ("b", 1, 12, 14, "-"), ("b", 1, 1, 3, "-"), ("c", 2, 1, 5, "+"), ("d", 3, 1, 5, "-"), ("e", 4, 3, 2, "+"), ("f", 4, 2, 3, "."), ("g", 5, 1, 2, "+")]
    got = Q.spliced(spark.createDataFrame(parts, "parent string, seqnum int, start long, end long, strand string"), seqs).collect()
    assert {(r.parent, r.strand, r.seq) for r in got} == {("a", "+", "acgtéaTN"), ("b", "-", "NAccgt"), ("c", "+", ""), ("d", "-", ""), ("e", "+", ""), ("f", ".", "gc")} and len(got) == 6


def test_runs_of_reads_are_corrected_by_batches():
    rng = random.Random(32)
    runs = lambda letters, n: [(rng.choice(letters), rng.randrange(1, 6)) for _ in range(n)]
    rows = []
    for i in range(400):
        near = "".join(c * n for c, n in runs("acgtACGTn", rng.randrange(12)))
        seq = "".join(c * (2 if rng.random() < 0.15 else 1) for c in near) if i % 4 else "".join(c * n for c, n in runs("acg", 5))
        seq = (seq[:-2] if i % 5 == 0 else seq) + ("é?" if i % 11 == 0 else "")
        rows.append((i, seq, "".join(chr(33 + rng.randrange(60)) for _ in seq), near))
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
    block = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list("abcd"))
    out, plain = Q._corrected_runs(block(rows), 2, 30.0, 3)
    got = list(zip(*(c.to_pylist() for c in out), strict=True))
    assert plain.sum() > 100 and all(g == Q._corrected(*r[1:], 2, 30.0, 3) for r, g, p in zip(rows, got, plain, strict=True) if p)
    # Reads one by one took some 0.3 ms each.
    many = [(i, "acaaaagtccg" * 9, "+" * 99, "acaaagtcccg" * 18) for i in range(50_000)]
    began = time.time()
    out, plain = Q._corrected_runs(block(many), 2, 30.0, 3)
    assert plain.all() and set(out[2].to_pylist()) == {18} and time.time() - began < 6


def test_levels_are_counted_by_ids(spark, monkeypatch):
    # Each question for a further level joined the pairs of all levels again.
    rows = [(f"o{i}", [f"c{i % 50}"]) for i in range(500)] + [(f"p{i % 90}", [f"o{i % 500}"]) for i in range(2000)]
    df, asked = spark.createDataFrame(rows, "id string, parent_ids array<string>"), []
    kind, empty = type(df), type(df).isEmpty
    monkeypatch.setattr(kind, "isEmpty", lambda self: asked.append(self._jdf.queryExecution().optimizedPlan().toString()) or empty(self))
    got = J.descendants(df)
    pairs = {(p[0], i) for i, p in rows} | {(f"c{j % 500 % 50}", f"p{j % 90}") for j in range(2000)}
    assert {(r.ancestor, r.descendant, r.depth) for r in got.collect()} == {(a, b, 2 if a[0] == "c" and b[0] == "p" else 1) for a, b in pairs}
    assert asked and not any("Join Inner" in plan for plan in asked)
    assert J.descendants(df.where("false")).count() == 0
