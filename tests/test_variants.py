"""Variants in genes, ontologies, and joins whose shuffle was made smaller, against plain Python."""

import random

import pytest

from spanloom.functions import sequences as S
from spanloom.operators import joins as J
from spanloom.operators import kmers as K
from spanloom.operators import ontology as O
from spanloom.operators import variants as V
from spanloom.sources import ontology as SO


@pytest.fixture(autouse=True)
def _shared(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "check"))


def bases(rng, n):
    return "".join(rng.choice("acgt") for _ in range(n))


def turned(s):
    return s[::-1].translate(str.maketrans("acgt", "tgca"))


def test_variants_in_overlapping_genes(spark):
    rng = random.Random(41)
    seq = bases(rng, 400)
    parts = {"p": [(11, 40), (61, 91)], "m": [(30, 70), (101, 135)], "far": [(301, 330)]}
    strand = {"p": "+", "m": "-", "far": "+"}
    cds = [(t, f"g{t}", "s", x, y, strand[t]) for t, xs in parts.items() for x, y in xs]
    genes = [("gp", "s", 5, 95), ("gm", "s", 25, 140), ("gfar", "s", 300, 340)]
    snps = [(i, "s", p, seq[p - 1] if p % 5 else "n", rng.choice("acgt")) for i, p in enumerate(range(1, 400, 3))] + [(999, "other", 20, "a", "c")]
    code = {r.c: r.aa for r in spark.createDataFrame([(a + b + c,) for a in "ACGT" for b in "ACGT" for c in "ACGT"], "c string").select("c", S.translate_dna("c", 0, 1).alias("aa")).collect()}
    want = {}
    for i, sid, p, ref, alt in snps:
        for t, xs in parts.items():
            if sid != "s" or not any(x <= p <= y for x, y in xs):
                continue
            places = [q for x, y in xs for q in range(x, y + 1)]
            text = "".join(seq[q - 1] for q in places)
            k, base, old = places.index(p), alt, ref
            if strand[t] == "-":
                text, k, base, old = turned(text), len(text) - 1 - k, turned(alt), turned(ref) if ref != "n" else ref
            if k < len(text) // 3 * 3:
                c = text[k // 3 * 3 : k // 3 * 3 + 3].upper()
                n = c[: k % 3] + base.upper() + c[k % 3 + 1 :]
                x, y = code[c], code[n]
                effect = "stop_retained_variant" if x == y == "*" else "stop_lost" if x == "*" else "stop_gained" if y == "*" else "synonymous_variant" if x == y else "missense_variant"
                want[i, t] = (5 if t in "pm" else 300, f"g{t}", k, c, n, effect, text[k] == old)
    got = V.annotate(
        spark.createDataFrame(snps, "snp_id long, seqid string, pos long, ref string, alt string"), spark.createDataFrame(genes, "gene_id string, seqid string, start long, end long"),
        spark.createDataFrame(cds, "parent string, gene_id string, seqid string, start long, end long, strand string"), spark.createDataFrame([("s", seq), ("t", "")], "seqnum string, seq string"),
    )
    rows = got.collect()
    assert {(r.snp_id, r.parent): (r.cluster, r.gene_id, r.cds_pos, r.codon, r.new_codon, r.effect, r.ref_ok) for r in rows} == want and len(rows) == len(want)
    texts = {r.snp_id: r.variant_effect for r in V.effect_attributes(got).collect()}
    assert texts == {i: ",".join(sorted(f"{w[5]}:{t}" for (j, t), w in want.items() if j == i)) for i in {i for i, _ in want}}


OBO = """format-version: 1.2 ! comment
! a comment line
[Term]
id: SO:1
name: gene
[Term]
id: SO:2
name: transcript
relationship: part_of SO:1 ! gene
[Term]
id: SO:3
name: mRNA
is_a: SO:2 ! transcript
[Term]
id: SO:4
name: exon
relationship: part_of SO:2
[Term]
id: SO:5
name: coding_exon
is_a: SO:4
is_a: SO:6
[Term]
id: SO:6
name: loop
is_a: SO:5
[Term]
id: SO:7
name: old
is_obsolete: true
[Typedef]
id: part_of
name: part_of
"""


def test_ontology_closure_and_rules(spark, tmp_path):
    (tmp_path / "x.obo").write_text(OBO)
    terms, relations, problems = SO.read_obo(spark, str(tmp_path / "x.obo"))
    assert problems.count() == 0 and terms.count() == 7
    above = {(r.name, r.above) for r in O.ancestors(terms, relations).collect()}
    assert above == {(x, x) for x in ("gene", "transcript", "mRNA", "exon", "coding_exon", "loop")} | {("mRNA", "transcript"), ("coding_exon", "exon"), ("coding_exon", "loop"), ("loop", "coding_exon"), ("loop", "exon")}
    assert {(r.child, r.parent) for r in O.allowed_parents(terms, relations).collect()} == {(a, b) for a, bs in ((("transcript", "mRNA"), ("gene",)), (("exon", "coding_exon", "loop"), ("transcript", "mRNA"))) for a in a for b in bs}
    f = [(1, "gene", "g", []), (2, "mRNA", "m", ["g"]), (3, "coding_exon", None, ["m"]), (4, "exon", None, ["g"]), (5, "old", "o", []), (6, "nonsense", None, ["g"]), (7, "mRNA", None, ["o", "absent"])]
    features = spark.createDataFrame(f, "line int, type string, id string, parent_ids array<string>")
    assert sorted((r.line, "part-of" in r.problem) for r in O.type_problems(features, terms, relations).collect()) == [(4, True), (5, False), (6, False)]
    assert sorted(r.line for r in O.select_subtypes(features, terms, relations, "exon").collect()) == [3, 4]


@pytest.mark.parametrize(
    ("text", "line", "problem"),
    [("", 1, "end of file"), ("\n\n", 1, "end of file"), ("! only\n", 1, "end of file"), ("format-version: 1\n[Term]\nid SO1\nname: x\n", 3, "':'"), ("format-version:\n", 1, "missing value"),
     ("other: 1\n", 1, "format-version"), ("format-version: 1\n[Term]\nname: x\n", 2, '"id"'), ("format-version: 1\n[Term]\nid: x\n", 2, '"name"')],
)
def test_broken_ontologies(spark, tmp_path, text, line, problem):
    (tmp_path / "y.obo").write_text(text)
    rows = SO.read_obo(spark, str(tmp_path / "y.obo"))[2].collect()
    assert any(r.line == line and problem in r.problem for r in rows)


def test_cross_references(spark, tmp_path):
    (tmp_path / "x.xrf").write_text("! list\nabbreviation: EMBL\nshorthand_name: em\nlocal_id_syntax: [A-Z]{2}[0-9]+\n\nabbreviation: Other\ndatabase: any\n\nabbreviation: EMBL\n\nstrange: 1\ndatabase: lost\n")
    databases, problems = SO.read_xrf(spark, str(tmp_path / "x.xrf"))
    assert sorted((r.line, r.problem.split()[0]) for r in problems.collect()) == [(9, "duplicate"), (11, "required"), (11, "unknown")]
    features = spark.createDataFrame([(1, ["EMBL:AA12", "em:BB3"]), (2, ["EMBL:12"]), (3, ["Other:?:x"]), (4, ["none:1", "plain"]), (5, None)], "line int, dbxrefs array<string>")
    assert sorted((r.line, r.problem.split()[0]) for r in O.reference_problems(features, databases).collect()) == [(2, "id"), (4, "not"), (4, "unknown")]


@pytest.mark.parametrize("width", [1, 8, 64])
def test_overlaps_of_ranges_of_all_lengths(spark, width):
    rng = random.Random(42)
    rows = lambda n, first: [(first + i, "ab"[i % 2], s, s + int(2 ** rng.uniform(-1, 14))) for i in range(n) for s in [rng.randrange(-50, 3000)]]
    a, b = rows(60, 0), rows(70, 100) + [(900, "a", 10, 10**9), (901, "b", 64, 127), (902, "b", 64, 191)]
    x, y = spark.createDataFrame(a, "i int, k string, start long, end long"), spark.createDataFrame(b, "j int, k string, start2 long, end2 long")
    got = sorted((r.i, r.j) for r in J.overlap_join(x, y, ["k"], width).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    assert J.overlap_join(x.where("false"), y, ["k"], width).count() == 0


def test_joins_of_reads_by_hash(spark):
    rng = random.Random(43)
    genome = bases(rng, 300)
    reads = [(i, genome[p : p + rng.randrange(20, 60)]) for i, p in enumerate(rng.sample(range(280), 40))]
    reads += [(100, reads[0][1]), (101, reads[1][1].upper()), (102, turned(reads[2][1])), (103, "a" * 40), (104, "a" * 30), (105, ""), (106, None), (107, "acg"), (108, "nn" + genome[50:80] + "é")]
    df = spark.createDataFrame(reads, "seqnum long, seq string")
    low = {i: (s or "").lower() for i, s in reads}
    want = sorted((i, j, n) for i, s in low.items() for j, t in low.items() for n in range(12, min(len(s), len(t)) + 1) if s.endswith(t[:n]) and not (i == j and n == len(s)))
    assert sorted(map(tuple, K.suffix_prefix_matches(df, 12).collect())) == want
    held = {j for j, t in low.items() if len(t) >= 12 and any(i != j and (t in s or turned(t) in s) and (len(s) > len(t) or i < j) for i, s in low.items())}
    assert {r.seqnum for r in K.contained_reads(df, 12).collect()} == held
