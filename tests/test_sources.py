"""Readers, writers and streams on small hand-made files."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from spanloom.sources import annotation as A
from spanloom.sources import sequences as Q
from spanloom.streaming import islands

GFF3 = """##gff-version 3
##sequence-region   ctg123 1 1497228
ctg123\t.\tgene\t1000\t9000\t0.5\t+\t.\tID=gene1;Note=a%3Bb,c
ctg123\t.\tmRNA\t1050\t9000\t.\t+\t.\tID=mRNA1;Parent=gene1
ctg123\t.\texon\t1050\t1500\t.\t+\t.\tParent=mRNA1
###
ctg123\t.\texon\t20\t10\t.\t+\t.\tParent=lost
ctg123\t.\texon\tx\t10\t.\t+\t.\t.
##FASTA
>ctg123 whole
acgt
acg
"""


def test_gff3(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(GFF3)
    got = A.read_gff3(spark, str(tmp_path / "a.gff3"))
    rows = got["features"].orderBy("ord").collect()
    assert [(r.type, r.start, r.end) for r in rows] == [("gene", 1000, 9000), ("mRNA", 1050, 9000), ("exon", 1050, 1500)]
    assert rows[0].attributes["Note"] == "a;b,c" and rows[0].score == 0.5 and rows[2].parent_ids == ["mRNA1"]
    assert [tuple(r)[:3] for r in got["regions"].collect()] == [("ctg123", 1, 1497228)]
    assert sorted(r.reason for r in got["problems"].collect()) == ["could not parse integer", "start is larger than end"]
    assert [(r.description, r.seq) for r in got["sequences"].collect()] == [("ctg123 whole", "acgtacg")]
    assert A.undefined_parents(got["features"]).count() == 0
    A.write_gff3(got["features"], got["regions"].select("seqid", "start", "end"), str(tmp_path / "out"))
    again = A.read_gff3(spark, str(tmp_path / "out"))["features"].orderBy("ord").collect()
    assert [(r.type, r.start, r.end, r.feature_id) for r in again] == [(r.type, r.start, r.end, r.feature_id) for r in rows]


def test_gtf_and_bed(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('s\tx\texon\t5\t9\t.\t+\t.\tgene_id "g"; transcript_id "t";\ns\tx\texon\t20\t30\t.\t+\t.\tgene_id "g"; transcript_id "t";\ns\tx\tgene\t1\t2\t.\t+\t.\t.\n')
    rows = A.read_gtf(spark, str(tmp_path / "a.gtf")).collect()
    assert sorted((r.type, r.start, r.end) for r in rows) == [("exon", 5, 9), ("exon", 20, 30), ("gene", 5, 30), ("mRNA", 5, 30)]
    (tmp_path / "a.bed").write_text("track name=x\nchr1 9 30 f 1 + 12 20 0 2 5,6 0,15\nchr1 4 4\n")
    rows = A.read_bed(spark, str(tmp_path / "a.bed")).collect()
    assert sorted((r.type, r.start, r.end) for r in rows) == [("BED_block", 10, 14), ("BED_block", 25, 30), ("BED_feature", 10, 30), ("BED_thick_feature", 13, 20)]


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nacg\ntt\n>two\nggg\n")
    df = Q.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {tuple(r) for r in df.collect()} == {("one x", "acgtt"), ("two", "ggg")}
    assert sorted(r.value for r in Q.fasta_lines(df, 2).collect()) == [">one x\nac\ngt\nt", ">two\ngg\ng"]
    (tmp_path / "a.fq").write_text("@r1\nacgt\n+\nIIII\n@r2\nac\n+r2\nII\n")
    assert {tuple(r) for r in Q.read_fastq(spark, str(tmp_path / "a.fq"))["records"].drop("file").collect()} == {("r1", "acgt", "IIII"), ("r2", "ac", "II")}
    (tmp_path / "a.sam").write_text("@SQ\tSN:seq1\tLN:16\nr\t16\tseq1\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\n")
    r = Q.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert r.pos == 3 and r.is_reverse and not r.is_unmapped
    (tmp_path / "a.m").write_text("# x\nq\ts\t99.0\t10\t0\t0\t1\t10\t30\t21\t1e-5\t40\n")
    m = Q.read_matches(spark, str(tmp_path / "a.m")).first()
    assert (m.s_start, m.s_end, m.strand) == (21, 30, "-")


def test_session_islands(spark, tmp_path):
    rows = [("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:00:05"), ("k", "2024-01-01 00:10:00")]
    spark.createDataFrame(rows, "k string, t string").selectExpr("k", "CAST(t AS timestamp) AS t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    q = islands.session_islands(stream, "k", "t", "1 minute", "1 minute").writeStream.format("memory").queryName("isl").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.sql("SELECT n FROM isl").collect()) == [1, 2]


@given(st.lists(st.tuples(st.text("abc @+", max_size=4), st.text("acgt", min_size=1, max_size=9), st.integers(1, 9), st.booleans()), max_size=8), st.randoms(use_true_random=False))
def test_fastq_keeps_every_record(records, rng):
    want, text = [], ""
    for head, seq, width, twice in records:
        qual = "".join(rng.choice("@+I!~#") for _ in seq)
        cut = lambda x, width=width: "\n".join(x[i : i + width] for i in range(0, len(x), width))
        text += f"@{head}\n{cut(seq)}\n+{head if twice else ''}\n{cut(qual)}\n"
        want.append((head, seq, qual, None))
    assert Q.fastq_records(text) == want


def test_fastq_tells_what_is_wrong():
    assert Q.fastq_records("@a\nac\n+b\nII\n")[0][3] == "header of the qualities differs"
    assert Q.fastq_records("@a\nac")[0][3] == "record has no qualities"
    assert Q.fastq_records("junk\n@a\nac\n+\nII\n")[1] == ("a", "ac", "II", None)
    assert Q.fastq_records("@a\nacgt\n+\nII")[0][3] == "qualities and sequence differ in length"


HEAD = "##gff-version 3\n"
F9 = "s\t.\t{type}\t{start}\t{end}\t.\t+\t{phase}\t{att}\n"


def line(type="gene", start=1, end=9, phase=".", att="."):
    return F9.format(type=type, start=start, end=end, phase=phase, att=att)


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (line(), "does not begin with ##gff-version"),
        ("##gff-version 2\n" + line(), "version does not equal required version 3"),
        ("##gff-version\n" + line(), "illegal GFF version pragma"),
        (HEAD + line(att="ID=a;ID=b"), "more than one attribute of one tag"),
        (HEAD + line(att="ID=a=b"), "attribute does not contain exactly one ="),
        (HEAD + line(att="=b"), "attribute has no tag"),
        (HEAD + line(att="ID="), "attribute has no value"),
        (HEAD + line(att="Foo=1"), "illegal uppercase attribute"),
        (HEAD + line(att="Target=x 1"), "Target must have 3 or 4 entries"),
        (HEAD + line(att="Target=x 9 1"), "Target start is larger than end"),
        (HEAD + line(att="Target=x 1 9;Gap=M8 Q3"), "illegal Gap code"),
        (HEAD + line(att="Is_circular=maybe"), "Is_circular must be true"),
        (HEAD + "##sequence-region s 9 1\n", "illegal region start: start is larger than end"),
        (HEAD + line(start=0), "illegal feature start"),
        (HEAD + line(start="x"), "could not parse integer"),
        (HEAD + line(phase=4), "unknown phase"),
    ],
)
def test_gff3_line_rules(spark, tmp_path, text, reason):
    (tmp_path / "a.gff3").write_text(text)
    assert [r.reason for r in A.read_gff3(spark, str(tmp_path / "a.gff3"))["problems"].collect()] == [reason]


def test_gff3_tidy(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(line(att="ID=a;Note=x;Note=y;Empty=") + line(att="Foo=1"))
    got = A.read_gff3(spark, str(tmp_path / "a.gff3"), tidy=True)
    assert got["problems"].count() == 0 and got["features"].count() == 2
    assert {r.attributes.get("Note") for r in got["features"].collect()} == {"x,y", None}


def test_gff3_structure_rules(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "check"))
    cases = {
        "Parent was not defined": line(att="Parent=x"),
        "Parent refers to itself": line(att="ID=a;Parent=a"),
        "has different sequence id than its Parent": line(att="ID=a") + line("exon", att="Parent=a").replace("s\t", "t\t", 1),
        "parts of one ID are on different sequences": line(att="ID=a") + line(att="ID=a").replace("s\t", "t\t", 1),
        "parts of one ID have different Parents": line(att="ID=p") + line(att="ID=q") + line("exon", att="ID=a;Parent=p") + line("exon", att="ID=a;Parent=q"),
        "parts of one ID have different types": line(att="ID=a") + line("exon", att="ID=a"),
        "ID was used before a terminator": line(att="ID=a") + "###\n" + line(att="ID=a"),
        "is not contained in range of its region": "##sequence-region s 1 5\n" + line(),
        "comes before the corresponding region line": line() + "##sequence-region s 1 50\n",
        "has the wrong phase": line(att="ID=m") + line("CDS", 1, 4, 0, "Parent=m") + line("CDS", 6, 9, 1, "Parent=m"),
        "CDS has no phase": line(att="ID=m") + line("CDS", 1, 4, ".", "Parent=m"),
    }
    fine = line(att="ID=m") + line("CDS", 1, 4, 0, "Parent=m") + line("CDS", 6, 9, 2, "Parent=m") + line("exon", att="ID=e;Parent=m") + "###\n" + line(att="ID=o") + line(att="ID=o")
    for k, (reason, text) in enumerate([*cases.items(), (None, fine), ("Parent was not defined", line(att="ID=a") + "###\n" + line("exon", att="Parent=a")), (None, "##sequence-region s 1 5\n" + line("region", att="Is_circular=true"))]):
        (tmp_path / f"{k}.gff3").write_text(HEAD + text)
        got = A.read_gff3(spark, str(tmp_path / f"{k}.gff3"))
        assert {r.reason for r in A.structure_problems(got["features"], got["regions"]).collect()} == ({reason} if reason else set()), text
    (tmp_path / "c.gff3").write_text(HEAD + line(att="ID=a;Parent=b") + line(att="ID=b;Parent=a") + line(att="Parent=b") + line(att="ID=r") + line(att="ID=x;Parent=r") + line(att="Parent=x"))
    assert A.cyclic_features(A.read_gff3(spark, str(tmp_path / "c.gff3"))["features"]).count() == 3
