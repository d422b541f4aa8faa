"""GFF3 files through the whole chain: checked, in order, with new ids and terminators."""

import pytest

from spanloom.sources import gff3_trees as T
from spanloom.sources.annotation import read_gff3


@pytest.fixture(autouse=True)
def _shared(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "check"))


def through(spark, tmp_path, *texts, **options):
    paths = []
    for k, t in enumerate(texts):
        paths.append(str(tmp_path / f"in{k}.gff3"))
        with open(paths[-1], "w") as f:
            f.write(t)
    lines, problems = T.chain(spark, *paths, **options)
    out = lines.orderBy("k", "seqid", "at", "tree", "last", "path").collect()
    return [r.line for r in out], sorted((r.ord, r.reason) for r in problems.collect()), lines


def row(kind, start, end, attributes, seqid="s", phase="."):
    return f"{seqid}\tx\t{kind}\t{start}\t{end}\t.\t+\t{phase}\t{attributes}"


HEAD = "##gff-version 3\n##sequence-region s 1 1000\n"


def test_order_ids_and_terminators(spark, tmp_path):
    one = HEAD + "\n".join([
        row("exon", 300, 400, "Parent=m2"), row("gene", 100, 500, "ID=g;Name=n"), row("mRNA", 100, 500, "Parent=g;ID=m2"), row("exon", 100, 200, "Parent=m2,m1"),
        row("mRNA", 100, 450, "ID=m1;Parent=g"), row("CDS", 350, 380, "ID=c;Parent=m1", phase="0"), row("CDS", 120, 149, "ID=c;Parent=m1", phase="0"), "###", row("gene", 20, 30, "ID=alone"), "###", row("gene", 600, 700, "ID=g2"), row("exon", 600, 700, "Parent=g2"),
    ]) + "\n"
    two = "##gff-version 3\n##sequence-region a 5 9\n" + row("gene", 5, 9, "ID=g", "a") + "\n" + row("exon", 6, 7, "Parent=g", "a") + "\n"
    lines, problems, made = through(spark, tmp_path, one, two)
    assert not problems
    assert lines == [
        "##gff-version 3", "##sequence-region   a 5 9", "##sequence-region   s 1 1000",
        row("gene", 5, 9, "ID=gene1", "a"), row("exon", 6, 7, "Parent=gene1", "a"), "###",
        row("gene", 20, 30, "."),
        row("gene", 100, 500, "ID=gene2;Name=n"), row("mRNA", 100, 500, "ID=mRNA1;Parent=gene2"), row("exon", 100, 200, "Parent=mRNA1,mRNA2"), row("exon", 300, 400, "Parent=mRNA1"),
        row("mRNA", 100, 450, "ID=mRNA2;Parent=gene2"), row("CDS", 120, 149, "ID=CDS1;Parent=mRNA2", phase="0"), row("CDS", 350, 380, "ID=CDS1;Parent=mRNA2", phase="0"), "###",
        row("gene", 600, 700, "ID=gene3"), row("exon", 600, 700, "Parent=gene3"), "###",
    ]
    T.write_trees(made, str(tmp_path / "out"))
    again, told = T.chain(spark, str(tmp_path / "out"))
    assert [r.line for r in again.orderBy("k", "seqid", "at", "tree", "last", "path").collect()] == lines and told.count() == 0
    assert read_gff3(spark, str(tmp_path / "out"))["features"].count() == 12


def test_ids_may_stay(spark, tmp_path):
    text = HEAD + "\n".join([row("gene", 1, 9, "ID=old"), row("exon", 1, 9, "Parent=old;Note=a%3Bb")]) + "\n"
    lines, _, _ = through(spark, tmp_path, text, retain_ids=True)
    assert lines[2:] == [row("gene", 1, 9, "ID=old"), row("exon", 1, 9, "Parent=old;Note=a%3Bb"), "###"]


def test_what_is_wrong_is_told_and_left_out(spark, tmp_path):
    text = HEAD + "\n".join([
        row("gene", 1, 9, "ID=g"), row("mRNA", 1, 9, "ID=m;Parent=nowhere"), row("exon", 1, 9, "Parent=m"), row("exon", 2, 3, "Parent=g"), row("gene", 900, 1200, "ID=far"), row("gene", 9, 1, "ID=back"),
        row("exon", 1, 2, "ID=p;Parent=q"), row("exon", 1, 2, "ID=q;Parent=p"),
    ]) + "\n"
    lines, problems, _ = through(spark, tmp_path, text)
    assert lines[2:] == [row("gene", 1, 9, "ID=gene1"), row("exon", 2, 3, "Parent=gene1"), "###"]
    told = " ".join(reason for _, reason in problems)
    assert len({o for o, _ in problems}) == 5 and all(x in told for x in ("not defined", "not contained", "start is larger", "cycle"))


def test_no_features(spark, tmp_path):
    lines, problems, _ = through(spark, tmp_path, "##gff-version 3\n")
    assert lines == ["##gff-version 3"] and not problems
