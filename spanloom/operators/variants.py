"""Single-base variants joined with the genes they fall into: clusters of overlapping genes, coding parts, codons, effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import sequences as S
from spanloom.operators import joins as J
from spanloom.operators import sequences as Q


def coding_places(cds: DataFrame) -> DataFrame:
    """`cds` (parent, seqid, start, end, strand) with `before`, the coding bases of its transcript that are read before each part."""
    first = F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))
    w = Window.partitionBy("parent", "seqid", "strand").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    return cds.withColumn("before", F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(w), F.lit(0)))


def gene_clusters(genes: DataFrame) -> DataFrame:
    """(seqid, gene_id, cluster): overlapping genes share the start of the island that they form."""
    w = Window.partitionBy("seqid").orderBy("start", "end", "gene_id").rowsBetween(Window.unboundedPreceding, -1)
    g = genes.withColumn("__new", F.when(F.col("start") <= F.max("end").over(w), None).otherwise(F.col("start")))
    return g.select("seqid", "gene_id", F.max("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cluster"))


def annotate(snps: DataFrame, genes: DataFrame, cds: DataFrame, seqs: DataFrame, code: int = 1) -> DataFrame:
    """(snp_id, seqid, pos, alt, cluster, gene_id, parent, cds_pos, codon, new_codon, aa, new_aa, effect, ref_ok).

    snps (snp_id, seqid, pos 1-based, ref, alt) on the forward strand, genes (gene_id, seqid, start, end), cds (parent, gene_id, seqid, start,
    end, strand), seqs (seqnum = seqid, seq). A variant has a row for each transcript of which it lies in a coding part: the part gives its
    place in the coding sequence, that its codon. `ref_ok` is false where the sequence holds another base than `ref`. Variants outside
    of coding parts, and in codons that a coding sequence does not end, have no row.
    """
    parts = coding_places(cds.select("parent", "seqid", "start", "end", "strand"))
    at = J.point_join(parts, snps.select("snp_id", "seqid", F.col("pos").alias("point"), "ref", "alt"), ["seqid"])
    minus = F.col("strand") == "-"
    place = F.col("before") + F.when(minus, F.col("end") - F.col("point")).otherwise(F.col("point") - F.col("start"))
    turned = lambda c: F.when(minus, S.complement(c)).otherwise(F.col(c))
    fields = [place.cast("long").alias("pos"), turned("alt").alias("alt"), "snp_id", F.col("point").alias("at"), F.col("alt").alias("base"), turned("ref").alias("expected")]
    # All changes of a transcript travel as one row, so sequences and owners meet transcripts, not variants.
    changes = at.where("alt IS NOT NULL").groupBy(F.col("parent").alias("cds_id"), "seqid").agg(F.collect_list(F.struct(*fields)).alias("changes"))
    spliced = Q.spliced(cds.select("parent", F.col("seqid").alias("seqnum"), "start", "end", "strand"), seqs).select(F.col("parent").alias("cds_id"), "seq")
    owner = cds.select(F.col("parent").alias("cds_id"), "seqid", "gene_id").distinct().join(gene_clusters(genes), ["seqid", "gene_id"])
    of = changes.join(owner, ["cds_id", "seqid"]).join(spliced, "cds_id").select(F.struct("cds_id", "seqid", "gene_id", "cluster").alias("cds_id"), "seq", "changes")
    found = Q.effects_of_changes(of, code)
    base = F.substring("codon", (F.col("pos") % 3 + 1).cast("int"), F.lit(1))
    return found.select(
        "snp_id", "cds_id.seqid", F.col("at").alias("pos"), F.col("base").alias("alt"), "cds_id.cluster", "cds_id.gene_id", F.col("cds_id.cds_id").alias("parent"), F.col("pos").alias("cds_pos"),
        "codon", "new_codon", "aa", "new_aa", "effect", (F.lower(base) == F.lower("expected")).alias("ref_ok"),
    )


def effect_attributes(annotated: DataFrame) -> DataFrame:
    """(snp_id, variant_effect): the effects of each variant as one attribute, `effect:parent` by commas in order."""
    each = F.concat_ws(":", "effect", F.col("parent").cast("string"))
    return annotated.groupBy("snp_id").agg(F.array_join(F.array_sort(F.collect_set(each)), ",").alias("variant_effect"))
