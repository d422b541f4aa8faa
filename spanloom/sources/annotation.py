"""Readers and writers of annotation formats: GFF3, GTF 2.2, BED, and an attribute-safe GFF3 sink.

Lines come from Spark's text source (gz and bz2 included), carry their file and an ordinal, and are
parsed by expressions. A reader returns all well-formed rows; `problems` returns the others with a
reason, so strict callers refuse and tolerant ones go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import sequences as S
from spanloom.session import with_checkpoints


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, ord, line): ord orders the lines of all files as Spark reads them."""
    t = spark.read.text(list(paths))
    return t.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "\r$", "").alias("line"))


class _Cells:
    """Columns of a split line; null where a line is too short."""

    def __getitem__(self, i: int) -> Column:
        return F.get(F.col("f"), F.lit(i))


def _fields(df: DataFrame) -> DataFrame:
    return df.withColumn("f", F.split("line", "\t", -1))


def _score(c: Column) -> Column:
    return F.when(c != ".", c.try_cast("float"))


def gff3_attributes(text: Column) -> Column:
    """tag=value;... as a map; values percent-decoded, a repeated tag keeps its values joined by commas."""
    pairs = F.filter(F.split(text, ";"), lambda p: F.trim(p).contains("="))
    entry = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.substring(p, F.locate("=", p) + 1, F.length(p)).alias("value"))
    entries = F.transform(pairs, entry)
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    values = F.transform(keys, lambda k: S.unescape_gff3(F.array_join(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"]), ",")))
    return F.when((text == ".") | (text == ""), F.create_map().cast("map<string,string>")).otherwise(F.map_from_arrays(keys, values))


def _with_blocks(text: DataFrame) -> DataFrame:
    """`block`: how many ### lines of its file stand before a line.

    The lines of a read partition are counted among themselves, after the counts of the partitions before it.
    """
    part = text.withColumn("part", F.shiftright("ord", 33)).withColumn("mark", (F.col("line") == "###").cast("int"))
    sums = part.groupBy("file", "part").agg(F.sum("mark").alias("marks"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = sums.select("file", "part", F.coalesce(F.sum("marks").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("file", "part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return part.withColumn("nth", F.sum("mark").over(inside)).join(begin, ["file", "part"]).withColumn("block", F.col("begin") + F.col("nth")).drop("part", "mark", "nth", "begin")


def _feature_lines(text: DataFrame) -> DataFrame:
    """Feature lines with their block; lines after ##FASTA or a > are none."""
    fasta = text.where((F.col("line") == "##FASTA") | F.col("line").startswith(">")).groupBy("file").agg(F.min("ord").alias("fasta"))
    t = _with_blocks(text).join(fasta, "file", "left").where(F.col("fasta").isNull() | (F.col("ord") < F.col("fasta")))
    return t.where(~F.col("line").startswith("#") & (F.trim("line") != "")).drop("fasta")


# Attributes that begin with a capital, and all that the format knows of these.
_KNOWN_ATTRIBUTES = ("ID", "Name", "Alias", "Parent", "Target", "Gap", "Derives_from", "Note", "Dbxref", "Ontology_term", "Is_circular", "Start_range", "End_range")


def _attribute_problem(text: Column, tidy: bool) -> Column:
    """What is wrong with an attribute column, or null; a tidy reader takes what can be mended."""
    pairs = F.filter(F.split(text, ";"), lambda p: F.trim(p) != "")
    signs = lambda p: F.length(p) - F.length(F.replace(p, F.lit("="), F.lit("")))
    tag = lambda p: F.trim(F.substring_index(p, "=", 1))
    tags = F.transform(pairs, tag)
    value = lambda t: F.regexp_extract(text, f"(?:^|;) *{t}=([^;]*)", 1)
    target, gap, circular = value("Target"), value("Gap"), value("Is_circular")
    parts = F.split(F.trim(target), " +")
    reason = (
        F.when(F.exists(pairs, lambda p: signs(p) != 1), "attribute does not contain exactly one =").when(F.exists(pairs, lambda p: tag(p) == ""), "attribute has no tag")
        .when((target != "") & ~F.size(parts).isin(3, 4), "Target must have 3 or 4 entries")
        .when((target != "") & (F.get(parts, F.lit(1)).try_cast("long").isNull() | F.get(parts, F.lit(2)).try_cast("long").isNull()), "could not parse Target")
        .when((target != "") & (F.get(parts, F.lit(1)).try_cast("long") > F.get(parts, F.lit(2)).try_cast("long")), "Target start is larger than end")
        .when((target != "") & (F.size(parts) == 4) & ~F.get(parts, F.lit(3)).isin("+", "-"), "unknown Target strand")
        .when((gap != "") & ~gap.rlike(r"^[MIDFR][0-9]+( [MIDFR][0-9]+)*$"), "illegal Gap code")
        .when((circular != "") & (circular != "true"), "Is_circular must be true")
    )
    if tidy:
        return F.when(text != ".", reason)
    reason = (
        reason.when(F.exists(pairs, lambda p: F.trim(F.substring_index(p, "=", -1)) == ""), "attribute has no value")
        .when(F.size(F.array_distinct(tags)) != F.size(tags), "more than one attribute of one tag")
        .when(F.exists(tags, lambda t: t.rlike("^[A-Z]") & ~t.isin(*_KNOWN_ATTRIBUTES)), "illegal uppercase attribute")
    )
    return F.when(text != ".", reason)


def header_problems(text: DataFrame) -> DataFrame:
    """Files whose first line is no ##gff-version 3, as problem rows (file, ord, line, reason)."""
    first = text.groupBy("file").agg(F.min(F.struct("ord", "line")).alias("x")).select("file", "x.ord", "x.line")
    version = F.regexp_extract("line", r"^##gff-version\s+(\S+)\s*$", 1)
    reason = F.when(~F.col("line").startswith("##gff-version"), "does not begin with ##gff-version").when(version == "", "illegal GFF version pragma").when(~version.rlike(r"^3(\.|$)"), "version does not equal required version 3")
    return first.withColumn("reason", reason).where("reason IS NOT NULL")


def cyclic_features(features: DataFrame) -> DataFrame:
    """(file, ord) of features on or below a cycle of parents: whatever never loses its last parent as roots are taken away.

    One join for each level of the deepest tree.
    """
    with_checkpoints(features.sparkSession)
    edges = features.select("file", "block", "ord", F.col("feature_id").alias("id"), F.explode("parent_ids").alias("parent")).checkpoint()
    while True:
        held = edges.select("file", "block", F.col("id").alias("parent")).where("parent IS NOT NULL").distinct()
        left = edges.join(held, ["file", "block", "parent"], "left_semi").checkpoint()
        if left.count() == edges.count():
            return left.select("file", "ord").distinct()
        edges = left


def structure_problems(features: DataFrame, regions: DataFrame) -> DataFrame:
    """(file, ord, reason) of features that do not fit together: parents, parts of one id, regions and phases.

    Parents and parts are looked for between two ### lines, as the format has it.
    """
    key = ["file", "block"]
    say = lambda df, reason: df.select("file", "ord", F.lit(reason).alias("reason"))
    named = features.select(*key, "ord", "seqid", F.col("feature_id").alias("own"), F.explode("parent_ids").alias("id"))
    ids = features.where("feature_id IS NOT NULL").groupBy(*key, F.col("feature_id").alias("id")).agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("parts"), F.min("seqid").alias("seqid_1"), F.max("seqid").alias("seqid_2"), F.count_distinct(F.concat_ws(",", "parent_ids")).alias("parents"), F.count_distinct("type").alias("types"))
    met = named.join(ids, [*key, "id"], "left")
    found = say(met.where("first IS NULL"), "Parent was not defined")
    found = found.unionByName(say(met.where("id = own"), "Parent refers to itself"))
    found = found.unionByName(say(met.where("seqid <> seqid_1"), "has different sequence id than its Parent"))
    several = ids.where("parts > 1").select(*key, "id", F.col("last").alias("ord"), "seqid_1", "seqid_2", "parents", "types")
    found = found.unionByName(say(several.where("seqid_1 <> seqid_2"), "parts of one ID are on different sequences"))
    found = found.unionByName(say(several.where("parents > 1"), "parts of one ID have different Parents"))
    found = found.unionByName(say(several.where("types > 1"), "parts of one ID have different types"))
    # The same ID on both sides of a ### names two features.
    again = ids.groupBy("file", "id").agg(F.count("*").alias("blocks"), F.max("last").alias("ord")).where("blocks > 1")
    found = found.unionByName(say(again, "ID was used before a terminator"))
    r = regions.groupBy("file", "seqid").agg(F.min("start").alias("r_start"), F.max("end").alias("r_end"), F.min("ord").alias("r_ord"))
    circular = features.where(F.col("attributes")["Is_circular"] == "true").select("file", "seqid").distinct().withColumn("circular", F.lit(True))
    placed = features.join(r, ["file", "seqid"]).join(circular, ["file", "seqid"], "left")
    found = found.unionByName(say(placed.where("circular IS NULL AND (start < r_start OR end > r_end)"), "is not contained in range of its region"))
    found = found.unionByName(say(placed.where("ord < r_ord"), "comes before the corresponding region line"))
    # Phases of the CDS parts of one parent, in reading direction: what is left of the codon before.
    cds = features.where("type = 'CDS'").select(*key, "ord", "seqid", "start", "end", "strand", "phase", F.explode("parent_ids").alias("parent"))
    w = Window.partitionBy(*key, "parent", "seqid").orderBy(F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start")), "ord")
    read = F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)) - F.first("phase").over(w), F.lit(0))
    want = F.when(F.row_number().over(w) == 1, F.col("phase")).otherwise(F.pmod(-read, F.lit(3)).cast("int"))
    phases = cds.withColumn("want", want)
    found = found.unionByName(say(phases.where("phase IS NULL"), "CDS has no phase")).unionByName(say(phases.where("phase <> want"), "has the wrong phase"))
    return found.distinct()


def read_gff3(spark: SparkSession, *paths: str, tidy: bool = False) -> dict[str, DataFrame]:
    """features, regions, meta, sequences and problems of GFF3 files.

    features are the lines without a problem of their own; problems (file, ord, line, reason) has the
    others, wrong headers and wrong regions. How features fit together is the matter of
    `structure_problems` and `cyclic_features`. With `tidy` a missing header, attributes without value,
    repeated attributes (their values are joined) and unknown capitalised ones are taken.
    """
    text = lines(spark, *paths)
    rows = _fields(_feature_lines(text))
    f = _Cells()
    start, end = f[3].try_cast("long"), f[4].try_cast("long")
    # From here on a bad row has a reason; the first that holds is told.
    reason = (
        F.when(F.size("f") != 9, "line does not have nine columns").when(f[0].rlike(r"\s"), "blank in sequence name")
        .when(start.isNull() | end.isNull(), "could not parse integer").when(start < 1, "illegal feature start").when(start > end, "start is larger than end")
        .when(~f[6].isin("+", "-", ".", "?"), "unknown strand").when(~f[7].isin("0", "1", "2", "."), "unknown phase")
        .when((f[5] != ".") & f[5].try_cast("float").isNull(), "could not parse score")
    )
    rows = rows.withColumn("reason", F.coalesce(reason, _attribute_problem(f[8], tidy)))
    good = rows.where("reason IS NULL").select("file", "ord", "block", "line", "f")
    a = gff3_attributes(f[8])
    features = good.select(
        "file", "ord", "block", f[0].alias("seqid"), F.when(f[1] != ".", S.unescape_gff3(f[1])).alias("source"), f[2].alias("type"), start.alias("start"), end.alias("end"), _score(f[5]).alias("score"),
        f[6].alias("strand"), F.when(f[7] != ".", f[7].try_cast("int")).alias("phase"), a.alias("attributes"),
    )
    features = features.withColumn("feature_id", F.col("attributes")["ID"]).withColumn("parent_ids", F.when(F.col("attributes")["Parent"].isNotNull(), F.split(F.col("attributes")["Parent"], ",")).otherwise(F.array().cast("array<string>")))
    r = F.split(F.regexp_replace("line", r"\s+", " "), " ")
    regions = text.where(F.col("line").startswith("##sequence-region")).select(r[1].alias("seqid"), r[2].try_cast("long").alias("start"), r[3].try_cast("long").alias("end"), "ord", "file", "line")
    wrong = F.when(F.col("start").isNull() | F.col("end").isNull(), "could not parse integer").when(F.col("start") > F.col("end"), "illegal region start: start is larger than end").when(F.col("start") < 1, "illegal region start")
    problems = rows.where("reason IS NOT NULL").select("file", "ord", "line", "reason").unionByName(regions.withColumn("reason", wrong).where("reason IS NOT NULL").select("file", "ord", "line", "reason"))
    heads = header_problems(text)
    problems = problems.unionByName(heads.where(~F.col("reason").startswith("does not begin")) if tidy else heads)
    regions = regions.where(wrong.isNull()).drop("line")
    meta = text.where(F.col("line").startswith("##") & ~F.col("line").startswith("###") & ~F.col("line").startswith("##sequence-region")).select(F.substring_index(F.substring("line", 3, 1 << 20), " ", 1).alias("directive"), F.regexp_extract("line", r"^##\S+\s+(.*)$", 1).alias("data"), "ord")
    from spanloom.sources.sequences import fasta_records

    fasta = text.where((F.col("line") == "##FASTA") | F.col("line").startswith(">")).groupBy("file").agg(F.min("ord").alias("fasta"))
    embedded = text.join(fasta, "file").where((F.col("ord") >= F.col("fasta")) & (F.col("line") != "##FASTA")).select("file", "ord", "line")
    return {"features": features, "regions": regions, "meta": meta, "sequences": fasta_records(embedded), "problems": problems}


def undefined_parents(features: DataFrame) -> DataFrame:
    """Parents that features name and no feature has as its id."""
    named = features.select("ord", F.explode("parent_ids").alias("parent"))
    return named.join(features.select(F.col("feature_id").alias("parent")).distinct(), "parent", "left_anti")


def gff3_lines(features: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features as GFF3 lines, in order of ord; with `keep` these columns beside the lines, in any order."""
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), F.when(e["key"].isin("Parent", "Dbxref", "Alias", "Note", "Ontology_term"), F.array_join(F.transform(F.split(e["value"], ","), S.escape_gff3), ",")).otherwise(S.escape_gff3(e["value"]))))
    text = F.coalesce(F.nullif(F.array_join(pairs, ";"), F.lit("")), F.lit("."))
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    line = F.concat_ws("\t", "seqid", dot("source"), "type", F.col("start").cast("string"), F.col("end").cast("string"), dot("score"), dot("strand"), dot("phase"), text).alias("line")
    return features.select(*keep, line) if keep else features.orderBy("ord").select(line)


def write_gff3(features: DataFrame, regions: DataFrame, path: str) -> None:
    """One GFF3 file: header, regions, features by place. A file is one task by nature; write Parquet for anything large."""
    head = features.sparkSession.createDataFrame([("##gff-version 3", 0, "", 0, 0)], "line string, k int, seqid string, start long, ord long")
    r = regions.select(F.format_string("##sequence-region   %s %s %s", "seqid", "start", "end").alias("line"), F.lit(1).alias("k"), "seqid", "start", F.lit(0).cast("long").alias("ord"))
    made = gff3_lines(features)
    cell = F.split("line", "\t")
    body = made.select("line", F.lit(2).alias("k"), cell[0].alias("seqid"), cell[3].cast("long").alias("start"), F.monotonically_increasing_id().alias("ord"))
    head.unionByName(r).unionByName(body).orderBy("k", "seqid", "start", "ord").select("line").coalesce(1).write.mode("error").text(path)


def read_gtf(spark: SparkSession, *paths: str) -> DataFrame:
    """CDS, exon and codon rows of GTF, with genes and mRNAs as the hulls of their gene_id and transcript_id."""
    f = _Cells()
    rows = _fields(lines(spark, *paths).where(~F.col("line").startswith("#") & (F.trim("line") != ""))).where((F.size("f") >= 9) & f[2].isin("CDS", "exon", "start_codon", "stop_codon"))
    tag = lambda t: F.regexp_extract(f[8], rf'{t}\s+"([^"]*)"', 1)
    parts = rows.select("ord", f[0].alias("seqid"), f[1].alias("source"), f[2].alias("type"), f[3].try_cast("long").alias("start"), f[4].try_cast("long").alias("end"), _score(f[5]).alias("score"), f[6].alias("strand"), F.when(f[7] != ".", f[7].try_cast("int")).alias("phase"), tag("gene_id").alias("gene_id"), tag("transcript_id").alias("transcript_id"))
    hull = lambda by, kind: parts.groupBy("seqid", "source", "strand", *by).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("ord").alias("ord")).withColumn("type", F.lit(kind))
    return parts.unionByName(hull(["gene_id", "transcript_id"], "mRNA"), allowMissingColumns=True).unionByName(hull(["gene_id"], "gene"), allowMissingColumns=True)


def gtf_lines(parts: DataFrame) -> DataFrame:
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return parts.orderBy("ord").select(F.concat_ws("\t", "seqid", dot("source"), "type", F.col("start").cast("string"), F.col("end").cast("string"), dot("score"), dot("strand"), dot("phase"), F.format_string('gene_id "%s"; transcript_id "%s";', "gene_id", "transcript_id")).alias("line"))


def read_bed(spark: SparkSession, *paths: str, feature: str = "BED_feature", thick: str = "BED_thick_feature", block: str = "BED_block") -> DataFrame:
    """BED rows as 1-based closed features; thick parts and blocks are children of their row. Empty ranges are left out."""
    skip = F.col("line").rlike(r"^(track|browser|#)") | (F.trim("line") == "")
    rows = lines(spark, *paths).where(~skip).withColumn("f", F.split(F.trim("line"), r"\s+"))
    f, get = F.col("f"), lambda i: F.get("f", F.lit(i))
    base = rows.select("ord", f[0].alias("seqid"), (f[1].cast("long") + 1).alias("start"), f[2].cast("long").alias("end"), get(3).alias("name"), _score(get(4)).alias("score"), F.coalesce(get(5), F.lit(".")).alias("strand"), get(6).try_cast("long").alias("t0"), get(7).try_cast("long").alias("t1"), get(10).alias("sizes"), get(11).alias("starts")).where("start <= end")
    keep = ["ord", "seqid", "type", "start", "end", "name", "score", "strand"]
    whole = base.withColumn("type", F.lit(feature)).select(*keep)
    inner = base.where("t1 > t0").select("ord", "seqid", F.lit(thick).alias("type"), (F.col("t0") + 1).alias("start"), F.col("t1").alias("end"), "name", "score", "strand")
    z = F.explode(F.arrays_zip(F.split(F.rtrim(F.regexp_replace("sizes", ",$", "")), ",").alias("n"), F.split(F.regexp_replace("starts", ",$", ""), ",").alias("at")))
    blocks = base.where("sizes IS NOT NULL").select("ord", "seqid", "name", "score", "strand", F.col("start").alias("s0"), z.alias("z"))
    blocks = blocks.select("ord", "seqid", F.lit(block).alias("type"), (F.col("s0") + F.col("z.at").cast("long")).alias("start"), (F.col("s0") + F.col("z.at").cast("long") + F.col("z.n").cast("long") - 1).alias("end"), "name", "score", "strand")
    return whole.unionByName(inner).unionByName(blocks)
