"""Readers and writers of sequence and match formats: FASTA, FASTQ, GenBank, EMBL, SAM and match tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import sequences as S


def fasta_records(lines: DataFrame) -> DataFrame:
    """(file, ord, description, seq) of FASTA lines (file, ord, line); ord is the header's."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("ord")
    t = lines.withColumn("head", F.max(F.when(F.col("line").startswith(">"), F.col("ord"))).over(w)).where("head IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.when(~F.col("line").startswith(">"), F.struct("ord", "line"))))
    joined = t.groupBy("file", "head").agg(F.max(F.when(F.col("line").startswith(">"), F.substring("line", 2, 1 << 20))).alias("description"), F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["line"]), ""), r"\s", "").alias("seq"))
    return joined.select("file", F.col("head").alias("ord"), "description", "seq")


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(description, seq): records are cut at line starts with '>' by the text source itself, so large files split."""
    t = spark.read.option("lineSep", "\n>").text(list(paths))
    r = t.where(F.trim("value") != "").select(F.regexp_replace("value", "^>", "").alias("r"))
    return r.select(F.regexp_replace(F.substring_index("r", "\n", 1), "\r$", "").alias("description"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def fasta_lines(seqs: DataFrame, width: int = 60) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), "description", F.lit("\n"), S.wrap_fasta("seq", width)).alias("value"))


def fastq_records(text: str) -> list[tuple[str, str | None, str | None, str | None]]:
    """(description, seq, qual, reason) of FASTQ text; sequence and qualities may run over several lines.

    The qualities of a record are as long as its sequence, so a line of them that begins with @ or
    + is told from a header by what is still missing.
    """
    out, lines, k = [], text.split("\n"), 0
    lines = [x[:-1] if x.endswith("\r") else x for x in lines]
    while k < len(lines):
        if not lines[k]:
            k += 1
            continue
        if not lines[k].startswith("@"):
            out.append((lines[k], None, None, "record does not begin with @"))
            # Go on at the next line that may be a header.
            k += 1
            while k < len(lines) and not lines[k].startswith("@"):
                k += 1
            continue
        head, k, seq = lines[k][1:], k + 1, ""
        while k < len(lines) and not lines[k].startswith("+"):
            seq += lines[k]
            k += 1
        if k == len(lines):
            out.append((head, seq, None, "record has no qualities"))
            break
        again, k, qual = lines[k][1:], k + 1, ""
        while k < len(lines) and len(qual) < len(seq):
            qual += lines[k]
            k += 1
        if again and again != head:
            out.append((head, seq, qual, "header of the qualities differs"))
        elif len(qual) != len(seq):
            out.append((head, seq, qual, "qualities and sequence differ in length"))
        else:
            out.append((head, seq, qual, None))
    return out


def read_fastq(spark: SparkSession, *paths: str) -> dict[str, DataFrame]:
    """records (file, description, seq, qual) and problems (file, description, reason) of FASTQ files.

    What a line is depends on the lines before it, so a file is parsed by one task: give large
    read sets as many files, as sequencers do.
    """
    files = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = fastq_records(value.as_py() or "")
                for i in range(0, len(rows), 100_000):
                    cols = list(zip(*rows[i : i + 100_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(cols[0])), *(pa.array(c, pa.string()) for c in cols)], names=["file", "description", "seq", "qual", "reason"])

    rows = files.mapInArrow(run, "file string, description string, seq string, qual string, reason string")
    return {"records": rows.where("reason IS NULL").drop("reason"), "problems": rows.where("reason IS NOT NULL").select("file", "description", "reason")}


def read_fastq_splits(spark: SparkSession, *paths: str) -> dict[str, DataFrame]:
    """As `read_fastq`, for records of four lines in files of any size: each is read by as many tasks as its bytes make splits.

    Spark cuts the files where a line begins with @, wherever a split starts. A quality may begin so too: what follows is then a
    single line, which goes back to the piece before it, over the border of two splits by a join of the pieces at their ends.
    """
    at = F.col("_metadata")
    pieces = spark.read.option("lineSep", "\n@").text(list(paths)).select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None  # the split in work, and its piece that may lack a quality

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)], names=["file", "block", "head", "text"])

        for batch in batches:
            rows: list[tuple] = []
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != key:
                    if held is not None:
                        rows.append((*key, False, held))
                    key, held = (file, block), None
                    if block > 0 and "\n" not in value.rstrip("\n"):
                        rows.append((file, block, True, value))
                        continue
                    held = value.removeprefix("@") if block == 0 else value
                elif held is not None and "\n" not in value.rstrip("\n") and held.count("\n") == 2:
                    held += "\n@" + value
                else:
                    if held is not None:
                        rows.append((*key, None, held))
                    held = value
            yield out(rows)
        if held is not None:
            yield out([(*key, False, held)])

    cut = pieces.mapInArrow(run, "file string, block long, head boolean, text string")
    # Of each split only the last record, and a piece before its first, may belong together with a neighbour.
    ends = cut.where("head IS NOT NULL")
    w = Window.partitionBy("file").orderBy("block", F.desc("head"))
    after = ends.withColumn("next", F.when(F.lead("head").over(w), F.lead("text").over(w))).where("NOT head")
    whole = cut.where("head IS NULL").select("file", "text").unionByName(after.select("file", F.when(F.col("next").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n@"), "next")).alias("text")))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(file, *r) for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if text.strip() for r in fastq_records("@" + text)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["file", "description", "seq", "qual", "reason"])

    rows = whole.mapInArrow(parsed, "file string, description string, seq string, qual string, reason string")
    return {"records": rows.where("reason IS NULL").drop("reason"), "problems": rows.where("reason IS NOT NULL").select("file", "description", "reason")}


def read_plain(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, seq): the letters of each file as one sequence, without white space."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\s", "").alias("seq"))


def guess_format(spark: SparkSession, path: str) -> str:
    """fasta, fastq, genbank, embl or plain, by the first line of a file that is not blank."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    line = first[0].value if first else ""
    starts = {">": "fasta", "@": "fastq", "LOCUS": "genbank", "ID   ": "embl"}
    return next((kind for head, kind in starts.items() if line.startswith(head)), "plain")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(description, seq) of a file in any of these formats."""
    kind = guess_format(spark, path)
    if kind == "fasta":
        return read_fasta(spark, path).select("description", "seq")
    if kind == "fastq":
        return read_fastq_splits(spark, path)["records"].select("description", "seq")
    if kind == "plain":
        return read_plain(spark, path).select(F.col("file").alias("description"), "seq")
    return {"genbank": read_genbank, "embl": read_embl}[kind](spark, path)


def read_genbank(spark: SparkSession, *paths: str) -> DataFrame:
    t = spark.read.option("lineSep", "\n//").text(list(paths)).where(F.col("value").contains("ORIGIN"))
    return t.select(F.trim(F.regexp_replace(F.regexp_extract("value", r"(?s)DEFINITION\s+(.*?)\n\S", 1), r"\s+", " ")).alias("description"), F.regexp_replace(F.regexp_extract("value", r"(?s)ORIGIN[^\n]*\n(.*)$", 1), r"[\s0-9]", "").alias("seq"))


def read_embl(spark: SparkSession, *paths: str) -> DataFrame:
    t = spark.read.option("lineSep", "\n//").text(list(paths)).where(F.col("value").rlike(r"(?m)^SQ "))
    return t.select(F.array_join(F.regexp_extract_all("value", F.lit(r"(?m)^DE\s+(.*)$"), F.lit(1)), " ").alias("description"), F.regexp_replace(F.regexp_extract("value", r"(?s)\nSQ [^\n]*\n(.*)$", 1), r"[\s0-9]", "").alias("seq"))


def read_sam(spark: SparkSession, *paths: str) -> DataFrame:
    """Alignments of SAM files with their flags as columns."""
    f = F.split("value", "\t")
    t = spark.read.text(list(paths)).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(f.alias("f")).where(F.size("f") >= 11)
    c = F.col("f")
    rows = t.select(c[0].alias("qname"), c[1].cast("int").alias("flag"), c[2].alias("rname"), c[3].cast("long").alias("pos"), c[4].cast("int").alias("mapq"), c[5].alias("cigar"), c[9].alias("seq"), c[10].alias("qual"))
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    return rows.withColumn("is_paired", bit(1)).withColumn("is_unmapped", bit(4)).withColumn("is_reverse", bit(16)).withColumn("is_secondary", bit(256))


def read_matches(spark: SparkSession, *paths: str) -> DataFrame:
    """Tabular matches of twelve columns: query, subject, identity, length, mismatches, gaps, places, e-value, bit score."""
    schema = "q_id string, s_id string, identity double, length int, mismatches int, gaps int, q_start long, q_end long, s_start long, s_end long, evalue double, bitscore double"
    m = spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(list(paths))
    low, high = F.least("s_start", "s_end"), F.greatest("s_start", "s_end")
    return m.select("q_id", "s_id", "identity", "length", "mismatches", "gaps", "q_start", "q_end", low.alias("s_start"), high.alias("s_end"), "evalue", "bitscore", F.when(F.col("s_start") <= F.col("s_end"), "+").otherwise("-").alias("strand"))
