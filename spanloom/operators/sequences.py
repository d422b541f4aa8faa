"""Operators on tables of sequences (seqnum, seq, and description where named)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import bases
from spanloom.functions import sequences as S


def length_statistics(seqs: DataFrame) -> DataFrame:
    n = F.length("seq")
    return seqs.agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean"))


def length_histogram(seqs: DataFrame, width: int) -> DataFrame:
    return seqs.groupBy(F.floor(F.length("seq") / width).alias("bucket")).agg(F.count("*").alias("n"))


def run_lengths(seqs: DataFrame, symbol: str = "a") -> DataFrame:
    """Lengths of maximal runs of one symbol, any case, and how many there are of each."""
    runs = F.explode(F.regexp_extract_all("seq", F.lit(f"([{symbol.lower()}{symbol.upper()}]+)"), 1))
    return seqs.select(runs.alias("r")).groupBy(F.length("r").alias("length")).agg(F.count("*").alias("n"))


def assembly_statistics(seqs: DataFrame, percents: tuple[int, ...] = (50, 80), genome_length: int | None = None) -> DataFrame:
    """(statistic, value): N and L values, quartiles, and numbers of long sequences.

    Nx is the first length, longest first, at which the running total reaches x percent of the
    total (of genome_length for NGx), rounded down; Lx the running number there. Everything is
    computed on the histogram of lengths, so no window holds sequences.
    """
    hist = seqs.groupBy(F.length("seq").cast("long").alias("len")).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("len"))
    all_rows = Window.partitionBy()
    h = hist.select("len", "n", F.sum(F.col("len") * F.col("n")).over(w).alias("cum"), F.sum("n").over(w).alias("num"), F.sum(F.col("len") * F.col("n")).over(all_rows).alias("total"), F.sum("n").over(all_rows).alias("count"))
    half = F.floor(F.col("count") / 2)
    marks = [("median", half), ("q1", half + F.floor(half / 2)), ("q3", F.floor(half / 2))]
    aggs: list[Column] = [F.max("count").alias("count"), F.max("total").alias("total"), F.max("len").alias("longest"), F.min("len").alias("shortest")]
    for p in percents:
        reach = F.col("cum") >= F.floor(F.col("total") * p / 100)
        aggs += [F.max(F.when(reach, F.col("len"))).alias(f"n{p}"), F.min(F.when(reach, F.col("num"))).alias(f"l{p}")]
        if genome_length:
            far = F.col("cum") >= genome_length * p // 100
            aggs += [F.max(F.when(far, F.col("len"))).alias(f"ng{p}"), F.min(F.when(far, F.col("num"))).alias(f"lg{p}")]
    aggs += [F.max(F.when(F.col("num") >= m, F.col("len"))).alias(name) for name, m in marks]
    aggs += [F.coalesce(F.sum(F.when(F.col("len") > x, F.col("n"))), F.lit(0)).alias(f"over_{x}") for x in (500, 1000, 10000, 100000, 1000000)]
    row = h.agg(*aggs)
    return row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in row.columns]), F.array(*[F.col(c).cast("long") for c in row.columns]))).alias("statistic", "value"))


def base_shares(seqs: DataFrame) -> DataFrame:
    """Percent of G+C, A+T and N of each sequence."""
    n = F.length("seq")
    share = lambda s: F.when(n > 0, 100.0 * S.composition("seq", s) / n)
    return seqs.select("seqnum", share("GCgc").alias("gc"), share("ATat").alias("at"), share("Nn").alias("n"))


def repeated_fingerprints(seqs: DataFrame) -> DataFrame:
    """Fingerprints of more than one sequence, and how many have them."""
    return seqs.groupBy(S.fingerprint("seq").alias("md5")).agg(F.count("*").alias("n")).where("n > 1")


def fingerprint_collisions(seqs: DataFrame) -> DataFrame:
    """Fingerprints that different sequences share."""
    return seqs.groupBy(S.fingerprint("seq").alias("md5")).agg(F.count_distinct(S.ascii_upper("seq")).alias("kinds")).where("kinds > 1")


def checklist_difference(seqs: DataFrame, checklist: DataFrame) -> DataFrame:
    """(md5, side, n): fingerprints that one side has more often, by how much."""
    a = seqs.groupBy(S.fingerprint("seq").alias("md5")).agg(F.count("*").alias("a"))
    b = checklist.groupBy("md5").agg(F.count("*").alias("b"))
    d = a.join(b, "md5", "full").withColumn("d", F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).where("d <> 0")
    return d.select("md5", F.when(F.col("d") > 0, "sequences").otherwise("checklist").alias("side"), F.abs("d").alias("n"))


def unique_sequences(seqs: DataFrame, reverse_complement: bool = False) -> DataFrame:
    """First sequence of each fingerprint; with reverse_complement a sequence and its reverse complement are one.

    A min over a struct replaces a window, so a hot sequence meets in partial sums.
    """
    key = S.fingerprint("seq")
    if reverse_complement:
        key = F.least(key, S.fingerprint(S.reverse_complement("seq")))
    first = seqs.groupBy(key.alias("__k")).agg(F.min("seqnum").alias("seqnum")).select("seqnum")
    return seqs.join(first, "seqnum", "left_semi")


def draw(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only, however the rows are dealt out: MD5 of 'seed:key:...'."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def filter_sequences(seqs: DataFrame, step: int = 1, sample: float | None = None, seed: int = 0, min_length: int | None = None, max_length: int | None = None, no_wildcards: bool = False, max_count: int | None = None) -> DataFrame:
    """Every step-th record, sampled, of the given lengths, without wildcards, at most max_count of those that pass, in input order.

    seqnum is the record's number from 0, so the step needs no window.
    """
    out = seqs.where(F.col("seqnum") % step == 0) if step > 1 else seqs
    if sample is not None:
        out = out.where(draw(seed, "seqnum") < sample)
    if min_length is not None:
        out = out.where(F.length("seq") >= min_length)
    if max_length is not None:
        out = out.where(F.length("seq") <= max_length)
    if no_wildcards:
        out = out.where(~F.col("seq").rlike("[^ACGTUacgtu]"))
    return out if max_count is None else out.orderBy("seqnum").limit(max_count)


def order_sequences(seqs: DataFrame, by: str, seed: int = 0) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(description, '([0-9]+)', 1) AS bigint)")
    keys = {
        "invert": [F.desc("seqnum")], "lexicographic": [F.asc("seq"), F.asc("seqnum")], "reverse": [F.desc("seq"), F.asc("seqnum")],
        "header": [F.asc("description"), F.asc("seqnum")], "numeric_header": [number.asc_nulls_first(), F.asc("seqnum")],
        "length": [F.desc(F.length("seq")), F.asc("seqnum")], "shuffle": [draw(seed, "seqnum"), F.asc("seqnum")],
    }
    return seqs.orderBy(*keys[by])


def extract_by_pattern(seqs: DataFrame, pattern: str) -> DataFrame:
    return seqs.where(F.col("description").rlike(pattern))


def extract_by_keys(seqs: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key, and from_pos, to_pos where a part is wanted): sequences, or their 1-based closed parts, by the first word of the description."""
    s = seqs.withColumn("key", F.substring_index("description", " ", 1)).join(keys, "key")
    return s.withColumn("seq", F.substring("seq", F.col("from_pos"), F.col("to_pos") - F.col("from_pos") + 1)) if "from_pos" in keys.columns else s


def six_frames(seqs: DataFrame, code: int = 1) -> DataFrame:
    """(seqnum, frame, protein): frames 1 to 3 forward, -1 to -3 on the reverse complement.

    Codons of a whole batch are numbered at every place in one pass over its flat bases; a frame is
    every third of them, forward from its start or backward from its end.
    """
    kind = seqs.schema["seqnum"].dataType.simpleString()
    amino = np.frombuffer(("".join(S.codon_map(code)[a + b + c] for a in "TCAG" for b in "TCAG" for c in "TCAG") + "X").encode(), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bases.few_letters(batches, 1):
            flat, off = bases.letters(batch.column(1))
            ahead, back = (amino[x] for x in bases.codon_numbers(flat)) if len(flat) > 2 else (flat[:0], flat[:0])
            out = []
            for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                for f in range(3):
                    out.append(ahead[s + f : max(e - 2, s + f) : 3].tobytes())
                for f in range(3):
                    out.append(back[s : max(e - 2 - f, s)][::-1][::3].tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(n), 6))), pa.array(np.tile(np.array([1, 2, 3, -1, -2, -3], np.int32), n)), pa.array(out, pa.binary()).cast(pa.string()),
            ], names=["seqnum", "frame", "protein"])

    return seqs.select("seqnum", "seq").mapInArrow(run, f"seqnum {kind}, frame int, protein string")


def open_frames(seqs: DataFrame, min_codons: int = 30, longest: bool = False, code: int = 1, both: bool = True) -> DataFrame:
    """(seqnum, frame, aa_start, n_codons): stretches from M to a stop, the stop included, of min_codons codons at least."""
    p = six_frames(seqs, code)
    if not both:
        p = p.where("frame > 0")
    orfs = F.regexp_extract_all("protein", F.lit(r"(M[^*]*\*)"), 1)
    # Places of the stretches from the text around them: an expression, no loop over sequences.
    gaps = F.split("protein", r"M[^*]*\*")
    rows = p.select("seqnum", "frame", F.posexplode(orfs).alias("k", "orf"), gaps.alias("gaps"), orfs.alias("orfs"))
    before = F.aggregate(F.slice("gaps", 1, F.col("k") + 1), F.lit(0), lambda s, g: s + F.length(g)) + F.aggregate(F.slice("orfs", 1, F.col("k")), F.lit(0), lambda s, g: s + F.length(g))
    out = rows.select("seqnum", "frame", (before + 1).alias("aa_start"), F.length("orf").alias("n_codons")).where(F.col("n_codons") >= min_codons)
    if longest:
        out = out.groupBy("seqnum", "frame").agg(F.min(F.struct((-F.col("n_codons")).alias("m"), "aa_start")).alias("x")).select("seqnum", "frame", F.col("x.aa_start").alias("aa_start"), (-F.col("x.m")).alias("n_codons"))
    return out


def spliced(features: DataFrame, seqs: DataFrame) -> DataFrame:
    """(parent, strand, seq): the parts of each parent (parent, seqnum, start, end, strand) joined in reading direction.

    The parts are gathered first, so that a sequence meets each parent once and is cut in one pass.
    """
    parts = features.groupBy("parent", "seqnum", "strand").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("parts"))
    rows = parts.join(seqs.select("seqnum", "seq"), "seqnum").select("parent", "seqnum", "strand", "seq", "parts")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bases.few_letters(batches, 3):
            flat, off = bases.points(batch.column(3))
            lists = batch.column(4)
            row, each = pc.list_parent_indices(lists).to_numpy().astype(np.int64), lists.flatten()
            start, end = (pc.fill_null(each.field(c), v).to_numpy() for c, v in (("start", 1), ("end", 0)))
            start, end = (off[row] + np.clip(x, 0, np.diff(off)[row]) for x in (start - 1, end))
            size = np.maximum(end - start, 0)
            whole = flat[bases.spans(start, size)]
            ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(row, np.arange(batch.num_rows + 1))].tolist()
            told = whole.tobytes().decode("ascii") if whole.dtype == np.uint8 else whole.astype("<u4").tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([told[x:y] for x, y in pairwise(ends)], pa.string())], names=["parent", "seqnum", "strand", "s"])

    joined = rows.mapInArrow(run, f"{kinds}, s string")
    return joined.select("parent", "seqnum", "strand", F.when(F.col("strand") == "-", S.reverse_complement("s")).otherwise(F.col("s")).alias("seq"))


def longest_orf_cds(transcripts: DataFrame, min_codons: int = 64, code: int = 1) -> DataFrame:
    """The longest open frame (first of several) of spliced transcripts (parent, seq): offset in bases and length with its stop."""
    s = transcripts.withColumn("seqnum", F.col("parent"))
    orfs = open_frames(s.select("seqnum", "seq"), min_codons, code=code, both=False)
    best = orfs.groupBy("seqnum").agg(F.min(F.struct((-F.col("n_codons")).alias("m"), "frame", "aa_start")).alias("x"))
    return best.select(F.col("seqnum").alias("parent"), (F.col("x.frame") - 1 + 3 * (F.col("x.aa_start") - 1)).alias("offset"), (-3 * F.col("x.m")).alias("length"))


def variant_effects(snps: DataFrame, cds: DataFrame, code: int = 1) -> DataFrame:
    """Effect of single-base changes on codons: snps (cds_id, pos 0-based in the coding sequence, alt), cds (cds_id, seq)."""
    changes = snps.groupBy("cds_id").agg(F.collect_list(F.struct("pos", "alt")).alias("changes"))
    return effects_of_changes(cds.join(changes, "cds_id"), code)


def effects_of_changes(cds: DataFrame, code: int = 1) -> DataFrame:
    """As `variant_effects`, from cds (cds_id, seq, changes): the changes, an array of (pos, alt), lie beside the sequence that they change.

    A sequence is taken apart once, however many changes it has. Further fields of `changes` come behind the columns of `variant_effects`.
    """
    fields = cds.schema["changes"].dataType.elementType.fields
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    more = [f.name for f in fields if f.name not in ("pos", "alt")]
    kind = cds.schema["cds_id"].dataType.simpleString()
    names = ["cds_id", "pos", "alt", "codon", "new_codon", "aa", "new_aa", "effect", *more]
    amino = S.codon_map(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bases.few_letters(batches, 1):
            flat, off = bases.points(batch.column(1))
            lists = batch.column(2)
            row, each = pc.list_parent_indices(lists).to_numpy().astype(np.int64), lists.flatten()
            pos = pc.fill_null(each.field("pos").cast(pa.int64()), -1).to_numpy()
            inside = np.flatnonzero((pos >= 0) & (pos < np.diff(off)[row] // 3 * 3))
            row, pos, each = row[inside], pos[inside], each.take(pa.array(inside))
            at = off[row] + pos // 3 * 3
            # Three code points of 21 bits are one number; few numbers, places and bases go together, and each such case is worked out once.
            codon = sum(flat[at + k].astype(np.int64) << 21 * (2 - k) for k in range(3)) if len(at) else at
            codon, alt = pa.array(codon).dictionary_encode(), each.field("alt").dictionary_encode(null_encoding="encode")
            case = (codon.indices.to_numpy().astype(np.int64) * 3 + pos % 3) * max(len(alt.dictionary), 1) + alt.indices.to_numpy()
            case = pa.array(case).dictionary_encode()
            known = codon.dictionary.to_pylist(), alt.dictionary.to_pylist()
            rows = [_effect(known[0][x // len(known[1]) // 3], x // len(known[1]) % 3, known[1][x % len(known[1])], amino) for x in case.dictionary.to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.string()).take(case.indices) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), each.field("pos"), each.field("alt"), *columns, *(each.field(c) for c in more)], names=names)

    types = [kind, kinds["pos"], kinds["alt"], *["string"] * 5, *(kinds[c] for c in more)]
    return cds.select("cds_id", "seq", "changes").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


_ASCII_UPPER = {x: x - 32 for x in range(97, 123)}


def _effect(codon: int, k: int, alt: str | None, amino: dict[str, str]) -> tuple[str, str | None, str, str | None, str]:
    """(codon, new codon, amino acids of both, effect) of base k of a codon, three code points in one number, replaced by `alt`."""
    old = "".join(chr(codon >> x & 0x1FFFFF) for x in (42, 21, 0)).translate(_ASCII_UPPER)
    new = None if alt is None else old[:k] + alt.translate(_ASCII_UPPER) + old[k + 1 :]
    aa, new_aa = (None if s is None else "".join(amino.get(s[i : i + 3].replace("U", "T"), "X") for i in range(0, len(s) - 2, 3)) for s in (old, new))
    if aa == "*":
        return old, new, aa, new_aa, "stop_retained_variant" if new_aa == "*" else "stop_lost"
    return old, new, aa, new_aa, "stop_gained" if new_aa == "*" else "synonymous_variant" if aa == new_aa else "missense_variant"


def splice_sites(introns: DataFrame, seqs: DataFrame) -> DataFrame:
    """(kind, site, n): first and last two bases of introns of 4 bases or more, on the strand they are read."""
    i = introns.join(seqs, "seqnum").where((F.col("end") - F.col("start") + 1 >= 4) & F.col("strand").isin("+", "-"))
    ends = F.concat(F.substring("seq", F.col("start").cast("int"), F.lit(2)), F.substring("seq", (F.col("end") - 1).cast("int"), F.lit(2)))
    four = F.when(F.col("strand") == "-", S.reverse_complement(ends)).otherwise(ends)
    kinds = F.array(F.struct(F.lit("splicesite").alias("kind"), F.col("s").alias("site")), F.struct(F.lit("donor").alias("kind"), F.substring("s", 1, 2).alias("site")), F.struct(F.lit("acceptor").alias("kind"), F.substring("s", 3, 2).alias("site")))
    return i.select(four.alias("s")).where(F.length("s") == 4).select(F.explode(kinds).alias("x")).groupBy("x.kind", "x.site").agg(F.count("*").alias("n"))


def shred(seqs: DataFrame, length: int, step: int) -> DataFrame:
    """Pieces of fixed length at fixed steps, the last one shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1)), F.lit(step))
    return seqs.select("seqnum", "seq", F.explode(starts).alias("start")).select("seqnum", "start", F.substring("seq", F.col("start"), F.lit(length)).alias("piece"))


def simulate_reads(seqs: DataFrame, length: int, per_sequence: int, seed: int) -> DataFrame:
    """Reads at random places of random strands, the same for the same seed."""
    s = seqs.where(F.length("seq") >= length).select("seqnum", "seq", F.explode(F.sequence(F.lit(1), F.lit(per_sequence))).alias("read"))
    s = s.withColumn("start", (F.floor(draw(seed, "seqnum", "read") * (F.length("seq") - length + 1)) + 1).cast("int")).withColumn("strand", F.when(draw(seed + 1, "seqnum", "read") < 0.5, "+").otherwise("-"))
    piece = F.substring("seq", F.col("start"), F.lit(length))
    return s.select("seqnum", "read", "start", "strand", F.when(F.col("strand") == "-", S.reverse_complement(piece)).otherwise(piece).alias("seq"))


def mutate(seqs: DataFrame, percent: float, seed: int) -> DataFrame:
    """Each base is substituted, deleted or followed by an insertion with the given probability, a third each; the same for the same seed."""
    roll = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("seqnum"), i), F.lit(1_000_000))
    base = lambda i: F.substring(F.lit("acgt"), (F.pmod(F.xxhash64(F.lit(seed + 1), F.col("seqnum"), i), F.lit(4)) + 1).cast("int"), F.lit(1))
    third = percent / 100 * 1_000_000 / 3
    # Few bases change: they are found first, by one draw a base, and put in from the last to the first.
    put = lambda c, i: F.when(roll(i) < third, base(i)).when(roll(i) < 2 * third, F.lit("")).otherwise(F.concat(c, base(i)))
    places = F.when(F.length("seq") > 0, F.filter(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: roll(i) < 3 * third)).otherwise(F.array().cast("array<int>"))
    return seqs.withColumn("seq", F.aggregate(F.reverse(places), F.col("seq"), lambda s, i: F.overlay(s, put(F.substring(s, i + 1, F.lit(1)), i), i + 1, F.lit(1))))


def sample_total_length(seqs: DataFrame, total: int, seed: int, bins: int = 4096) -> DataFrame:
    """Random sequences until their lengths add up to `total`; the first that reaches it is the last.

    Sequences are ordered by `draw`. The lengths of each of `bins` ranges of it are summed first,
    so running totals need a window over the bins, and one over the sequences of each bin.
    """
    keyed = seqs.withColumn("__key", draw(seed, "seqnum")).withColumn("__bin", F.floor(F.col("__key") * bins))
    sums = keyed.groupBy("__bin").agg(F.sum(F.length("seq")).alias("__n"))
    begin = sums.select("__bin", F.coalesce(F.sum("__n").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__begin")).where(F.col("__begin") < total)
    inside = Window.partitionBy("__bin").orderBy("__key", "seqnum").rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.join(begin, "__bin").withColumn("__before", F.col("__begin") + F.coalesce(F.sum(F.length("seq")).over(inside), F.lit(0)))
    return near.where(F.col("__before") < total).drop("__key", "__bin", "__begin", "__before")


def find_pattern(seqs: DataFrame, pattern: str) -> DataFrame:
    """(seqnum, places): all 1-based places of a fixed pattern in each sequence, overlapping ones too.

    Each byte of the pattern is compared over the flat bytes of a whole batch at once. Empty
    patterns and null sequences have no places; places count characters.
    """
    kind = seqs.schema["seqnum"].dataType.simpleString()
    wanted = np.frombuffer(pattern.encode(), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bases.few_letters(batches, 1):
            column = batch.column(1).cast(pa.large_string()).fill_null("")
            _, off, data = column.buffers()
            off = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
            flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
            off = off - off[0]
            at = bases.inside(off, len(wanted)) if len(wanted) else np.zeros(0, np.int64)
            for k, byte in enumerate(wanted):
                at = at[flat[at + k] == byte]
            letter = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
            row = np.searchsorted(off, at, "right") - 1
            ends = np.searchsorted(at, off)
            places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((letter[at] - letter[off[row]] + 1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), places], names=["seqnum", "places"])

    return seqs.select("seqnum", "seq").mapInArrow(run, f"seqnum {kind}, places array<int>")


def guess_alphabet(seqs: DataFrame, letters: int = 5000) -> DataFrame:
    """protein if the first letters hold one that no nucleotide code has, else dna."""
    return seqs.select("seqnum", F.when(F.substring("seq", 1, letters).rlike("[LIFEQPXZlifeqpxz]"), "protein").otherwise("dna").alias("alphabet"))


def split_parts(seqs: DataFrame, parts: int) -> DataFrame:
    """A part number for each sequence, of near equal total length, from the running length in input order by blocks."""
    n = F.length("seq")
    sums = seqs.groupBy(F.floor(F.col("seqnum") / 1000).alias("__b")).agg(F.sum(n).alias("n"))
    starts = sums.select("__b", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"), F.sum("n").over(Window.partitionBy()).alias("all"))
    inside = Window.partitionBy("__b").orderBy("seqnum").rowsBetween(Window.unboundedPreceding, -1)
    s = seqs.withColumn("__b", F.floor(F.col("seqnum") / 1000)).withColumn("__in", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(starts, "__b")
    return s.select("seqnum", F.floor((F.col("at") + F.col("__in")) * parts / F.greatest("all", F.lit(1))).cast("int").alias("part"))


def contract_wildcards(seqs: DataFrame) -> DataFrame:
    """Runs of wildcards as one n."""
    return seqs.withColumn("seq", F.regexp_replace("seq", "[^ACGTUacgtu]+", "n"))


def homopolymers(seqs: DataFrame, min_length: int = 3) -> DataFrame:
    """(base, length, n): maximal runs of one base, any case, of min_length or more."""
    runs = "|".join(f"{b}{{{min_length},}}" for b in "acgt")
    r = seqs.select(F.explode(F.regexp_extract_all(S.ascii_lower("seq"), F.lit(f"({runs})"), F.lit(1))).alias("r"))
    return r.groupBy(F.substring("r", 1, 1).alias("base"), F.length("r").alias("length")).agg(F.count("*").alias("n"))


def dust_mask(seqs: DataFrame, window: int = 64, threshold: float = 2.0, linker: int = 1) -> DataFrame:
    """(seqnum, seq): stretches of low complexity in lower case, all else in upper case.

    The score of a stretch of n triplets is the number of pairs of equal triplets in it over n - 1. Masked are all stretches of at most
    `window` letters that score more than `threshold` and of which no part scores more than the whole; masked stretches at
    most `linker` letters apart become one. Triplets with a wildcard equal nothing. Null sequences stay null.
    """
    kind = seqs.schema["seqnum"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            flat, off = bases.letters(texts)
            # Letters of other scripts are one byte here, and no letters to turn: such texts are spelled out by themselves.
            low = low_complexity(flat, off, window, threshold, linker)
            upper = np.where((flat >= 97) & (flat <= 122), flat - 32, flat)
            upper = np.where(low & (upper >= 65) & (upper <= 90), upper + 32, upper).astype(np.uint8)
            whole = upper.tobytes().decode("ascii")
            out = [None if s is None else whole[x:y] if s.isascii() else "".join(c if ord(c) > 127 else z for c, z in zip(s, whole[x:y], strict=True)) for s, x, y in zip(texts.to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["seqnum", "seq"])

    return seqs.select("seqnum", "seq").mapInArrow(run, f"seqnum {kind}, seq string")


def low_complexity(flat: np.ndarray, off: np.ndarray, window: int, threshold: float, linker: int) -> np.ndarray:
    """Which letters of a block of texts lie in stretches of low complexity: one pass over the block for each length of a stretch."""
    n = len(flat)
    marks = np.zeros(n + 1, np.int64)
    if n >= 3:
        forward, _ = bases.codon_numbers(flat)
        row_end = off[np.searchsorted(off, np.arange(n - 2), "right")]
        triplet = np.where((forward < 64) & (np.arange(n - 2) + 3 <= row_end), forward, -1 - np.arange(n - 2))
        m = len(triplet)
        before, pairs, best = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m)
        for size in range(2, min(window - 2, m) + 1):
            # `before` counts equal triplets among the size - 1 that stand before each one.
            before[size - 1 :] += triplet[size - 1 :] == triplet[: m - size + 1]
            k = m - size + 1
            pairs = pairs[:k] + before[size - 1 :]
            inside = np.arange(k) + size + 2 <= row_end[:k]
            score = np.where(inside, pairs / (size - 1), 0)
            parts = np.maximum(best[:k], best[1 : k + 1] if len(best) > k else 0)
            at = np.flatnonzero((score > threshold) & (score >= parts))
            marks[at] += 1
            marks[at + size + 2] -= 1
            best = np.maximum(score, parts)
    low = np.cumsum(marks)[:n] > 0
    # Close gaps between stretches of one text that are short enough.
    edge = np.flatnonzero(np.diff(np.concatenate([[0], low.astype(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    for x, y in zip(end[:-1].tolist(), start[1:].tolist(), strict=True):
        if y - x <= linker and np.searchsorted(off, x - 1, "right") == np.searchsorted(off, y, "right"):
            low[x:y] = True
    return low


def correct_homopolymers(reads: DataFrame, reference: DataFrame, max_change: int = 2, max_quality: float = 30.0, min_length: int = 3) -> DataFrame:
    """(seqnum, seq, qual, edits): homopolymer runs of aligned reads set to the length that the reference has.

    reads (seqnum, ref, ref_start 0-based, seq, qual) are aligned run by run, replaced, missing and added runs included. A run of min_length or more in the reference changes a read's run of the same base
    if the lengths differ by at most max_change and the mean quality of the read's run is max_quality or less;
    added bases take the mean quality of the run.
    """
    kind = reads.schema["seqnum"].dataType.simpleString()
    rows = reads.join(reference.select(F.col("seqnum").alias("ref"), F.col("seq").alias("ref_seq")), "ref")
    piece = F.expr("substring(ref_seq, int(ref_start) + 1, 2 * length(seq))")
    rows = rows.select("seqnum", "seq", "qual", piece.alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in bases.few_letters([large], 1):
                out, plain = _corrected_runs(batch, max_change, max_quality, min_length)
                # Reads whose runs and those of the reference differ in their bases are aligned one by one.
                other = np.flatnonzero(~plain)
                if len(other):
                    done = [_corrected(*x, max_change, max_quality, min_length) for x in zip(*(batch.column(k).take(pa.array(other)).to_pylist() for k in (1, 2, 3)), strict=True)]
                    mask = pa.array(~plain)
                    out = [pc.replace_with_mask(c, mask, pa.array(v, c.type)) for c, v in zip(out, zip(*done, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["seqnum", "seq", "qual", "edits"])

    return rows.mapInArrow(run, f"seqnum {kind}, seq string, qual string, edits int")


def _flat_runs(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, first) of the runs of equal letters of a block of texts, none over two texts; `first` is the number of each text's first run."""
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[off[:-1][off[:-1] < len(flat)]] = True
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(flat))), np.searchsorted(start, off)


def _corrected_runs(batch: pa.RecordBatch, max_change: int, max_quality: float, min_length: int) -> tuple[list[pa.Array], np.ndarray]:
    """(seq, qual, edits) as `_corrected` gives them, and for which rows they hold: those whose runs agree in their bases as far as both go."""
    (flat, off), (marks, marks_off), (near, near_off) = (bases.letters(batch.column(k)) for k in (1, 2, 3))
    lower = np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)
    low_near = np.where((near >= 65) & (near <= 90), near + np.uint8(32), near)
    plain = np.diff(off) == np.diff(marks_off)
    for k, x in ((1, flat), (2, marks), (3, near)):
        plain &= ~pc.is_null(batch.column(k)).to_numpy(zero_copy_only=False)
        if (x == 63).any():  # perhaps a letter beyond ASCII
            plain &= pc.string_is_ascii(batch.column(k)).fill_null(False).to_numpy(zero_copy_only=False)
    start, size, first = _flat_runs(lower, off)
    start2, size2, first2 = _flat_runs(low_near, near_off)
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    k = np.arange(len(start)) - first[row]
    partner = first2[row] + k
    both = partner < first2[row + 1]
    at = np.flatnonzero(both)
    plain[row[at[lower[start[at]] != low_near[start2[partner[at]]]]]] = False
    wanted = size.copy()
    wanted[at] = size2[partner[at]]
    last = np.arange(len(start)) + 1 == first[row + 1]
    change = ~last & (wanted != size) & (wanted >= min_length) & (np.abs(wanted - size) <= max_change) & plain[row]
    if change.any():  # qualities lie beside their bases from here on, as both texts are of one length
        at = np.flatnonzero(change)
        total = np.concatenate([[0], np.cumsum(marks.astype(np.int64) - 33)])
        begin = marks_off[row[at]] + start[at] - off[row[at]]
        mean = (total[begin + size[at]] - total[begin]) / size[at]
        change[at[mean > max_quality]] = False
        mean = mean[mean <= max_quality]
    else:
        mean = np.zeros(0)
    # Every letter of the result comes from a place of the read: the run's own, and its last one again where bases are added.
    new = np.where(change, wanted, size)
    run = np.repeat(np.arange(len(start)), new)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(new) - new, new)
    source = start[run] + np.minimum(inner, size[run] - 1)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, new, batch.num_rows).astype(np.int64))])
    scores = marks[np.minimum(source - off[row[run]] + marks_off[row[run]], max(len(marks) - 1, 0))] if len(marks) else np.zeros(len(run), np.uint8)
    added = np.flatnonzero(inner >= size[run])
    of = np.zeros(len(start), np.uint8)
    of[np.flatnonzero(change)] = 33 + np.rint(mean).astype(np.int64)
    scores[added] = of[run[added]]
    text = lambda x: pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.string())
    edits = np.bincount(row[change], minlength=batch.num_rows).astype(np.int32)
    return [text(flat[source]), text(scores), pa.array(edits)], plain


def _base_runs(s: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for c in s.lower():
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def _corrected(seq: str, qual: str, near: str, max_change: int, max_quality: float, min_length: int) -> tuple[str, str, int]:
    """Read and reference are aligned with each run as one letter, so a run has its partner however long either is.

    Runs pair off one by one as long as their bases agree; what follows is aligned.
    """
    from spanloom.operators.alignments import align_places

    runs, wanted = _base_runs(seq), _base_runs(near)
    same = next((k for k, (x, y) in enumerate(zip(runs, wanted, strict=False)) if x[0] != y[0]), min(len(runs), len(wanted)))
    partner, i, j, cigar = {k: k for k in range(same)}, same, same, ""
    if same < min(len(runs), len(wanted)):
        _, x, _, y, _, cigar = align_places("".join(b for b, _ in runs[same:]), "".join(b for b, _ in wanted[same:]), local=True)
        i, j = i + x, j + y
    for n, op in re.findall(r"(\d+)([=XID])", cigar):
        if op == "=":
            partner |= {i + k: j + k for k in range(int(n))}
        i, j = i + int(n) * (op != "I"), j + int(n) * (op != "D")
    at, out, marks, edits = 0, [], [], 0
    for k, (_, n) in enumerate(runs):
        letters, scores = seq[at : at + n], qual[at : at + n]
        at += n
        size = wanted[partner[k]][1] if k in partner else n
        mean = sum(ord(c) - 33 for c in scores) / n
        # The last run of a read may go on in the reference: its length says nothing.
        if k + 1 < len(runs) and size != n and size >= min_length and abs(size - n) <= max_change and mean <= max_quality:
            edits += 1
            letters = letters[:size] + letters[-1] * max(0, size - n)
            scores = scores[:size] + chr(33 + round(mean)) * max(0, size - n)
        out.append(letters)
        marks.append(scores)
    return "".join(out), "".join(marks), edits
