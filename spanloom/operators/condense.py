"""Sets of sequences without what repeats: unique parts, and links to like stretches of other sequences with edit scripts.

Links go to sequences that have none themselves, so any part is decompressed in one join. A search for words looks at unique parts, follows
links from hits into what is equal there, and looks at the stretches around edits and borders, which are kept for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import sequences as S
from spanloom.operators import extensions as X
from spanloom.operators import joins as J
from spanloom.operators import kmers as K
from spanloom.session import with_checkpoints


_TURNED = str.maketrans("ID", "DI")


@dataclass
class Condensed:
    """parts (seqnum, start, text), links (seqnum, start, end, ref, ref_start, ref_end, script), patches (seqnum, start, text) for words of `k`.

    Places are 0-based and half-open.
    """

    parts: DataFrame
    links: DataFrame
    patches: DataFrame
    k: int


def script_of(cigar: str, text: str) -> str:
    """The operations with the letters that the reference does not have: runs of =, X and I with their letters, D."""
    out, at = [], 0
    for n, op in re.findall(r"(\d+)([=XID])", cigar):
        size = int(n)
        out.append(f"{n}{op}{text[at : at + size] if op in 'XI' else ''}")
        at += size * (op != "D")
    return "".join(out)


def blocks_of(script: str) -> Iterator[tuple[str, int, int, int, str]]:
    """(operation, place in the linked stretch, place in the reference, length, letters) of each block of a script."""
    i = j = k = 0
    while k < len(script):
        m = re.compile(r"(\d+)([=XID])").match(script, k)
        n, op = int(m[1]), m[2]
        k = m.end() + (n if op in "XI" else 0)
        yield op, i, j, n, script[m.end() : k]
        i, j = i + n * (op != "D"), j + n * (op != "I")


def replay(reference: str, script: str) -> str:
    return "".join(reference[j : j + n] if op == "=" else letters for op, _, j, n, letters in blocks_of(script))


def compress(seqs: DataFrame, seed: int = 20, k: int = 12, max_frequency: int = 50, min_length: int = 60, min_identity: float = 90.0) -> Condensed:
    """Parts and links of `seqs` (seqnum, seq): of the extensions to sequences of smaller numbers the longest first, none overlapping.

    A sequence with no extension to a smaller one is a reference, and only references are linked to. Letters are taken in
    lower case; null sequences stay null. Seeds of more than max_frequency places start no extension: less is saved then, nothing lost.
    """
    with_checkpoints(seqs.sparkSession)
    low = seqs.select("seqnum", S.ascii_lower("seq").alias("seq"))
    kind = seqs.schema["seqnum"].dataType.simpleString()
    found = X.front_extensions(low, low, seed, max_frequency, min_length, min_identity, only=F.col("a") > F.col("b")).select("a", "a_start", "a_end", "b", "b_start", "b_end", "cigar").checkpoint()
    later = found.select(F.col("a").alias("b")).distinct()
    chosen = found.join(later, "b", "left_anti").groupBy("a").agg(F.sort_array(F.collect_list(F.struct((F.col("a_start") - F.col("a_end")).alias("size"), "a_start", F.col("b"), "b_start", "a_end", "b_end", "cigar"))).alias("x"))
    rows = low.join(chosen.withColumnRenamed("a", "seqnum"), "seqnum", "left").select("seqnum", "seq", "x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for name, text, x in b.itertuples(index=False):
                if text is None:
                    out.append((name, "part", 0, 0, None, None, None, None))
                    continue
                taken: list[tuple[int, int]] = []
                edges = {0, len(text)}
                rough: list[tuple[int, int]] = []
                for m in x if x is not None else ():
                    s, e = m["a_start"], m["a_end"] + 1
                    if any(p < e and s < q for p, q in taken):
                        continue
                    taken.append((s, e))
                    # Extensions tell how the reference comes from this sequence: letters added there are missing here.
                    script = script_of(m["cigar"].translate(_TURNED), text[s:e])
                    out.append((name, "link", s, e, m["b"], m["b_start"], m["b_end"] + 1, script))
                    edges |= {s, e}
                    for op, i, _, n, _ in blocks_of(script):
                        if op != "=":
                            rough.append((s + i, s + i + n * (op != "D")))
                ends = [0, *(p for s in sorted(taken) for p in s), len(text)]
                for s, e in zip(ends[::2], ends[1::2], strict=True):
                    if s < e or not text:
                        out.append((name, "part", s, e, None, None, None, text[s:e]))
                # What no part and no equal block holds whole, with what a word may reach into on both sides.
                around = sorted((max(s - k + 1, 0), min(e + k - 1, len(text))) for s, e in [*rough, *((p, p) for p in edges - {0, len(text)})])
                merged: list[list[int]] = []
                for s, e in around:
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                out += [(name, "patch", s, e, None, None, None, text[s:e]) for s, e in merged]
            yield pd.DataFrame(out, columns=["seqnum", "kind", "start", "end", "ref", "ref_start", "ref_end", "text"]).astype({"ref": "Int64", "ref_start": "Int64", "ref_end": "Int64"})

    every = rows.mapInPandas(run, f"seqnum {kind}, kind string, start long, end long, ref {kind}, ref_start long, ref_end long, text string").checkpoint()
    pick = lambda name: every.where(F.col("kind") == name)
    return Condensed(pick("part").select("seqnum", "start", "text"), pick("link").select("seqnum", "start", "end", "ref", "ref_start", "ref_end", F.col("text").alias("script")), pick("patch").select("seqnum", "start", "text"), k)


def decompress(c: Condensed, wanted: DataFrame | None = None) -> DataFrame:
    """(seqnum, seq) of all sequences, or of those in `wanted` (seqnum)."""
    parts, links = (t if wanted is None else t.join(wanted, "seqnum", "left_semi") for t in (c.parts, c.links))
    whole = c.parts.select(F.col("seqnum").alias("ref"), F.col("text").alias("seq"))
    kind = c.parts.schema["seqnum"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"seqnum": b["seqnum"], "start": b["start"], "text": [replay(t, s) for t, s in zip(b["piece"], b["script"], strict=True)]})

    # A reference has one part: all of it.
    piece = F.expr("substring(seq, int(ref_start) + 1, int(ref_end - ref_start))")
    linked = links.join(whole, "ref").select("seqnum", "start", "script", piece.alias("piece")).mapInPandas(run, f"seqnum {kind}, start long, text string")
    both = parts.unionByName(linked).groupBy("seqnum").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p"), F.max(F.col("text").isNull()).alias("none"))
    return both.select("seqnum", F.when(~F.col("none"), F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("seq"))


def search(c: Condensed, words: DataFrame) -> DataFrame:
    """(word, seqnum, pos): all places of words (word) of c.k letters, found without decompressing anything."""
    w = words.select(S.ascii_lower("word").alias("kmer")).where(F.length("kmer") == c.k).distinct()

    def direct(rows: DataFrame) -> DataFrame:
        named = rows.where("text IS NOT NULL").select(F.struct("seqnum", "start").alias("seqnum"), F.col("text").alias("seq"))
        return K.positions(named, c.k).join(w, "kmer").select("kmer", "seqnum.seqnum", (F.col("seqnum.start") + F.col("pos")).alias("pos"))

    kind = c.parts.schema["seqnum"].dataType.simpleString()
    size = c.k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(name, ref, s + i, r + j, r + j + n - size) for name, s, ref, r, script in b.itertuples(index=False) for op, i, j, n, _ in blocks_of(script) if op == "=" and n >= size]
            yield pd.DataFrame(out, columns=["seqnum", "ref", "at", "start", "end"])

    # Equal blocks of links, as the range of places where a word of the reference is one of the linked sequence as well.
    equal = c.links.select("seqnum", "start", "ref", "ref_start", "script").mapInPandas(run, f"seqnum {kind}, ref {kind}, at long, start long, end long")
    hits = direct(c.parts)
    followed = J.point_join(equal, hits.select("kmer", F.col("seqnum").alias("ref"), F.col("pos").alias("point")), ["ref"])
    followed = followed.select("kmer", "seqnum", (F.col("at") + F.col("point") - F.col("start")).alias("pos"))
    return hits.unionByName(followed).unionByName(direct(c.patches)).distinct().withColumnRenamed("kmer", "word")


def information(c: Condensed) -> DataFrame:
    """(sequences, parts, links, letters, unique_letters, linked_letters): what the set is made of."""
    p = c.parts.agg(F.count_distinct("seqnum").alias("s"), F.count("*").alias("parts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("unique_letters"))
    n = c.links.agg(F.count("*").alias("links"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("linked_letters"))
    every = c.parts.select("seqnum").unionByName(c.links.select("seqnum")).agg(F.count_distinct("seqnum").alias("sequences"))
    return p.crossJoin(n).crossJoin(every).select("sequences", "parts", "links", (F.col("unique_letters") + F.col("linked_letters")).alias("letters"), "unique_letters", "linked_letters")
