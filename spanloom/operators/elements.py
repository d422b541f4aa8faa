"""What lies at the ends and inside of elements with repeated ends: target site duplications and motifs, tracts, primer binding sites, strand.

Candidates are rows (seqnum, start, end, left_end, right_start), 1-based and closed, as `predictions.repeated_ends` gives them. Each
is judged by the few hundred letters around its borders, which travel with it instead of its sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import lockstep
from spanloom.functions import sequences as S
from spanloom.operators import kmers as K

#: States of a tract decoder, and the chance of leaving one for another at each letter.
OUTSIDE, TRACT, BOX = range(3)
LEAVE = 0.05
#: Shares of a, c, g and t outside, in a polypurine tract, and in the T-rich box before it.
EMITS = np.array([[0.25, 0.25, 0.25, 0.25], [0.485, 0.015, 0.485, 0.015], [0.03, 0.03, 0.03, 0.91]])


def target_sites(before: str, inside_left: str, inside_right: str, after: str, min_tsd: int, max_tsd: int, motif: str | None, mismatches: int) -> tuple[int, int, int] | None:
    """(shift of the start, shift of the end, length) of the best target site duplication around an element, or None.

    The letters before and in the beginning of the element are `before + inside_left`, those at its end and after it `inside_right +
    after`. A duplication of min_tsd to max_tsd letters ends right before the moved start and begins right behind the moved end; with
    `motif` the element's first and last letters are its two halves with so many mismatches at most. Of all the one
    that moves the borders least is taken, then the longest, then that which starts first.
    """
    left, right = before + inside_left, inside_right + after
    x, y = (np.frombuffer(s.encode("ascii", "replace"), np.uint8) for s in (left, right))
    same = (x[:, None] == y[None, :]) & np.isin(x, list(b"acgt"))[:, None]
    half = len(motif) // 2 if motif else 0
    best = None
    run = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for size in range(1, max_tsd + 1):
        # run[i, j]: do the `size` letters that end before i in x equal those that begin at j in y?
        run = same if size == 1 else run[:-1, :-1] & same[size - 1 :, size - 1 :]
        if size < min_tsd:
            continue
        for i, j in zip(*np.nonzero(run), strict=True):
            start, end = int(i) + size, int(j)  # the element begins at left[start] and ends before right[end]
            s, e = start - len(before), end - len(inside_right)
            if motif:
                head, tail = left[start : start + half], right[max(end - half, 0) : end]
                wrong = sum(a != b for a, b in zip(head + tail, motif, strict=False)) + 2 * half - len(head + tail)
                if wrong > mismatches:
                    continue
            rank = (abs(s) + abs(e), -size, s)
            if best is None or rank < best[0]:
                best = rank, (s, e, size)
    return best and best[1]


def with_target_sites(candidates: DataFrame, seqs: DataFrame, min_tsd: int = 4, max_tsd: int = 20, vicinity: int = 20, motif: str | None = None, mismatches: int = 0, required: bool = True) -> DataFrame:
    """Candidates with borders moved to target site duplications (`tsd_length`, null without one), at most `vicinity` letters either way.

    With `required` those without one go.
    """
    text = S.ascii_lower("seq")
    piece = lambda first, end: F.substring("t", F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.least(end, F.length("t")) - F.greatest(first, F.lit(1)) + 1, F.lit(0)).cast("int"))
    reach, columns = max_tsd + vicinity, candidates.columns
    c = candidates.join(seqs.select("seqnum", text.alias("t")), "seqnum")
    arm = F.least(F.lit(vicinity + max_tsd), F.col("left_end") - F.col("start"))
    other = F.least(F.lit(vicinity + max_tsd), F.col("end") - F.col("right_start"))
    c = c.select(*candidates.columns, piece(F.col("start") - reach, F.col("start") - 1).alias("w"), piece(F.col("start"), F.col("start") + arm).alias("x"), piece(F.col("end") - other, F.col("end")).alias("y"), piece(F.col("end") + 1, F.col("end") + reach).alias("z"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for w, x, y, z in zip(b["w"], b["x"], b["y"], b["z"], strict=True):
                r = target_sites(w, x, y, z, min_tsd, max_tsd, motif, mismatches)
                found.append(r if r and max(abs(r[0]), abs(r[1])) <= vicinity else None)
            out = b[columns].copy()
            out["start"] += [r[0] if r else 0 for r in found]
            out["end"] += [r[1] if r else 0 for r in found]
            out["tsd_length"] = pd.array([r[2] if r else None for r in found], "Int32")
            yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    out = c.mapInPandas(run, f"{kinds}, tsd_length int")
    return out.where("tsd_length IS NOT NULL") if required else out


def decode(texts: list[str]) -> list[np.ndarray]:
    """States of each text on the likeliest path through outside, tract and box (Viterbi), all texts step by step together.

    A path may begin and end anywhere; ties go to the state named first. Other letters count as likely everywhere.
    """
    n = max(map(len, texts), default=0)
    digit = np.full((len(texts), n), 4)
    for i, t in enumerate(texts):
        digit[i, : len(t)] = [("acgt".find(c) + 5) % 5 for c in t]
    emit = np.append(np.log(EMITS), np.full((3, 1), np.log(0.25)), axis=1)
    move = np.log(np.where(np.eye(3) > 0, 1 - LEAVE, LEAVE / 2))
    score, back = np.full((len(texts), 3), np.log(1 / 3)), np.zeros((n, len(texts), 3), np.int8)
    at = np.zeros((n, len(texts), 3))
    for k in range(n):
        if k:
            ways = score[:, :, None] + move
            back[k] = ways.argmax(1)
            score = ways.max(1)
        score = score + emit[:, digit[:, k]].T
        at[k] = score
    out = []
    for i, t in enumerate(texts):
        path = np.zeros(len(t), np.int64)
        for k in range(len(t) - 1, -1, -1):
            path[k] = at[k, i].argmax() if k == len(t) - 1 else back[k + 1, i, path[k + 1]]
        out.append(path)
    return out


def tract(path: np.ndarray, min_length: int = 8, max_length: int = 30, box_distance: int = 10) -> tuple[int, int, int] | None:
    """(start, end, length of the box before it) of the tract nearest to the end of a decoded text, 0-based and half-open."""
    cut = np.flatnonzero(np.diff(path)) + 1
    runs = list(zip(np.append(0, cut).tolist(), np.append(cut, len(path)).tolist(), strict=True))
    for k in range(len(runs) - 1, -1, -1):
        s, e = runs[k]
        if s < e and path[s] == TRACT and min_length <= e - s <= max_length:
            box = next((y - x for x, y in reversed(runs[:k]) if path[x] == BOX and s - y <= box_distance), 0)
            return s, e, box
    return None


def polypurine_tracts(candidates: DataFrame, seqs: DataFrame, radius: int = 30, **limits) -> DataFrame:
    """(seqnum, start, end, strand, ppt_start, ppt_end, box): tracts next to the inner border of the repeat that the strand reads last.

    Forward it lies before the right repeat, backward, read on the other strand, behind the left one; the window of `radius`
    letters inside that border is decoded. Places are 1-based and closed.
    """
    t = S.ascii_lower("seq")
    c = candidates.select("seqnum", "start", "end", "left_end", "right_start").join(seqs.select("seqnum", t.alias("t")), "seqnum")
    low = F.greatest(F.col("right_start") - radius, F.col("left_end") + 1)
    high = F.least(F.col("left_end") + radius, F.col("right_start") - 1)
    piece = lambda x, y: F.substring("t", x.cast("int"), F.greatest(y - x + 1, F.lit(0)).cast("int"))
    sides = F.array(
        F.struct(F.lit("+").alias("strand"), low.alias("at"), piece(low, F.col("right_start") - 1).alias("w")),
        F.struct(F.lit("-").alias("strand"), high.alias("at"), S.reverse_complement(piece(F.col("left_end") + 1, high)).alias("w")),
    )
    rows = c.select("seqnum", "start", "end", F.explode(sides).alias("x")).select("seqnum", "start", "end", "x.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for (n, s, e, strand, at, _), path in zip(b.itertuples(index=False), decode(list(b["w"])), strict=True):
                r = tract(path, **limits)
                if r:
                    x, y = (at + r[0], at + r[1] - 1) if strand == "+" else (at - r[1] + 1, at - r[0])
                    out.append((n, s, e, strand, x, y, r[2]))
            yield pd.DataFrame(out, columns=["seqnum", "start", "end", "strand", "ppt_start", "ppt_end", "box"])

    return rows.mapInPandas(run, f"seqnum {candidates.schema['seqnum'].dataType.simpleString()}, start long, end long, strand string, ppt_start long, ppt_end long, box int")


def binding_sites(candidates: DataFrame, seqs: DataFrame, trnas: DataFrame, radius: int = 30, seed: int = 6, min_length: int = 11, max_edits: int = 1, max_offset: int = 5, max_end: int = 5) -> DataFrame:
    """(seqnum, start, end, strand, trna, pbs_start, pbs_end, offset, trna_offset, edits): primer binding sites next to the repeat read first.

    The last letters of a tRNA (trna, seq), turned, are aligned with the window of `radius` letters behind the repeat on either strand;
    windows and tRNAs meet by a shared word of `seed` letters. The alignment holds min_length letters or more with at most
    max_edits edits, begins at most max_offset letters behind the repeat and at most max_end letters from the tRNA's end.
    Of several the one with the best score is given, then the smaller offset, then the first tRNA.
    """
    t = S.ascii_lower("seq")
    c = candidates.select("seqnum", "start", "end", "left_end", "right_start").join(seqs.select("seqnum", t.alias("t")), "seqnum")
    piece = lambda x, y: F.substring("t", x.cast("int"), F.greatest(y - x + 1, F.lit(0)).cast("int"))
    ahead, behind = F.least(F.col("left_end") + radius, F.col("right_start") - 1), F.greatest(F.col("right_start") - radius, F.col("left_end") + 1)
    sides = F.array(
        F.struct(F.lit("+").alias("strand"), (F.col("left_end") + 1).alias("at"), piece(F.col("left_end") + 1, ahead).alias("w")),
        F.struct(F.lit("-").alias("strand"), (F.col("right_start") - 1).alias("at"), S.reverse_complement(piece(behind, F.col("right_start") - 1)).alias("w")),
    )
    windows = c.select(F.struct("seqnum", "start", "end").alias("c"), F.explode(sides).alias("x")).select(F.struct("c", "x.strand").alias("seqnum"), "x.at", F.col("x.w").alias("seq"))
    ends = trnas.select(F.col("trna").alias("seqnum"), F.left(S.reverse_complement(S.ascii_lower("seq")), F.lit(radius)).alias("seq"))
    met = K.positions(windows, seed).select("kmer", F.col("seqnum").alias("k")).join(K.positions(ends, seed).select("kmer", F.col("seqnum").alias("trna")), "kmer").select("k", "trna").distinct()
    rows = met.join(windows.select(F.col("seqnum").alias("k"), "at", F.col("seq").alias("w")), "k").join(ends.select(F.col("seqnum").alias("trna"), F.col("seq").alias("v")), "trna")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for first in range(0, len(whole), lockstep.PAIRS):
                b = whole.iloc[first : first + lockstep.PAIRS].reset_index(drop=True)
                (w, nw), (v, nv) = lockstep.rows(b["w"].tolist()), lockstep.rows(b["v"].tolist())
                score, i, j, p, edits = lockstep.local_places(w, nw, v, nv, 5, -10, -20)
                good = (j - i >= min_length) & (edits <= max_edits) & (i <= max_offset) & (p <= max_end)
                out = b[["seqnum", "start", "end", "strand", "trna"]].assign(pbs_start=np.where(b["strand"] == "+", b["at"] + i, b["at"] - j + 1), pbs_end=np.where(b["strand"] == "+", b["at"] + j - 1, b["at"] - i))
                yield out.assign(offset=i, trna_offset=p, edits=edits, score=score.astype(np.int64))[good]

    kind = candidates.schema["seqnum"].dataType.simpleString()
    flat = rows.select("k.c.seqnum", "k.c.start", "k.c.end", "k.strand", F.col("trna").cast("string").alias("trna"), "at", "w", "v")
    found = flat.mapInPandas(run, f"seqnum {kind}, start long, end long, strand string, trna string, pbs_start long, pbs_end long, offset int, trna_offset int, edits int, score long")
    first = F.min_by(F.struct("trna", "pbs_start", "pbs_end", "offset", "trna_offset", "edits"), F.struct(-F.col("score"), "offset", "trna"))
    return found.groupBy("seqnum", "start", "end", "strand").agg(first.alias("b")).select("seqnum", "start", "end", "strand", "b.*")


def assign_strands(candidates: DataFrame, *found: DataFrame) -> DataFrame:
    """Candidates with `strand`: the one that more of the kinds of features found (seqnum, start, end, strand) speak for, else `?`."""
    vote: Column = F.lit(0)
    out = candidates
    for k, f in enumerate(found):
        side = f.groupBy("seqnum", "start", "end").agg(F.sign(F.sum(F.when(F.col("strand") == "+", 1).when(F.col("strand") == "-", -1).otherwise(0))).alias(f"__{k}"))
        out = out.join(side, ["seqnum", "start", "end"], "left")
        vote = vote + F.coalesce(f"__{k}", F.lit(0))
    return out.withColumn("strand", F.when(vote > 0, "+").when(vote < 0, "-").otherwise("?")).drop(*[f"__{k}" for k in range(len(found))])
