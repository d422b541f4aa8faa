"""Seeds extended greedily by diagonal fronts, with traces as cigars and the usual columns of an alignment table.

A front holds, for each diagonal, the furthest place that a number of edits reaches; runs of equal letters are passed eight at a
time. Of each place the last letters' history of matches is kept: places with too few, and places far behind the furthest one, are given up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import sequences as S
from spanloom.functions import stats
from spanloom.operators import kmers as K
from spanloom.operators.alignments import maximal_matches

_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in "acgt"]] = True


def letters(text: str, other: int) -> np.ndarray:
    """Letters as bytes, those other than a, c, g and t as `other`, so that they equal nothing."""
    x = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    return np.where(_PLAIN[x], x, np.uint8(other))


def _words(x: np.ndarray, pad: int) -> np.ndarray:
    """The eight letters from each place on as one number; behind the end stands `pad`."""
    x = np.append(x, np.full(8, pad, np.uint8))
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, 8)).view("<u8").ravel()


def extend(u: np.ndarray, v: np.ndarray, min_identity: float = 80.0, history: int = 60, least: float = 0.55, lag: int = 30) -> tuple[int, int, int, str]:
    """(letters of u, letters of v, edits, operations) of the best extension from the start of both.

    With i and j letters and d edits an extension is worth i + j - d * c, where c makes an alignment of just `min_identity` worth
    nothing; the best and, of equal ones, that of fewer edits is taken. A place is given up if less than the share `least` of its last
    `history` columns are matches, or if it is more than `lag` letters (of both) behind the furthest.
    """
    n, m = len(u), len(v)
    uw, vw = _words(u, 250), _words(v, 251)
    price = 2 / (1 - min_identity / 100)
    mask, need = np.uint64((1 << history) - 1), least * history

    def slide(i: np.ndarray, k: np.ndarray, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, open_, start = i.copy(), np.arange(len(i)), i
        while len(open_):
            x = uw[i[open_]] ^ vw[i[open_] - k[open_]]
            # Equal letters before the first difference: the lowest byte comes first.
            low = x & (~x + np.uint64(1))
            run = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
            i[open_] += run
            open_ = open_[run == 8]
        size = np.minimum(i - start, history)
        fresh = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
        return i, ((hist << size.astype(np.uint64)) | fresh) & mask

    lo, k0 = 0, np.zeros(1, np.int64)
    reach, hist = slide(np.zeros(1, np.int64), k0, np.array([mask]))
    fronts = [(lo, np.zeros(1, np.int64), reach, np.zeros(1, np.int8))]
    best, at = 2 * int(reach[0]), (0, 0)
    while True:
        d = len(fronts)
        k = np.arange(lo - 1, lo + len(reach) + 1)
        gone = np.full(1, -1)
        # From the same diagonal by a replacement, from below by a letter of u, from above by a letter of v.
        own, below, above = (np.concatenate(x) for x in ((gone, reach, gone), (gone, gone, reach), (reach, gone, gone)))
        ways = np.stack([np.where(own >= 0, own + 1, -1), np.where(below >= 0, below + 1, -1), above])
        ways = np.where((ways <= n) & (ways - k <= m) & (ways >= 0) & (ways - k >= 0), ways, -1)
        way = ways.argmax(0)
        start = ways[way, np.arange(len(k))]
        none = np.zeros(1, np.uint64)
        old = np.stack([np.concatenate(x) for x in ((none, hist, none), (none, none, hist), (hist, none, none))])[way, np.arange(len(k))]
        live = np.flatnonzero(start >= 0)
        if not len(live):
            break
        start, k, way = start[live[0] : live[-1] + 1], k[live[0] : live[-1] + 1], way[live[0] : live[-1] + 1]
        old = old[live[0] : live[-1] + 1]
        there = start >= 0
        new, past = start.copy(), np.zeros(len(k), np.uint64)
        new[there], past[there] = slide(start[there], k[there], (old[there] << np.uint64(1)) & mask)
        far = 2 * new - k
        good = there & (np.bitwise_count(past) >= need) & (far >= far[there].max() - lag)
        new[~good] = -1
        live = np.flatnonzero(good)
        if not len(live):
            break
        cut = slice(live[0], live[-1] + 1)
        lo, reach, hist = int(k[cut][0]), new[cut], past[cut]
        fronts.append((lo, start[cut], reach, way[cut].astype(np.int8)))
        worth = np.where(reach >= 0, far[cut] - d * price, -np.inf)
        x = int(worth.argmax())
        if worth[x] > best + 1e-9:
            best, at = worth[x], (d, lo + x)
    d, k = at
    end = int(fronts[d][2][k - fronts[d][0]])
    i, ops = end, []
    for e in range(d, -1, -1):
        lo, start, _, way = fronts[e]
        x = k - lo
        ops.append("=" * (i - int(start[x])))
        i = int(start[x])
        if e:
            ops.append("XDI"[way[x]])
            i, k = (i - 1, k) if way[x] == 0 else (i - 1, k - 1) if way[x] == 1 else (i, k + 1)
    return end, end - at[1], d, "".join(ops[::-1])


def cigar(ops: str) -> str:
    return re.sub(r"(.)\1*", lambda m: f"{len(m[0])}{m[1]}", ops)


COLUMNS = {
    "a_start": "long", "a_end": "long", "b_start": "long", "b_end": "long", "score": "long", "distance": "long", "identity": "double", "length": "long",
    "matches": "long", "mismatches": "long", "indels": "long", "gap_opens": "long", "cigar": "string", "seed_length": "long", "seed_a": "long", "seed_b": "long", "a_seqlen": "long", "b_seqlen": "long",
}


def extended(u: np.ndarray, v: np.ndarray, x: int, y: int, size: int, min_identity: float, **limits) -> tuple:
    """The row of COLUMNS of the match u[x : x + size] = v[y : y + size], extended to both sides."""
    li, lj, ld, left = extend(u[:x][::-1], v[:y][::-1], min_identity, **limits)
    ri, rj, rd, right = extend(u[x + size :], v[y + size :], min_identity, **limits)
    s, e, p, q, d = x - li, x + size + ri, y - lj, y + size + rj, ld + rd
    ops = left[::-1] + "=" * size + right
    gaps = [len(g) for g in re.findall("I+|D+", ops)]
    both = e - s + q - p
    return s, e - 1, p, q - 1, both - 3 * d, d, 100.0 * (1 - 2 * d / both), len(ops), ops.count("="), ops.count("X"), sum(gaps), len(gaps), cigar(ops), size, x, y, len(u), len(v)


def front_extensions(
    a: DataFrame, b: DataFrame, k: int, max_frequency: int, min_length: int, min_identity: float = 80.0, band_log2: int = 4, min_coverage: int | None = None, reverse: bool = False, only: Column | None = None, **limits
) -> DataFrame:
    """(a, b, strand, COLUMNS..., bit_score, evalue): greedy extensions of exact seeds between sequences of two tables.

    Shared k-mers of limited frequency, in diagonal bands that they cover well, become maximal matches, and each, the longest
    first, is extended unless an earlier extension of the pair holds it. A score is 2 for a match, -1 for a replacement and -2 for a gap letter.
    Starts are 0-based, ends closed; with `reverse` the reverse complements of b are searched as well, and their places count from
    their own start. With `only`, a condition on a and b, other pairs are left out. The expected number is over all letters of both tables.
    """
    text = lambda df, side, name, x: df.select(F.col("seqnum").alias(side), x.alias(name))
    parts = []
    for strand in ("+", "-") if reverse else ("+",):
        seq = S.ascii_lower("seq") if strand == "+" else S.reverse_complement(S.ascii_lower("seq"))
        other = b.select("seqnum", seq.alias("seq"))
        found = K.seeds(a, other, k, max_frequency)
        found = found if only is None else found.where(only)
        kept = K.in_bands(found, k, band_log2, k if min_coverage is None else min_coverage)
        m = maximal_matches(kept, k)
        per = m.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).cast("long").alias("w"), F.col("a_start").cast("long").alias("x"), F.col("b_start").cast("long").alias("y")))).alias("matches"))
        parts.append(per.join(text(a, "a", "u", S.ascii_lower("seq")), "a").join(text(other, "b", "v", F.col("seq")), "b").select("a", "b", F.lit(strand).alias("strand"), "u", "v", "matches"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, j, strand, u, v, matches in batch.itertuples(index=False):
                x, y, done = letters(u, 252), letters(v, 253), np.zeros((0, 4), np.int64)
                for m in matches:
                    p, q, size = m["x"], m["y"], -m["w"]
                    if ((done[:, 0] <= p) & (p + size - 1 <= done[:, 1]) & (done[:, 2] <= q) & (q + size - 1 <= done[:, 3])).any():
                        continue
                    r = extended(x, y, p, q, size, min_identity, **limits)
                    if (done == r[:4]).all(1).any():
                        continue
                    done = np.append(done, [r[:4]], axis=0)
                    if min(r[1] - r[0], r[3] - r[2]) + 1 >= min_length and r[6] >= min_identity:
                        out.append((i, j, strand, *r))
            yield pd.DataFrame(out, columns=["a", "b", "strand", *COLUMNS])

    schema = ", ".join(f"{n} {t}" for n, t in COLUMNS.items())
    got = rows.mapInPandas(run, f"a {a.schema['seqnum'].dataType.simpleString()}, b {b.schema['seqnum'].dataType.simpleString()}, strand string, {schema}")
    size = lambda df: df.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("double").alias("n"))
    space = size(a).crossJoin(size(b).withColumnRenamed("n", "m")).select((F.col("n") * F.col("m")).alias("space"))
    lam, kappa, _ = stats.karlin_altschul(2, -1)
    with_space = got.crossJoin(F.broadcast(space))
    return with_space.select("a", "b", "strand", *COLUMNS, stats.bit_score(F.col("score"), lam, kappa).alias("bit_score"), stats.e_value(F.col("score"), F.col("space"), lam, kappa).alias("evalue"))


def average_identity(extensions: DataFrame, a: Column, b: Column) -> DataFrame:
    """(a, b, identity, length): matches over columns of all extensions between two genomes, `a` and `b` naming them."""
    sums = extensions.groupBy(a.alias("a"), b.alias("b")).agg(F.sum("matches").alias("m"), F.sum("length").alias("length"))
    return sums.select("a", "b", (F.col("m") / F.col("length")).alias("identity"), "length")
