"""Ranks of all suffixes by prefix doubling on tables, and what neighbours in that order tell about matches.

A suffix starts with the code of its first 31 bases. A round of doubling takes the suffixes that are still alike over h bases and
looks up the ranks of the places h further on, which tells them apart over 2h. Ranks come from counts of distinct keys in a
range-partitioned sort, so a key that a third of all places share is one row there. Two neighbours' common prefix is found by
going down the rounds: a look-up of both places in each. A place ends at the next base other than a, c, g and t.

Only one row for each partition (and genome) comes to the driver: what a scan over the sorted suffixes hands on to the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import bases
from spanloom.session import with_checkpoints

FIRST = 31
#: Suffixes that one task sorts and scans.
PART = 1 << 20
_BIG = np.int64(1 << 33)


def places(seqs: DataFrame) -> DataFrame:
    """(g, seqnum, pos, left, code): all plain bases of `seqs` (g, seqnum, seq) with the bases up to the next other one and the first 31 as a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = bases.letters(batch.column(2))
            n = len(flat)
            plain = bases.plain_windows(flat, off, 1)
            ends = np.ones(n + 1, bool)
            ends[plain] = False
            ends[off] = True
            stop = np.flatnonzero(ends)
            digit = np.append(bases._ACGT[flat].astype(np.int64), np.zeros(FIRST, np.int64))
            for at in np.array_split(plain, max(1, len(plain) >> 20)):
                left = stop[np.searchsorted(stop, at, "right")] - at
                code = np.zeros(len(at), np.int64)
                for j in range(FIRST):
                    code = code << 2 | np.where(j < left, digit[at + j], 0)
                row = pa.array(np.searchsorted(off, at, "right") - 1)
                cols = [batch.column(0).take(row), batch.column(1).take(row), pa.array(at - off[row.to_numpy()]), pa.array(left), pa.array(code)]
                yield pa.RecordBatch.from_arrays(cols, names=["g", "seqnum", "pos", "left", "code"])

    return seqs.select(F.col("g").cast("int").alias("g"), "seqnum", "seq").mapInArrow(run, f"g int, seqnum {seqs.schema['seqnum'].dataType.simpleString()}, pos long, left long, code long")


def _parts(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART))


def counted_before(keys: DataFrame, group: str | None, order: list[str], rows: int) -> DataFrame:
    """`keys` (group, order..., n), all different, with `before`: the sum of n over smaller keys of the same group.

    Keys are sorted over all machines, groups of any size cut where partitions end; each partition sums up by itself, and what a group
    had in the partitions before is added afterwards.
    """
    cols = [*([group] if group else []), *order]
    kinds = ", ".join(f"{c} {keys.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n").to_numpy()
            name = b.column(group).to_numpy() if group else np.zeros(len(n), np.int64)
            new = np.append(last is None or name[0] != last, name[1:] != name[:-1])
            sums = np.cumsum(n) - n
            start = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
            before = sums - np.where(start >= 0, sums[start], -total)
            total, last = int(before[-1] + n[-1]), name[-1]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], b.column("n"), b.column("part"), pa.array(name), pa.array(before)], names=[*cols, "n", "part", "name", "before"])

    p = keys.repartitionByRange(_parts(keys, rows), *cols).sortWithinPartitions(*cols).withColumn("part", F.spark_partition_id())
    p = p.select(*cols, "n", "part").mapInArrow(run, f"{kinds}, n long, part int, name long, before long").checkpoint()
    ends = p.groupBy("part").agg(F.min("name").alias("first"), F.max("name").alias("last"), F.max_by(F.col("before") + F.col("n"), F.struct("name", "before")).alias("total")).orderBy("part").collect()
    carried, held, sizes = [], 0, None
    for r in ends:
        add = held if r.first == sizes else 0
        carried.append((r.part, r.first, add))
        held, sizes = r.total + (add if r.first == r.last else 0), r.last
    extra = p.sparkSession.createDataFrame(carried, "part int, name long, add long")
    return p.join(F.broadcast(extra), ["part", "name"], "left").select(*cols, "n", (F.col("before") + F.coalesce("add", F.lit(0))).alias("before"))


def ranked(at: DataFrame) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """((seqnum, pos, rank) of all places, [(h, (seqnum, pos, rank) of those whose first h bases occur elsewhere too)]).

    A rank is the number of smaller suffixes plus one, so equal suffixes share one; a shorter suffix comes before those that it begins.
    """
    n = at.count()
    size = F.least("left", F.lit(FIRST)).alias("size")
    first = counted_before(at.groupBy("code", size).agg(F.count("*").alias("n")), None, ["code", "size"], n)
    r = at.select("seqnum", "pos", "left", "code", size).join(first, ["code", "size"]).select("seqnum", "pos", "left", (F.col("before") + 1).alias("rank"), "n").checkpoint()
    ranks, alike, levels, h = r.select("seqnum", "pos", "rank"), r.where((F.col("n") > 1) & (F.col("left") >= FIRST)).drop("n"), [], FIRST
    while not alike.where(F.col("left") > h).isEmpty():
        levels.append((h, alike.select("seqnum", "pos", "rank")))
        ahead = ranks.select("seqnum", (F.col("pos") - h).alias("pos"), F.col("rank").alias("then"))
        pairs = alike.join(ahead.where("pos >= 0"), ["seqnum", "pos"], "left").select("seqnum", "pos", "left", "rank", F.when(F.col("left") > h, F.col("then")).otherwise(0).alias("then")).checkpoint()
        keys = counted_before(pairs.groupBy("rank", "then").agg(F.count("*").alias("n")), "rank", ["then"], n)
        new = pairs.join(keys, ["rank", "then"]).select("seqnum", "pos", "left", (F.col("rank") + F.col("before")).alias("rank"), "n").checkpoint()
        ranks = ranks.join(new.select("seqnum", "pos", F.col("rank").alias("now")), ["seqnum", "pos"], "left").select("seqnum", "pos", F.coalesce("now", "rank").alias("rank")).checkpoint()
        h *= 2
        alike = new.where((F.col("n") > 1) & (F.col("left") >= h)).drop("n")
    if not alike.isEmpty():
        levels.append((h, alike.select("seqnum", "pos", "rank")))
    return ranks, levels


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bases that two codes share."""
    x = a ^ b
    high = np.full(len(x), -1)
    for step in (32, 16, 8, 4, 2, 1):
        big = x >> step > 0
        high[big] += step
        x = np.where(big, x >> step, x)
    return np.where(a == b, FIRST, (61 - (high + 1)) // 2)


def _sorted_links(at: DataFrame, ranks: DataFrame, rows: int) -> DataFrame:
    """Places in order (part, i, g, seqnum, pos, left, code) with the place before each one, which for the first of a partition is in another."""
    kind = at.schema["seqnum"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            own = pa.Table.from_batches([b.select(["seqnum", "pos", "left", "code"])])
            before = pa.concat_tables([last if last is not None else own.slice(0, 1), own.slice(0, b.num_rows - 1)]).combine_chunks()
            whole = pa.array([last is not None] + [True] * (b.num_rows - 1))
            last = own.slice(b.num_rows - 1)
            i = pa.array(np.arange(done, done + b.num_rows))
            done += b.num_rows
            cols = [b.column(c) for c in ("part", "g", "seqnum", "pos", "left", "code")] + [c.chunk(0) for c in before.columns]
            yield pa.RecordBatch.from_arrays([i, whole, *cols], names=["i", "whole", "part", "g", "seqnum", "pos", "left", "code", "seqnum0", "pos0", "left0", "code0"])

    s = at.join(ranks, ["seqnum", "pos"]).repartitionByRange(_parts(at, rows), "rank", "seqnum", "pos").sortWithinPartitions("rank", "seqnum", "pos").withColumn("part", F.spark_partition_id())
    s = s.mapInArrow(run, f"i long, whole boolean, part int, g int, seqnum {kind}, pos long, left long, code long, seqnum0 {kind}, pos0 long, left0 long, code0 long").checkpoint()
    own = F.struct("seqnum", "pos", "left", "code")
    ends = s.groupBy("part").agg(F.max_by(own, "i").alias("last")).orderBy("part").collect()
    borders = [(b.part, *a["last"]) for a, b in zip(ends, ends[1:], strict=False)]
    before = s.sparkSession.createDataFrame(borders, f"part int, s {kind}, p long, l long, c long")
    j = s.join(F.broadcast(before), "part", "left")
    pick = lambda name, c: F.when(F.col("whole"), F.col(name)).otherwise(F.col(c)).alias(name)
    return j.select("part", "i", "g", "seqnum", "pos", "left", "code", pick("seqnum0", "s"), pick("pos0", "p"), pick("left0", "l"), pick("code0", "c"))


def _with_common(links: DataFrame, levels: list[tuple[int, DataFrame]], at: DataFrame) -> DataFrame:
    """(part, i, g, seqnum, pos, left, lcp): bases that each place in order shares with the one before; 0 for the very first."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = b.column("pos0").is_valid().to_numpy(zero_copy_only=False)
            get = lambda c, b=b: b.column(c).fill_null(0).to_numpy()
            n = np.minimum(np.minimum(_common(get("code"), get("code0")), get("left")), get("left0"))
            names = ["part", "i", "g", "seqnum", "pos", "left", "seqnum0", "pos0"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(np.where(there, n, 0))], names=[*names, "lcp"])

    kind = at.schema["seqnum"].dataType.simpleString()
    first = links.mapInArrow(short, f"part int, i long, g int, seqnum {kind}, pos long, left long, seqnum0 {kind}, pos0 long, lcp long").checkpoint()
    deep = first.where(F.col("lcp") == FIRST).select("part", "i", F.col("seqnum").alias("s"), F.col("pos").alias("p"), F.col("seqnum0").alias("t"), F.col("pos0").alias("q"), F.lit(0).cast("long").alias("l"))

    def met(df: DataFrame, rows: DataFrame, value: str) -> DataFrame:
        x = rows.select(F.col("seqnum").alias("s"), F.col("pos").alias("p1"), F.col(value).alias("x"))
        y = rows.select(F.col("seqnum").alias("t"), F.col("pos").alias("q1"), F.col(value).alias("y"))
        df = df.withColumn("p1", F.col("p") + F.col("l")).withColumn("q1", F.col("q") + F.col("l"))
        return df.join(x, ["s", "p1"], "left").join(y, ["t", "q1"], "left")

    cols = ["part", "i", "s", "p", "t", "q"]
    for h, rows in reversed(levels):
        deep = met(deep, rows, "rank").select(*cols, (F.col("l") + F.when(F.col("x") == F.col("y"), h).otherwise(0)).alias("l")).checkpoint()
    tail = met(deep, at.withColumn("c", F.struct("code", F.least("left", F.lit(FIRST)).alias("n"))), "c").where("x IS NOT NULL AND y IS NOT NULL")
    tail = tail.select("part", "i", "l", F.col("x.code").alias("a"), F.col("y.code").alias("b"), F.least("x.n", "y.n").alias("n"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, n, add = (b.column(x).to_numpy() for x in ("a", "b", "n", "l"))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("i"), pa.array(add + np.minimum(_common(a, c), n))], names=["part", "i", "far"])

    far = tail.mapInArrow(rest, "part int, i long, far long").unionByName(deep.select("part", "i", F.col("l").alias("far"))).groupBy("part", "i").agg(F.max("far").alias("far"))
    return first.join(far, ["part", "i"], "left").select("part", "i", "g", "seqnum", "pos", "left", F.coalesce("far", "lcp").alias("lcp"))


def nearest(g: np.ndarray, link: np.ndarray, b: int, one: int = 0, two: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bases that each row shares with the last row of genome b before it, and with the one before that.

    `link` has what a row shares with the row before; `one` and `two` are what reaches in from before the first row: the bases that it
    shares with the last row of b there, and that row with the one before.
    """
    mine = g == b
    seg = np.cumsum(mine) - mine
    # A minimum that starts again behind each row of b: earlier stretches are lifted out of its way.
    run = np.minimum.accumulate(link - seg * _BIG) + seg * _BIG
    f1 = np.where(seg == 0, np.minimum(run, one), run)
    last = np.maximum.accumulate(np.where(mine, np.arange(len(g)), -1))
    last = np.append(-1, last[:-1])
    return f1, np.minimum(f1, np.where(last >= 0, f1[np.maximum(last, 0)], two))


def summary(g: np.ndarray, link: np.ndarray, b: int) -> tuple[int, int, int, int]:
    """(rows of b, least link up to the first of them, least link behind the last, what the last shares with the one before)."""
    mine = np.flatnonzero(g == b)
    if not len(mine):
        return 0, 0, int(link.min()), 0
    after = link[mine[-1] + 1 :]
    between = link[mine[-2] + 1 : mine[-1] + 1].min() if len(mine) > 1 else 0
    return len(mine), int(link[: mine[0] + 1].min()), int(after.min()) if len(after) else 1 << 32, int(between)


def handed_on(parts: list[dict[int, tuple[int, int, int, int]]], genomes: int) -> list[dict[int, tuple[int, int]]]:
    """What reaches into each part, for each genome, from the summaries of the parts before it."""
    state, out = dict.fromkeys(range(genomes), (0, 0)), []
    for part in parts:
        out.append(dict(state))
        for b, (n, head, tail, between) in part.items():
            one, two = state[b]
            if n:
                two = between if n > 1 else min(one, head)
            state[b] = (tail if n else min(one, tail), two)
    return out


def scan(genomes: DataFrame, count: int, emit: Callable[..., tuple], schema: str) -> DataFrame:
    """Rows that `emit(batch, look)` makes of each run of places in order of their suffixes; `genomes` has (g, seqnum, seq), g below `count`.

    look(b) gives four arrays: what each place shares with the nearest places of genome b before (two) and after it (two). A part
    of the order is PART places or so and is held whole.
    """
    with_checkpoints(genomes.sparkSession)
    at = places(genomes).checkpoint()
    rows = at.count()
    ranks, levels = ranked(at)
    order = _with_common(_sorted_links(at, ranks, rows), levels, at).repartition("part").sortWithinPartitions("part", "i").checkpoint()
    firsts = order.where("i = 0").select("part", "lcp").orderBy("part").collect()
    following = {a.part: b.lcp for a, b in zip(firsts, firsts[1:], strict=False)}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column("part").to_numpy()
            cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if held and i < j and held[-1].column("part")[0].as_py() != part[i]:
                    yield held[0].column("part")[0].as_py(), pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                if i < j:
                    held.append(batch.slice(i, j - i))
        if held:
            yield held[0].column("part")[0].as_py(), pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def both(part: int, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Genomes, links to the row before, and links to the row after in reverse order."""
        link = b.column("lcp").to_numpy()
        return b.column("g").to_numpy(), link, np.append(following.get(part, 0), link[:0:-1])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in whole(batches):
            g, fore, back = both(part, batch)
            r = [(part, b, way, *summary(x, link, b)) for b in range(count) for way, x, link in ((0, g, fore), (1, g[::-1], back))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*r, strict=True)], names=["part", "b", "way", "n", "head", "tail", "between"])

    sums: dict[int, dict[int, dict]] = {0: {}, 1: {}}
    for r in order.mapInArrow(summed, "part long, b long, way long, n long, head long, tail long, between long").collect():
        sums[r.way].setdefault(r.part, {})[r.b] = (r.n, r["head"], r.tail, r.between)
    names = sorted(sums[0])
    fore = dict(zip(names, handed_on([sums[0][p] for p in names], count), strict=True))
    back = dict(zip(names[::-1], handed_on([sums[1][p] for p in names[::-1]], count), strict=True))

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in whole(batches):
            g, link, rlink = both(part, batch)

            def look(b: int, part=part, g=g, link=link, rlink=rlink):
                after = nearest(g[::-1], rlink, b, *back[part][b])
                return (*nearest(g, link, b, *fore[part][b]), *(x[::-1] for x in after))

            cols, names = emit(batch, look)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return order.mapInArrow(emitted, schema)


def matched_sums(genomes: DataFrame, count: int) -> DataFrame:
    """(a, b, sum, whole, n): over all n places of genome a the sum of the longest substrings there that genome b holds, and of all bases up to their ends."""

    def emit(batch: pa.RecordBatch, look) -> tuple:
        g, left, out = batch.column("g").to_numpy(), batch.column("left").to_numpy(), []
        for b in range(count):
            f, _, r, _ = look(b)
            best = np.maximum(f, r)
            out += [(a, b, int(best[g == a].sum()), int(left[g == a].sum()), int((g == a).sum())) for a in np.unique(g).tolist() if a != b]
        return [pa.array(c, pa.int64()) for c in (list(zip(*out, strict=True)) or [[]] * 5)], ["a", "b", "sum", "whole", "n"]

    return scan(genomes, count, emit, "a long, b long, sum long, whole long, n long").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("sum", "whole", "n")])


def _against(queries: DataFrame, target: DataFrame, emit) -> DataFrame:
    kind = queries.schema["seqnum"].dataType.simpleString()
    numbered = lambda df, g: df.select(F.lit(g).alias("g"), F.struct(F.lit(g).alias("g"), F.col("seqnum").cast(kind).alias("s")).alias("seqnum"), "seq")
    both = numbered(queries, 0).unionByName(numbered(target, 1))
    return scan(both, 2, emit, f"seqnum struct<g: int, s: {kind}>, pos long, length long").select(F.col("seqnum.s").alias("seqnum"), F.col("pos").cast("int").alias("pos"), F.col("length").cast("int").alias("length"))


def longest_matches(queries: DataFrame, target: DataFrame, shortest: int = 1) -> DataFrame:
    """Matching statistics (seqnum, pos, length): at each place the longest substring of plain bases that the target holds, of any length."""

    def emit(batch: pa.RecordBatch, look) -> tuple:
        f, _, r, _ = look(1)
        best = np.maximum(f, r)
        keep = pa.array((batch.column("g").to_numpy() == 0) & (best >= shortest))
        return [batch.column("seqnum").filter(keep), batch.column("pos").filter(keep), pa.array(best).filter(keep)], ["seqnum", "pos", "length"]

    return _against(queries, target, emit)


def unique_prefixes(queries: DataFrame, target: DataFrame) -> DataFrame:
    """(seqnum, pos, length): at each place of the queries the shortest prefix, of any length, that occurs exactly once in the target.

    It is one base longer than what the place shares with the second best of its two nearest target suffixes on either side.
    """

    def emit(batch: pa.RecordBatch, look) -> tuple:
        near = np.sort(np.stack(look(1)), axis=0)
        keep = pa.array((batch.column("g").to_numpy() == 0) & (near[-1] > near[-2]))
        return [batch.column("seqnum").filter(keep), batch.column("pos").filter(keep), pa.array(near[-2] + 1).filter(keep)], ["seqnum", "pos", "length"]

    return _against(queries, target, emit)
