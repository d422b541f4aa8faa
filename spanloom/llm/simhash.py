"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import _flat
from spanloom.llm._base import materialize, table, text_key
from spanloom.llm._components import components

#: A bucket of more distinct fingerprints than this is cut further, by a second pigeonhole.
BUCKET = 4096

#: Each bit of a byte in a lane of its own, so that eight counters add up in one 64-bit sum.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _majority(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row: the bits that are set in over half of the row's hashes; 0 where it has none."""
    count = np.bincount(row, minlength=rows)
    out = np.zeros(rows, np.uint64)
    if not len(hashes):
        return out
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(count, out=first[1:])
    # Lanes hold up to 255, so long rows are added up in pieces of that length.
    pieces = -(-count // 255)
    owner = np.repeat(np.arange(rows), pieces)
    begin = np.cumsum(pieces) - pieces
    nth = np.arange(len(owner)) - np.repeat(begin, pieces)
    at = first[owner] + 255 * nth
    some = pieces > 0
    byte = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[byte[:, k]], at).view(np.uint8).reshape(-1, 8)
        sums = np.zeros((rows, 8), np.int64)
        sums[some] = np.add.reduceat(lanes, begin[some], axis=0, dtype=np.int64)
        bits = np.packbits(2 * sums > count[:, None], axis=1, bitorder="little")[:, 0]
        out |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(column: pa.Array, n: int = 4) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text of an Arrow column."""
    buf, off = _flat.buffer_of(column)
    out = np.zeros(len(off) - 1, np.uint64)
    for i, j, b, o in _flat.blocks(buf, off):
        s, e, row = _flat.words(b, o, _flat.NON_SPACE)
        if not len(s):
            continue
        # The words again, lower-cased and one space apart: a shingle is then one slice.
        size = e - s
        to = np.cumsum(size + 1) - (size + 1)
        flat = np.full(int(to[-1] + size[-1]), 32, np.uint8)
        flat[np.repeat(to, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = _flat.LOWER[b[np.repeat(s, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]]
        count = np.bincount(row, minlength=j - i)
        last = np.cumsum(count)
        first = last - count
        # A row of fewer than n words is one shingle.
        shingles = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
        owner = np.repeat(np.arange(j - i), shingles)
        head = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        tail = np.minimum(head + n, last[owner]) - 1
        data = flat.tobytes()
        h = np.fromiter((xxhash.xxh64_intdigest(data[x:y], 42) for x, y in zip(to[head].tolist(), (to[tail] + size[tail]).tolist(), strict=True)), np.uint64, len(head))
        out[i:j] = _majority(h, owner, j - i)
    return out


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, fp): the fingerprint as a signed long; null text counts as empty, without words it is 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1)).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _masks(bits: range, blocks: int, keep: int) -> list[int]:
    """Masks over each choice of `keep` of `blocks` even parts of the bits."""
    parts = [sum(1 << b for b in x.tolist()) for x in np.array_split(np.array(bits), blocks)]
    return [sum(c) for c in combinations(parts, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: With 7 blocks and up to 4 differing bits, 3 blocks at least are equal: 35 keys of about 27 bits.
DISTANCE = 4
MASKS = [_signed(m) for m in _masks(range(64), 7, 3)]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits; counted unsigned, as the count of a signed number is that of its absolute value."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def connect(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the graph of fingerprints at most DISTANCE bits apart, breadth first.

    Each reached fingerprint is compared with those not yet reached, so a tight group costs one
    pass and no more than len(fp) - 1 links come out.
    """
    fp = np.unique(fp)
    left, a, b = fp.copy(), [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = _apart(left, x) <= DISTANCE
            got = left[near]
            if len(got):
                a.append(np.full(len(got), x))
                b.append(got)
                frontier += list(got)
                left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _key_runs(keys: list[np.ndarray]) -> np.ndarray:
    """First row of each run of equal rows of `keys`."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sorted_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each bucket of rows (key columns..., fp) that come sorted by key."""

    def linked(cols: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
        fp, a, b = cols[-1], [], []
        first, size = ends[:-1], np.diff(ends)
        # Most buckets are pairs: one comparison for all of them.
        two = first[size == 2]
        x, y = fp[two], fp[two + 1]
        near = (_apart(x, y) <= DISTANCE) & (x != y)
        a.append(x[near])
        b.append(y[near])
        for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            u, v = connect(fp[f : f + n])
            a.append(u)
            b.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held and all(h[-1] == c[0] for h, c in zip(held[-1][:-1], cols[:-1], strict=True)):
            # The bucket that was open goes on: its rows wait until another key begins.
            stop = _key_runs(cols[:-1])
            if len(stop) == 1:
                held.append(cols)
                continue
        if held:
            cols = [np.concatenate(c) for c in zip(*held, cols, strict=True)]
        start = _key_runs(cols[:-1])
        if len(start) > 1:
            yield linked(cols, start)
        held = [[c[start[-1] :] for c in cols]]
    if held:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield linked(cols, np.array([0, len(cols[0])]))


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, k, n): keys that several fingerprints of one batch share."""
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for c, m in enumerate(MASKS):
            k, n = np.unique(fp & m, return_counts=True)
            some = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), c, np.int32)), pa.array(k[some]), pa.array(n[some].astype(np.int64))], names=["c", "k", "n"])


def _inner_masks() -> list[list[int]]:
    """For each mask: 8 parts of the bits it leaves free, 4 equal."""
    out = []
    for m in MASKS:
        parts = [sum(1 << int(b) for b in x) for x in np.array_split(np.array([b for b in range(64) if not (m >> b) & 1]), 8)]
        out.append([_signed(sum(x)) for x in combinations(parts, 4)])
    return out


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all of `fps` (distinct longs) that are linked by chains of near pairs.

    Fingerprints share a block key, and each bucket gives its spanning links: no pair list grows
    with the square of a bucket. Every (key, fingerprint) is dealt out once, sorted by key, and
    each task streams through its buckets. Keys that several rows of a batch share are counted
    first; where that comes to more than BUCKET fingerprints the bucket is cut by a second
    pigeonhole over the bits that the first key leaves free (8 parts of them, 4 equal), which
    spreads it over many tasks and is exact again: what is left of it has 2**20 members at most.
    """
    key = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for c, m in enumerate(MASKS)]))
    keyed = fps.select("fp", key.alias("x")).select("x.c", "x.k", "fp")
    hot = fps.mapInArrow(_local_counts, "c int, k long, n long").groupBy("c", "k").agg(F.sum("n").alias("n")).where(F.col("n") > BUCKET)
    hot = materialize(hot.select("c", "k", F.lit(True).alias("hot")), "hot")
    by = ["c", "k"]
    if not hot.isEmpty():
        whole = F.array(F.struct(F.lit(-1).alias("d"), F.lit(0).cast("long").alias("j")))
        inner = F.array(*[F.array(*map(F.lit, m)) for m in _inner_masks()])
        cut = F.transform(F.element_at(inner, F.col("c") + 1), lambda m, d: F.struct(d.alias("d"), F.col("fp").bitwiseAND(m).alias("j")))
        keyed = keyed.join(hot, by, "left").select(*by, F.explode(F.when(F.col("hot"), cut).otherwise(whole)).alias("x"), "fp").select(*by, "x.d", "x.j", "fp")
        by = [*by, "d", "j"]
    return keyed.repartition(*by).sortWithinPartitions(*by).mapInArrow(_sorted_links, "a long, b long")


def near_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, component_id) of every document.

    fp is the SimHash as a signed long; component_id the smallest id reachable over links of at
    most DISTANCE differing bits, itself included (null ids count for nothing; a component of
    null ids only has null). Repeated rows and equal texts share a fingerprint and so a
    component; other columns are ignored; an empty table gives no rows.
    """
    base = materialize(with_fingerprint(docs, id_col, text_col), "fingerprints")
    distinct = materialize(base.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "distinct")
    joined = materialize(links(distinct.select("fp")), "links")
    root = components(joined, "a", "b").select(F.col("node").alias("fp"), "root")
    linked = distinct.join(root, "fp").select("fp", "root", "low")
    least = linked.groupBy("root").agg(F.min("low").alias("least"))
    linked = linked.join(least, "root").select("fp", "least")
    # A fingerprint of one document without links names itself: only the others are looked up.
    alone = distinct.where("n > 1").join(root, "fp", "left_anti").select("fp", F.col("low").alias("least"))
    named = materialize(linked.unionByName(alone).withColumn("found", F.lit(True)), "named")
    own = F.when(F.col("found"), F.col("least")).otherwise(F.col("id"))
    return base.join(named, "fp", "left").select("id", "fp", own.alias("component_id"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and empty texts have fingerprint zero and one component, see `near_components`."""
    r = near_components(table(spark, sf_dir, "documents"), "doc_id", "text")
    return r.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each near-duplicate group left; all its columns stay, whatever their names.

    The one with the smallest id stays (null ids last), of several such rows the one whose text has
    the smallest MD5, of rows equal in both any one. Null texts count as empty, and texts without words
    are one group; an empty table stays empty.
    """
    named = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("text"))
    near = near_components(named, "k", "text").groupBy("id").agg(F.first("component_id").alias("group")).select(F.col("id").alias("k"), "group")
    # Copies of a row meet as one, with their number, before any group is formed.
    pairs = named.groupBy("id", "k").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "k", "n")
    # So do the rows of one text, with the best of them: a join by text moves one row for all its copies.
    best = pairs.groupBy("k").agg(F.min(rank).alias("x"))
    chosen = best.join(near, "k").groupBy("group").agg(F.min("x").alias("x")).select("x.id", "x.k", "x.n")
    chosen = materialize(chosen, "chosen")
    # The row travels as one column, so that no name of its own meets one of ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"))
    found = lambda part: rows.alias("r").join(part.alias("c"), F.expr("r.k = c.k AND r.id <=> c.id"), "left_semi")
    once, copied = found(chosen.where("n = 1")), found(chosen.where("n > 1")).dropDuplicates(["id", "k"])
    return once.unionByName(copied).select("row.*")
