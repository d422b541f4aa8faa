"""Suffix-array dedup: remove every byte that lies in a string of WIDTH bytes starting anywhere else too.

A window of WIDTH bytes picks its anchor: the k-gram in it with the smallest hash, the leftmost of
several. Equal windows pick equal anchors, so only spans (runs of windows with one anchor) of
equal anchors need comparing, and most anchors occur once. A span that occurs twice as a whole is
all repeats. What is left are spans that share an anchor but not all their bytes; these go to
shards by anchor. A shard's spans are one string: its suffix array is made by induced sorting,
its permuted common prefixes tell which windows repeat. Anchors of very many different spans are
split further, by the hash of each window, so that no shard grows with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import _flat
from spanloom.llm._base import materialize, table, text_key

WIDTH = 400
GRAM = 32
#: Bytes of a shard, and of one anchor's different spans beyond which it is split by window.
SHARD_BYTES = 3 << 20
HOT_BYTES = 1 << 20

#: Windows of a long text that are looked at together, and bits of a place among them.
WINDOWS = 1 << 22
_PLACE = np.uint64((1 << 30) - 1)


# ---- suffix arrays -------------------------------------------------------------------------


def _suffix_types(x: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); the end counts as smallest."""
    n = len(x)
    differs = np.flatnonzero(x[:-1] != x[1:])
    after = np.searchsorted(differs, np.arange(n))
    found = after < len(differs)
    at = differs[np.minimum(after, max(len(differs) - 1, 0))] if len(differs) else np.zeros(n, np.int64)
    out = np.zeros(n, bool)
    out[found] = x[at[found]] < x[at[found] + 1]
    return out


class _Buckets:
    """Lists of positions by character, filled in order."""

    def __init__(self) -> None:
        self.held: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(self, at: np.ndarray, char: np.ndarray) -> None:
        if not len(at):
            return
        order = np.argsort(char, kind="stable")
        at, char = at[order], char[order]
        cut = np.flatnonzero(char[1:] != char[:-1]) + 1
        for c, part in zip(char[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
            self.held[c].append(part)

    def take(self, c: int) -> np.ndarray:
        got, self.held[c] = self.held[c], []
        return np.concatenate(got) if got else np.zeros(0, np.int64)


def _induce(x: np.ndarray, small: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes from that of the leftmost-small ones: L-types left to right, then S-types right to left.

    Returns (suffix array, S-type suffixes in order). A bucket is scanned in waves, each the
    positions that the wave before put into the same bucket, so a wave is a few array operations.
    """
    n = len(x)
    seeds, pending = _Buckets(), _Buckets()
    seeds.deal(lms, x[lms])
    pending.deal(np.array([n - 1]), x[n - 1 :])
    large: list[np.ndarray] = []
    for c in range(256):
        waves, cur = [], pending.take(c)
        while len(cur):
            waves.append(cur)
            j = cur[cur > 0] - 1
            j = j[~small[j]]
            char = x[j]
            pending.deal(j[char > c], char[char > c])
            cur = j[char == c]
        large.append(np.concatenate(waves) if waves else np.zeros(0, np.int64))
        j = seeds.take(c) - 1
        pending.deal(j, x[j])
    s_order: list[np.ndarray] = [large[0]] * 256
    for c in range(255, -1, -1):
        waves, cur = [], pending.take(c)
        while len(cur):
            waves.append(cur)
            j = cur[cur > 0] - 1
            j = j[small[j]]
            char = x[j]
            pending.deal(j[char < c], char[char < c])
            cur = j[char == c]
        s_order[c] = np.concatenate(waves)[::-1] if waves else np.zeros(0, np.int64)
        j = large[c][::-1]
        j = j[j > 0] - 1
        j = j[small[j]]
        pending.deal(j, x[j])
    return np.concatenate([z for c in range(256) for z in (large[c], s_order[c])]), np.concatenate(s_order)


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the bytes `x` in order of their first `depth` bytes at least.

    Leftmost-small substrings are sorted by inducing from any order, named, and the shorter string
    of names is sorted in turn; the whole is induced from that. The string of names is sorted by
    doubling, since arrays have no fast scan over an unbounded alphabet, and only until the names
    differ or cover `depth` bytes (two bytes a name at least).
    """
    n = len(x)
    if n < 2:
        return np.arange(n)
    small = _suffix_types(x)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _induce(x, small, lms)[0]
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    _, order = _induce(x, small, lms)
    order = order[is_lms[order]]
    nth = np.empty(n, np.int64)
    nth[lms] = np.arange(len(lms))
    end = np.append(lms[1:] + 1, n)
    h = _flat.span_hashes(_flat.BYTE_VALUES[x], lms, end)[nth[order]]
    size = (end - lms)[nth[order]]
    last = nth[order] == len(lms) - 1
    new = np.ones(len(lms), bool)
    new[1:] = (h[1:] != h[:-1]) | (size[1:] != size[:-1]) | last[1:] | last[:-1]
    name = np.empty(len(lms), np.int64)
    name[nth[order]] = np.cumsum(new)
    k = 1
    while name.max() < len(lms) and 2 * k < depth + 2:
        pair = name * (len(lms) + 1)
        pair[:-k] += name[k:]
        order = np.argsort(pair)
        p = pair[order]
        name[order] = np.cumsum(np.concatenate([[True], p[1:] != p[:-1]]))
        k *= 2
    return _induce(x, small, lms[np.argsort(name, kind="stable")])[0]


def common_prefixes(x: np.ndarray, sa: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): for each position the suffix before it in order, and their common prefix, in order of position.

    `left` bounds each position's prefix (bytes to the end of its span). Where phi goes on by one
    with the position, the prefix is one shorter; only the others are compared, eight bytes at a time.
    """
    n = len(x)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    own[1:] = (phi[1:] != phi[:-1] + 1) | (phi[:-1] < 0) | (left[1:] > left[:-1])
    own &= phi >= 0
    at = np.flatnonzero(own)
    other = phi[at]
    most = np.minimum(left[at], left[other])
    padded = np.concatenate([x, np.zeros(16, np.uint8)])
    word = np.ndarray((n + 8,), "<u8", padded.tobytes(), strides=(1,))
    length, live, k = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(live):
        d = word[at[live] + k] ^ word[other[live] + k]
        same = d == 0
        low = d & (~d + np.uint64(1))
        length[live] = k + np.where(same, 8, (np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64))
        k += 8
        live = live[same & (most[live] > k)]
        live = live[(at[live] + k < n) & (other[live] + k < n)]
    value = np.zeros(n, np.int64)
    value[at] = np.minimum(length, most)
    source = np.maximum.accumulate(np.where(own | (phi < 0), np.arange(n), 0))
    return phi, np.maximum(value[source] - (np.arange(n) - source), 0)


def repeated_windows(spans: list[bytes], width: int) -> list[np.ndarray]:
    """Per span: which of its windows of `width` bytes also start anywhere else in the spans. Spans hold no byte 255."""
    x = np.frombuffer(b"\xff".join(spans) + b"\xff", np.uint8)
    size = np.array([len(s) for s in spans])
    first = np.cumsum(size + 1) - (size + 1)
    left = np.repeat(first + size, size + 1) - np.arange(len(x))
    phi, plcp = common_prefixes(x, suffix_array(x, width), left)
    hit = np.flatnonzero(plcp >= width)
    again = np.zeros(len(x), bool)
    again[hit] = True
    again[phi[hit]] = True
    return [again[f : f + max(n - width + 1, 0)] for f, n in zip(first.tolist(), size.tolist(), strict=True)]


# ---- anchors -------------------------------------------------------------------------------


def anchor_spans(buf: np.ndarray, off: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """(row, anchor hash, first window, windows) of each run of windows with one anchor; starts are flat."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, np.zeros(0, np.uint64), none, none
    at = np.arange(n - gram + 1)
    grams = _flat.span_hashes(_flat.BYTE_VALUES[buf], at, at + gram)
    key = (grams & ~_PLACE) | at.astype(np.uint64)
    w = width - gram + 1
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    part = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(part, 1).ravel()
    behind = np.minimum.accumulate(part[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(behind[: n - width + 1], ahead[w - 1 : w - 1 + n - width + 1])
    size = np.diff(off)
    rows = np.flatnonzero(size >= width)
    mark = np.zeros(n + 1, np.int64)
    mark[off[rows]] += 1
    mark[off[rows] + size[rows] - width + 1] -= 1
    ok = np.flatnonzero(np.cumsum(mark)[: n - width + 1] > 0)
    pick = (low[ok] & _PLACE).astype(np.int64)
    new = np.ones(len(ok), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (ok[1:] != ok[:-1] + 1)
    cut = np.flatnonzero(new)
    first = ok[cut]
    count = np.diff(np.append(cut, len(ok)))
    return np.searchsorted(off, first, "right") - 1, grams[pick[cut]], first, count


def _stretches(buf: np.ndarray, off: np.ndarray, width: int):
    """(first row, bytes, offsets, first byte) of runs of rows; a long row comes in stretches that share width - 1 bytes.

    A window's anchor depends on its own bytes, so it is the same wherever its stretch begins.
    """
    for i, j, b, o in _flat.blocks(buf, off):
        if j - i > 1 or len(b) <= WINDOWS + width:
            yield i, b, o, 0
        else:
            for k in range(0, len(b) - width + 1, WINDOWS):
                part = b[k : k + WINDOWS + width - 1]
                yield i, part, np.array([0, len(part)]), k


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Copies go here and not in a step of its own, which would be one more process beside this one.
        for batch in _once(batches):
            buf, off = _flat.buffer_of(batch.column(1))
            for i, b, o, begin in _stretches(buf, off, width):
                row, h, first, count = anchor_spans(b, o, width)
                data = b.tobytes()
                digest = [xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(first.tolist(), (first + count + width - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row)), pa.array(h.view(np.int64)), pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array((begin + first - o[row]).astype(np.int64)), pa.array(count.astype(np.int32))], names=["t", "h", "sh", "first", "n"])

    return run


#: Texts that a task remembers having passed on; it may pass on a text again, which changes no result.
REMEMBERED = 100_000


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key this task has not passed on lately."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for k, t in enumerate(batch.column(0).to_pylist()):
            if t not in seen:
                seen.add(t)
                keep.append(k)
        if len(seen) > REMEMBERED:
            seen.clear()
        yield batch.take(pa.array(keep, pa.int64()))


def _fetch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_py().encode() if text.is_valid else b""
                out += [(t, s["h"], s["sh"], s["first"], s["n"], s["alone"], data[s["first"] : s["first"] + s["n"] + width - 1]) for s in spans]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["t", "h", "sh", "first", "n", "alone", "span"])

    return run


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _in_shard(width: int):
    def run(group: pa.Table) -> pa.Table:
        rows = {(r["h"], r["sh"]): r for r in group.select(["t", "h", "sh", "first", "alone", "span"]).to_pylist()}
        out = []
        if len(rows) > 1:
            for r, again in zip(rows.values(), repeated_windows([r["span"] for r in rows.values()], width), strict=True):
                if r["alone"]:
                    a, n = _runs(again)
                    out += [(r["t"], r["first"] + int(x), int(y)) for x, y in zip(a, n, strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table({"t": pa.array(cols[0], pa.binary()), "first": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int32())})

    return run


def _by_window(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, h, first, alone, span in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                x = _flat.BYTE_VALUES[np.frombuffer(span, np.uint8)]
                at = np.arange(len(x) - width + 1)
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.binary()), pa.array(np.full(len(at), h)), pa.array(_flat.span_hashes(x, at, at + width).view(np.int64)), pa.array(first + at), pa.array(np.full(len(at), alone))], names=["t", "h", "w", "first", "alone"])

    return run


def repeats(docs: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(t, first, n): for each text (by text_key) runs of n windows, from byte `first` on, that repeat in the table."""
    every = docs.select(text_key(F.col(text_col)).alias("t"), F.col(text_col).cast("string").alias("text"))
    # Copies of a whole text are counted by key; from here on a text stands for all of them.
    size = F.octet_length("text")
    copied = every.where(size >= width).groupBy("t").agg(F.count("*").alias("c"), F.first(size).alias("size")).where("c > 1")
    copied = copied.select("t", F.lit(0).cast("long").alias("first"), (F.col("size") - width + 1).cast("int").alias("n"))
    texts = every.mapInArrow(_once, "t binary, text string")
    spans = materialize(every.mapInArrow(_scan(width), "t binary, h long, sh long, first long, n int"), "spans")
    # Partial minima and maxima bring each task's rows of a kind down to one before any are dealt out.
    here = F.struct("t", "first", "n")
    kinds = spans.groupBy("h", "sh").agg(F.min(here).alias("x"), F.max(here).alias("y")).select("h", "sh", "x", (F.col("x") == F.col("y")).alias("alone"))
    kinds = materialize(kinds, "span-kinds")
    twice = spans.join(kinds.where("NOT alone").select("h", "sh"), ["h", "sh"], "left_semi").select("t", "first", "n").distinct()
    # Anchors with spans that occur once, beside others.
    mixed = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.count_if("alone").alias("single")).where("kinds > 1 AND single > 0").select("h")
    wanted = materialize(kinds.join(mixed, "h", "left_semi").select("h", "sh", "x.*", "alone"), "wanted")
    lists = wanted.groupBy("t").agg(F.collect_list(F.struct("h", "sh", "first", "n", "alone")).alias("spans"))
    fetched = texts.join(lists, "t").select("t", "text", "spans").mapInArrow(_fetch(width), "t binary, h long, sh long, first long, n int, alone boolean, span binary")
    weight = wanted.groupBy("h").agg(F.sum(F.col("n") + width - 1).alias("bytes"))
    total = weight.agg(F.sum("bytes")).first()[0] or 0
    fetched = materialize(fetched.join(weight, "h"), "fetched")
    shards = max(1, -(-total // SHARD_BYTES))
    small = fetched.where(F.col("bytes") <= HOT_BYTES).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    found = small.groupBy("shard").applyInArrow(_in_shard(width), "t binary, first long, n int")
    hot = fetched.where(F.col("bytes") > HOT_BYTES)
    if hot.limit(1).count():
        windows = hot.select("t", "h", "first", "alone", "span").dropDuplicates(["t", "first"]).mapInArrow(_by_window(width), "t binary, h long, w long, first long, alone boolean")
        windows = materialize(windows, "windows")
        again = windows.groupBy("h", "w").agg(F.count("*").alias("c")).where("c > 1").select("h", "w")
        found = found.unionByName(windows.where("alone").join(again, ["h", "w"], "left_semi").select("t", "first", F.lit(1).alias("n")))
    return twice.unionByName(found).unionByName(copied)


def _cut(width: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, digests, spans = [], [], [], [], []
            for text, runs in zip(batch.column(at), batch.column(at + 1).to_pylist(), strict=True):
                data = text.as_py().encode() if text.is_valid else b""
                gone: list[list[int]] = []
                for first, n in sorted((r["first"], r["n"]) for r in runs or ()):
                    if gone and first <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], first + n + width - 1)
                    else:
                        gone.append([first, first + n + width - 1])
                digest, last = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(data[last:a])
                    last = b
                digest.update(data[last:])
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in gone))
                counts.append(len(gone))
                digests.append(digest.hexdigest())
                spans.append([{"start": a, "end": b} for a, b in gone])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kind)], names=[*batch.schema.names[:at], "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans are the maximal removed runs of bytes.

    Texts count as UTF-8 bytes, a null text as empty; matches never cross rows; what repeats is
    judged on the texts as they come. Equal rows repeat each other. Null and repeated ids are rows
    like others; an empty table gives no rows; other columns are ignored.
    """
    gone = repeats(docs, text_col, width).groupBy("t").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    keyed = docs.select(text_key(F.col(text_col)).alias("t"), F.col(text_col).cast("string").alias("text"))
    schema = "t binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    done = keyed.mapInArrow(_once, "t binary, text string").join(gone, "t", "left").select("t", "text", "runs").mapInArrow(_cut(width, 1), schema)
    # One result for each text goes to its documents: the texts of copies are not moved again.
    done = materialize(done.groupBy("t").agg(*[F.first(c).alias(c) for c in done.columns[1:]]), "results")
    return docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("t")).join(done, "t").drop("t")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents outside all repeated 400-byte strings; `removed` says whether any went, `spans` which."""
    r = removed_spans(table(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("removed"), "spans")
