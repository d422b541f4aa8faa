"""Substring dedup: paragraph MinHash banding, exact Jaccard verification, removal by components.

A paragraph is a line of at least MIN_WORDS words. Lines are banded by MinHash over five-word
shingles; lines that collide in a band are compared by the exact Jaccard similarity of their
shingle sets; links of at least SIMILARITY give components. A passage that is copied into the
middle of a line has no line of its own. For these, the sentences of a line that has several are
units too, and so are stretches of a line between borders that its words alone fix; both match
when their words are equal. Of each component the first unit stays.

First only hashes are dealt out: a band key and a line, or a unit. What is met more than once
picks the units whose places are looked up, and the lines whose shingles are made at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import _flat
from spanloom.llm._base import materialize, table
from spanloom.llm._components import components

MIN_WORDS = 10
SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 collides in one band at least with probability 1 - (1 - 0.8**3)**8 = 0.997.
BANDS, ROWS = 8, 3
#: A border is a word whose two-word hash is the smallest of REACH words before and after; a stretch takes two steps
#: from border to border and STRETCH words at least. A copied run of 51 words holds one with probability 0.98, of 60 with 1.00 (simulated).
REACH, STRETCH = 4, 14
#: Members and bytes of a bucket that are compared in one piece; larger buckets are linked piece by piece first.
PIECE, PIECE_BYTES = 4096, 4 << 20

_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SENTENCE_END = _flat._class(lambda b: chr(b) in ".!?")


def minhash_bands(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Band keys (sets x BANDS) of non-empty runs of shingle hashes that begin at `first`."""
    out = np.zeros((len(first), BANDS), np.uint64)
    for k, m in enumerate(_MULTIPLIERS):
        low = np.minimum.reduceat(_flat.mix(shingles * m), first) if len(first) else out[:, 0]
        out[:, k // ROWS] = out[:, k // ROWS] * np.uint64(0x9FB21C651E98DF25) + low
    return _flat.mix(out + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _borders(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Words whose two-word hash is the smallest within REACH words of their line, the leftmost of equal ones."""
    n = len(h)
    g = _flat.mix(h * np.uint64(0x9FB21C651E98DF25) + np.append(h[1:], np.uint64(0)))
    low = np.ones(n, bool)
    low[:-1] &= line[:-1] == line[1:]  # a line's last word has no pair
    if n:
        low[-1] = False
    for k in range(1, min(REACH, n - 1) + 1):
        same = line[k:] == line[:-k]
        low[k:] &= ~same | (g[k:] < g[:-k])
        low[:-k] &= ~same | (g[:-k] <= g[k:])
    return np.flatnonzero(low)


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return first, np.append(first[1:], len(group))


class _Units:
    """Units of a block of rows: words [first, end) each, lines before other units; u and v identify their words."""

    def __init__(self, b: np.ndarray, o: np.ndarray) -> None:
        self.b, self.o = b, o
        s, e, self.row = _flat.words(b, o, _flat.ALNUM)
        self.s, self.e = s, e
        self.h = h = _flat.span_hashes(_flat.BYTE_VALUES[_flat.LOWER[b]], s, e)
        # A line ends after a line feed or where its row ends; a sentence also after its mark and a blank.
        self.feed = b == 10
        mark = np.zeros(len(b), bool)
        mark[1:] = _SENTENCE_END[b[:-1]] & (b[1:] == 32)
        head = np.zeros(len(b) + 1, np.int64)
        head[o[:-1]] = 1
        self.line = line = np.cumsum(head[:-1] + np.concatenate([[0], self.feed[:-1]]))[s]
        part = np.cumsum(head[:-1] + np.concatenate([[0], (self.feed | mark)[:-1]]))[s]
        if not len(s):
            self.first = self.end = self.u = np.zeros(0, np.int64)
            self.lines = 0
            return
        lf, le = _runs(line)
        pf, pe = _runs(part)
        several = line[pf] == np.concatenate([[-1], line[pf][:-1]])
        several |= np.concatenate([several[1:], [False]])
        keep = (pe - pf >= MIN_WORDS) & several
        pf, pe = pf[keep], pe[keep]
        keep = le - lf >= MIN_WORDS
        lf, le = lf[keep], le[keep]
        at = _borders(h, line)
        cf, ce = at[:-2], at[2:]
        keep = (line[cf] == line[ce]) & (ce - cf >= STRETCH)
        self.lines = len(lf)
        self.first, self.end = np.concatenate([lf, pf, cf[keep]]), np.concatenate([le, pe, ce[keep]])
        self.u = _flat.span_hashes(h, self.first, self.end).view(np.int64)

    def second(self) -> np.ndarray:
        return _flat.span_hashes(_flat.mix(self.h + np.uint64(1)), self.first, self.end).view(np.int64)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes of all lines one after another, where each begins)."""
        at, g = _flat.ngrams(self.h, self.line, SHINGLE)
        a, z = np.searchsorted(at, self.first[: self.lines]), np.searchsorted(at, self.end[: self.lines] - SHINGLE, "right")
        size = z - a
        to = np.cumsum(size) - size
        return g[np.repeat(a - to, size) + np.arange(size.sum())], to

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, end byte) in its row: to the next word of the line, or to the end of the line without its line feed."""
        s, first, end = self.s, self.first, self.end
        row = self.row[first]
        tail = np.where(end < len(s), s[np.minimum(end, len(s) - 1)], len(self.b))
        tail = np.minimum(tail, self.o[row + 1])
        feed = np.append(np.flatnonzero(self.feed), len(self.b))
        stop = self.e[end - 1]
        stop = np.minimum(tail, np.maximum(stop, feed[np.searchsorted(feed, stop)]))
        return s[first] - self.o[row], stop - self.o[row]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, _Units]]:
    buf, off = _flat.buffer_of(batch.column(batch.num_columns - 1))
    for i, _, b, o in _flat.blocks(buf, off):
        units = _Units(b, o)
        if len(units.first):
            yield i, units


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, u): the bands of each line, and each unit under its own u; repeats within a block are cut to two."""
    for batch in batches:
        for _, x in _blocks(batch):
            u, again = np.unique(x.u, return_counts=True)
            shingles, to = x.shingles()
            lines, one = np.unique(x.u[: x.lines], return_index=True)
            bands = minhash_bands(shingles, to)[one].view(np.int64)
            twice = u[again > 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([bands.ravel(), u, twice])), pa.array(np.concatenate([np.repeat(lines, BANDS), u, twice]))], names=["key", "u"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, u) sorted by both: (u, u) of units that occur twice, (key, u) of lines that share a band."""
    held: list[np.ndarray] = []

    def found(key: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
        own = key == u
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (u[1:] != u[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(key)))
        k, v, own = key[first], u[first], own[first]
        line = np.flatnonzero(~own)
        shared = np.zeros(len(line), bool)
        same = k[line][1:] == k[line][:-1]
        shared[1:] |= same
        shared[:-1] |= same
        keep = np.concatenate([np.flatnonzero(own & (times > 1)), line[shared]])
        return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(v[keep])], names=["key", "u"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if held:
            cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
        # A key that may go on waits; of its rows no more than two alike are kept.
        stop = int(np.searchsorted(cols[0], cols[0][-1], "left")) if (cols[0][1:] >= cols[0][:-1]).all() else 0
        if stop:
            yield found(cols[0][:stop], cols[1][:stop])
        key, u = cols[0][stop:], cols[1][stop:]
        third = np.zeros(len(key), bool)
        third[2:] = (key[2:] == key[:-2]) & (u[2:] == u[:-2])
        held = [key[~third], u[~third]]
    if held:
        yield found(*held)


def _places(schema: str):
    """Rows (id, t, u, v, first, end, words) of all units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in _blocks(batch):
                owner = pa.array(i + x.row[x.first])
                first, end = x.places()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(owner), batch.column(1).take(owner), pa.array(x.u), pa.array(x.second()), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array((x.end - x.first).astype(np.int32)),
                ], names=["id", "t", "u", "v", "first", "end", "words"])

    return run, f"{schema}, u long, v long, first int, end int, words int"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, shingles) of the lines (u, first, end) of rows (text, lines)."""
    for batch in batches:
        lines = batch.column(1)
        off = lines.offsets.to_numpy()
        values = lines.values
        first, end = values.field("first").to_numpy(), values.field("end").to_numpy()
        parts = []
        for k, text in enumerate(batch.column(0)):
            data = text.as_py().encode()
            parts += [data[first[j] : end[j]] for j in range(off[k], off[k + 1])]
        for i, x in _blocks(pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["text"])):
            shingles, to = x.shingles()
            raw = shingles.tobytes()
            ends = np.append(to[1:], len(shingles))
            yield pa.RecordBatch.from_arrays([pa.array(x.u[: x.lines]), pa.array(x.second()[: x.lines]), pa.array([raw[8 * a : 8 * z] for a, z in zip(to.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["u", "v", "shingles"])


def connect(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Spanning links (indices) of the graph of sets at least `similarity` alike, breadth first.

    Each reached set is compared, exactly, with all that no one has reached yet.
    """
    size, off, flat, names = _joint(sets)
    left = np.arange(len(sets))
    inside = np.zeros(names, np.int64)
    links = []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = _near(x, left, size, off, flat, inside, similarity)
            links += [(int(x), int(y)) for y in left[near]]
            frontier += list(left[near])
            left = left[~near]
    return links


def _joint(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    sets = [np.unique(x) for x in sets]
    size = np.array([len(x) for x in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    return size, np.cumsum(size) - size, flat, len(names)


def _near(x: int, others: np.ndarray, size, off, flat, inside, similarity: float) -> np.ndarray:
    """Which of `others` are at least `similarity` alike to set x."""
    ids = flat[off[x] : off[x] + size[x]]
    inside[ids] = 1
    n = size[others]
    to = np.cumsum(n) - n
    common = np.add.reduceat(inside[flat[np.repeat(off[others] - to, n) + np.arange(n.sum())]], to)
    inside[ids] = 0
    return common >= similarity * (size[x] + n - common) - 1e-9


def across(sets: list[np.ndarray], label: list, rest: list[bool], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links from each set with rest to sets of another label, one for each label it meets."""
    size, off, flat, names = _joint(sets)
    _, label = np.unique(np.array(label), return_inverse=True)
    inside = np.zeros(names, np.int64)
    links = []
    for x in np.flatnonzero(rest):
        others = np.flatnonzero(label != label[x])
        if len(others):
            near = others[_near(x, others, size, off, flat, inside, similarity)]
            links += [(int(x), int(y)) for y in near[np.unique(label[near], return_index=True)[1]]]
    return links


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Rows with equal first `width` columns, of batches that come sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [c.to_numpy() for c in batch.columns[:width]]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        if held and all(h[0].as_py() == k[0] for h, k in zip(held[-1].columns[:width], keys, strict=True)):
            new[0] = False
        first = np.flatnonzero(new).tolist()
        for i, j in zip([0, *first], [*first, batch.num_rows], strict=True):
            if i in first and held:
                yield pa.Table.from_batches(held)
                held = []
            if j > i:
                held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _pairs_of(width: int, mixed: bool = False):
    """Links (a, b) of names w in each group of rows (keys..., w, shingles[, label, rest])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in _groups(batches, width):
            if g.num_rows < 2:
                continue
            w = g.column(width).to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in g.column(width + 1).to_pylist()]
            links = across(sets, g.column(width + 2).to_pylist(), g.column(width + 3).to_pylist()) if mixed else connect(sets)
            a += [w[x] for x, _ in links]
            b += [w[y] for _, y in links]
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _sorted(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by)


def _line_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between lines at least SIMILARITY alike that share a band, enough to span their components.

    A bucket of up to PIECE lines and PIECE_BYTES of shingles is linked in one piece. A larger one
    is linked in pieces by hash, and what these links leave outside the bucket's largest component
    is then compared with all of the bucket: no link is lost, and a group of near copies costs two
    passes over its lines, not its square.
    """
    sized = sets.select("u", F.octet_length("shingles").alias("bytes"))
    weight = members.join(sized, "u").groupBy("key").agg(F.greatest(F.ceil(F.count("*") / PIECE), F.ceil(F.sum("bytes") / PIECE_BYTES)).cast("int").alias("pieces"))
    large = materialize(weight.where("pieces > 1"), "large")
    named = sets.select("u", "w", "shingles")
    small = members.join(large, "key", "left_anti").join(named, "u")
    found = _sorted(small.select("key", "w", "shingles"), "key").mapInArrow(_pairs_of(1), "a binary, b binary")
    if large.isEmpty():
        return found
    own = F.pmod(F.xxhash64("w", "key"), F.col("pieces")).cast("int")
    hot = materialize(members.join(large, "key").join(named, "u").select("key", own.alias("p"), "pieces", "w", "shingles"), "hot")
    within = _sorted(hot.select("key", "p", "w", "shingles"), "key", "p").mapInArrow(_pairs_of(2), "a binary, b binary")
    found = materialize(found.unionByName(within), "some-links")
    root = components(found, "a", "b").select(F.col("node").alias("w"), "root")
    hot = materialize(hot.join(root, "w", "left").select("key", "p", "pieces", "w", "shingles", F.coalesce("root", "w").alias("label")), "labelled")
    most = hot.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = hot.join(most, "key").where("label <> main").drop("main")
    count = rest.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / PIECE), F.ceil(F.sum(F.octet_length("shingles")) / PIECE_BYTES)).cast("int").alias("q"))
    if count.isEmpty():
        return found
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rest.join(count, "key").select("key", each("pieces").alias("p"), F.pmod(F.xxhash64("key", "w"), F.col("q")).cast("int").alias("r"), "w", "shingles", "label", F.lit(True).alias("rest"))
    other = hot.join(count, "key").select("key", "p", each("q").alias("r"), "w", "shingles", "label", F.lit(False).alias("rest"))
    met = _sorted(one.unionByName(other), "key", "p", "r").select("key", "p", "r", "w", "shingles", "label", "rest")
    return found.unionByName(met.mapInArrow(_pairs_of(3, True), "a binary, b binary"))


def _name(u: str = "u", v: str = "v"):
    return F.concat(*[F.unhex(F.lpad(F.hex(x), 16, "0")) for x in (u, v)])


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, first, end, words, cluster, removed): every unit of a cluster of two or more units.

    t is a hash of the text; first and end are bytes of its UTF-8 form. A cluster keeps its unit in
    the smallest id (nulls last), of several there the one with the smallest t and first byte; all
    others have removed = true. A null text is empty and has no units; rows equal in id and text are
    one document and share their units' fate; empty tables give no rows; other columns are ignored.
    """
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, t long"
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))
    keys = texts.select("text").mapInArrow(_keys, "key long, u long")
    met = materialize(keys.repartition("key").sortWithinPartitions("key", "u").mapInArrow(_met, "key long, u long"), "met")
    run, schema = _places(kind)
    places = texts.mapInArrow(run, schema).hint("merge").join(met.select("u").distinct(), "u", "left_semi")
    places = materialize(places, "places")
    members = met.where("key <> u")
    # One place of each line that shares a band shows its words.
    shown = places.groupBy("u").agg(F.min(F.struct("id", "t", "first", "end")).alias("x")).join(members.select("u").distinct(), "u", "left_semi")
    lists = shown.groupBy("x.id", "x.t").agg(F.collect_list(F.struct("x.first", "x.end")).alias("lines"))
    same = lambda a, b: a["t"].eqNullSafe(b["t"]) & a["id"].eqNullSafe(b["id"])
    once = texts.hint("merge").join(lists, same(texts, lists)).select("text", "lines")
    sets = once.mapInArrow(_sets, "u long, v long, shingles binary").groupBy("u", "v").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets.select("u", _name().alias("w"), "shingles"), "sets")
    root = components(materialize(_line_links(members, sets), "links"), "a", "b").select(F.col("node").alias("w"), "root")
    per = places.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("id").alias("low")).select("u", "v", _name().alias("w"), "n", "low")
    per = per.join(root, "w", "left").select("u", "v", "n", "low", F.coalesce("root", "w").alias("cluster"))
    per = materialize(per, "clustered")
    whole = per.groupBy("cluster").agg(F.sum("n").alias("n"), F.min("low").alias("low")).where("n > 1").select("cluster", "low")
    named = materialize(per.select("u", "v", "cluster").join(whole, "cluster"), "named")
    found = places.join(named, ["u", "v"]).select("id", "t", "first", "end", "words", "cluster", "low")
    # The unit that stays is found by partial minima, so that no cluster is gathered in one place.
    kept = found.where(F.col("id").eqNullSafe(F.col("low"))).groupBy("cluster").agg(F.min(F.struct("t", "first")).alias("here"))
    kept = materialize(kept, "stays")  # a join of two plain shuffles, whose hot clusters can be split
    found = found.join(kept.withColumnRenamed("cluster", "c"), F.col("cluster") == F.col("c"))
    stays = F.col("id").eqNullSafe(F.col("low")) & (F.struct("t", "first") == F.col("here"))
    return found.select("id", "t", F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("end"), "words", "cluster", (~stays).alias("removed"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated passages of documents, and which of them go."""
    r = repeated_units(table(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), F.col("first").alias("start_byte"), F.col("end").alias("end_byte"), F.col("words").alias("n_words"), F.lower(F.hex("cluster")).alias("cluster_id"), "removed")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the removed units in their texts: all rows and columns stay, whatever their names.

    n_chars, where there is one, follows the text. Null texts stay null, empty ones empty; a table
    without repeats comes back as it is, an empty one empty.
    """
    gone = repeated_units(docs, id_col, text_col).where("removed").groupBy("id", "t").agg(F.collect_list(F.struct("first", "end")).alias("gone"))
    names = docs.columns
    at = names.index(text_col)
    chars = names.index("n_chars") if "n_chars" in names else None
    # The row travels as one column, so that no name of its own meets one of ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"))
    joined = rows.alias("r").join(gone.alias("g"), F.expr("r.t <=> g.t AND r.id <=> g.id"), "left").select("r.row", "g.gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts, size = columns[at].to_pylist(), None
            for k, spans in enumerate(batch.column(1).to_pylist()):
                if spans:
                    data, parts, last = texts[k].encode(), [], 0
                    for x in sorted(spans, key=lambda g: (g["first"], g["end"])):
                        if x["first"] > last:
                            parts.append(data[last : x["first"]])
                        last = max(last, x["end"])
                    texts[k] = b"".join([*parts, data[last:]]).decode()
            columns[at] = pa.array(texts, pa.string())
            if chars is not None:
                size = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                columns[chars] = size.cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
