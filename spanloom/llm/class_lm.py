"""Language-model scores by class n-grams: exchange clustering puts words into classes, and a text is scored by
class transitions times word emissions.

Every count is over all training tokens. Exchange takes the frequent words first, of which there are HOT at most: they start in
classes by hash, all other words in one class of their own, and for a number of rounds each frequent word moves to the class that
raises the likelihood of the class bigrams most, all at once against the classes of the round before. Then all the other words,
however many, move out of their common class in the same way, each by the classes of its own neighbours. Words, pairs and counts by class are
tables keyed by word; the driver holds the frequent words and class matrices, both of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import _flat
from spanloom.llm._base import look_up, materialize, scratch, table

#: A word with at least one in so many tokens is a frequent one, known to every task; there are no more than that many, and the end token.
HOT = 1 << 18
#: As HOT, for words whose counts and classes tasks know when they score texts.
KNOWN = 1 << 20
#: Key of the end token, whose word is empty as no other.
END = 0
#: Words whose moves are weighed at once.
ROWS = 2048
#: Distinct pairs that a task sums up before it hands them on.
PAIRS = 1 << 20


def _values(salt: int) -> np.ndarray:
    """Value of each byte in the hash of a word, capital letters as small ones."""
    values = _flat.BYTE_VALUES if not salt else np.random.default_rng(salt).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return values[_flat.LOWER]


def token_keys(buf: np.ndarray, off: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys of all tokens, row of each, start and end of each); every row closes with the end token, an empty span."""
    s, e, row = _flat.words(buf, off, _flat.NON_SPACE)
    rows = len(off) - 1
    at = np.arange(len(s)) + row
    keys, owner = np.zeros(len(s) + rows, np.int64), np.repeat(np.arange(rows), np.bincount(row, minlength=rows) + 1)
    start, end = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    keys[at], start[at], end[at] = _flat.signed(_flat.span_hashes(_values(salt)[buf], s, e) >> np.uint64(1)), s, e
    return keys, owner, start, end


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n): the distinct pairs of all parts (a, b, n) with their summed counts."""
    a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    h = _flat.mix(a.view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + b.view(np.uint64))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    if (a[first][which] != a).any() or (b[first][which] != b).any():  # two pairs of one hash
        pairs, which = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
        return pairs[0], pairs[1], np.bincount(which.ravel(), n).astype(np.int64)
    return a[first], b[first], np.bincount(which, n).astype(np.int64)


def _count_words(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = _flat.buffer_of(batch.column(0))
            for _, _, b, o in _flat.blocks(buf, off, 1 << 20):
                keys, _, s, e = token_keys(b, o, salt)
                k, first, n = np.unique(keys, return_index=True, return_counts=True)
                s, size = s[first], (e - s)[first]
                at = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(size.sum())
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(k), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(_flat.LOWER[b[at]])])
                yield pa.RecordBatch.from_arrays([pa.array(k), words.cast(pa.binary()), pa.array(n)], names=["key", "word", "n"])

    return run


def _flushed(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, n) with the counts of equal pairs summed up over some PAIRS pairs at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > PAIRS:
            held = [_summed(held)]
            size = len(held[0][0])
            if size > PAIRS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b", "n"])
                held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(held)], names=["a", "b", "n"])


def _neighbours(batches: Iterator[pa.RecordBatch], hot: np.ndarray, salt: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, ids, keys of the tokens before, ids of those) of all tokens, block by block; the id of a word that is not frequent is len(hot)."""
    for batch in batches:
        buf, off = _flat.buffer_of(batch.column(0))
        for _, _, b, o in _flat.blocks(buf, off, 1 << 20):
            key = token_keys(b, o, salt)[0]
            at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            ids = np.where(hot[at] == key, at, len(hot))
            # Before the first token of a row stands the end token of the row before, which is where every row begins.
            end = np.searchsorted(hot, END)
            yield key, ids, np.append(END, key[:-1]), np.append(end, ids[:-1])


def _count_pairs(hot: np.ndarray, salt: int):
    """Pairs by id (a and b, below zero: -1 - id) of which one word is frequent at least, and by key of two others: (a, b, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for key, ids, key0, ids0 in _neighbours(batches, hot, salt):
                rare = (ids == len(hot)) & (ids0 == len(hot))
                code, n = np.unique(ids0[~rare] * (len(hot) + 1) + ids[~rare], return_counts=True)
                yield -1 - code // (len(hot) + 1), -1 - code % (len(hot) + 1), n
                yield key0[rare], key[rare], np.ones(int(rare.sum()), np.int64)

        yield from _flushed(parts())

    return run


def _count_classes(hot: np.ndarray, cls: np.ndarray, classes: int, salt: int):
    """(a, b, n): how often each word a that is not frequent stands beside each class: codes b of `Profiles`."""
    wide = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for key, ids, key0, ids0 in _neighbours(batches, hot, salt):
                now, before = ids == len(hot), ids0 == len(hot)
                same = now & before & (key == key0)
                yield key[now], np.where(same, 2 * wide, cls[ids0])[now], np.ones(int(now.sum()), np.int64)
                other = before & ~same
                yield key0[other], wide + cls[ids][other], np.ones(int(other.sum()), np.int64)

        yield from _flushed(parts())

    return run


def _gain(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(g + n) log(g + n) - g log(g), without the difference of two large numbers."""
    return n * np.log(np.maximum(g + n, 1)) + g * np.log1p(n / np.maximum(g, 1))


@dataclass
class Profiles:
    """Words of a batch: counts by class of the tokens before (`before`) and after (`after`), pairs of a word with itself apart.

    Classes are 0 to k - 1, then that of the end token, then that of words that have not moved yet.
    """

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    same: np.ndarray

    @classmethod
    def of(cls, own: np.ndarray, row: np.ndarray, code: np.ndarray, n: np.ndarray, wide: int) -> Profiles:
        """From counts n of (row, code): codes are classes before, classes after, and the word itself."""
        counts = np.bincount(row * (2 * wide + 1) + code, n, len(own) * (2 * wide + 1)).astype(np.int64).reshape(len(own), -1)
        return cls(own, counts[:, :wide], counts[:, wide : 2 * wide], counts[:, -1])

    @property
    def n(self) -> np.ndarray:
        return self.before.sum(1) + self.same

    def part(self, some: np.ndarray | slice) -> Profiles:
        return Profiles(self.own[some], self.before[some], self.after[some], self.same[some])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first field, second field) of a column of lists of pairs."""
    a, b = (c.to_numpy(zero_copy_only=False) for c in column.flatten().flatten())
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), a, b


def exchanged(p: Profiles, g: np.ndarray) -> np.ndarray:
    """Class of each word of `p` after its best move, given the class pair counts `g`; all words are weighed against the same counts.

    The likelihood of class bigrams is the sum of x log x over the pair counts less twice that over the class counts. A word is
    taken out of its class and weighed in each; ties go to the smaller class, and what gains nothing stays, unless its class is to be left.
    """
    k, rows, total = len(g) - 2, len(p.own), p.n
    ii, a = np.arange(rows), p.own
    inner = a < k
    alone = g[a, a] - p.before[ii, a] - p.after[ii, a] - p.same  # pairs inside its class, without it
    gain = np.zeros((rows, k))
    for near, other, cells in ((p.after, p.before, g[:k].T), (p.before, p.after, g[:, :k])):
        r, c = np.nonzero(near)
        n = near[r, c]
        x = cells[c].copy()
        inside = c == a[r]
        x[inside] -= other[r[inside], :k]
        jj = np.flatnonzero(inner[r])
        home = a[r[jj]]
        x[jj, home] = np.where(inside[jj], alone[r[jj]], cells[c[jj], home] - n[jj])
        if len(r):
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            gain[r[first]] += np.add.reduceat(_gain(x, n[:, None]), first, axis=0)
    x = np.broadcast_to(np.diag(g)[:k], (rows, k)).copy()
    x[ii[inner], a[inner]] = alone[inner]
    s, q = p.after[:, :k], p.before[:, :k]
    gain += _gain(x + s, q + p.same[:, None]) - _gain(x, q)
    x = np.broadcast_to(g.sum(1)[:k], (rows, k)).copy()
    x[ii[inner], a[inner]] -= total[inner]
    gain -= 2 * _gain(x, total[:, None])
    best, stay = gain.argmax(1), gain[ii, np.minimum(a, k - 1)]
    return np.where(~inner | (gain[ii, best] > stay + 1e-9 * (1 + np.abs(stay))), best, a)


def likelihood(g: np.ndarray) -> float:
    """The part of the log likelihood of class bigrams that depends on the classes."""
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(g) - f(g.sum(0)) - f(g.sum(1))


def may_move(key: np.ndarray, drops: int) -> np.ndarray:
    """Words that may move once `drops` rounds have lowered the likelihood: half as many each time, chosen by hash."""
    return _flat.mix(key.view(np.uint64) + np.uint64(drops)) % np.uint64(2**drops) == 0


def _summed_matrix(rows: DataFrame, wide: int) -> np.ndarray:
    """The matrix of rows (at, n), at = row * wide + column: wide**2 numbers at most come to the driver."""
    g = np.zeros(wide * wide, np.int64)
    for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():
        g[r["at"]] = r.n
    return g.reshape(wide, wide)


def _matrix_rows(g: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(g)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(g.ravel()[at])], names=["at", "n"])


def _frequent_profiles(batch: pa.RecordBatch, cls: np.ndarray, wide: int) -> tuple[np.ndarray, Profiles]:
    """(ids, profiles) of rows (id, x); `cls` has the class of each id and, last, that of words without one."""
    ids = batch.column("id").to_numpy()
    row, near, n = _lists(batch.column("x"))
    after = near >= len(cls)
    word = near - len(cls) * after
    same = word == ids[row]
    n = np.where(same & after, 0, n)  # a word beside itself is in both lists
    return ids, Profiles.of(cls[ids], row, np.where(same, 2 * wide, cls[word] + wide * after), n, wide)


class _Frequent:
    """Exchange among the frequent words: `near` has one row for each (id, x), x the words beside it as (id before, or count + id after; n)."""

    def __init__(self, pairs: DataFrame, keys: np.ndarray, classes: int) -> None:
        self.keys, self.m, self.k = keys, len(keys) + 1, classes
        ids = pairs.where("a < 0").select((-1 - F.col("a")).cast("int").alias("v"), (-1 - F.col("b")).cast("int").alias("w"), "n")
        both = ids.select(F.col("w").alias("id"), F.col("v").alias("near"), "n").unionByName(ids.select(F.col("v").alias("id"), (F.col("w") + self.m).alias("near"), "n"))
        lists = both.where(F.col("id") < len(keys)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("near", "n"))).alias("x"))
        self.near = materialize(lists, "near")

    def matrix(self, cls: np.ndarray) -> np.ndarray:
        """Class pair counts of all pairs with a frequent word."""
        wide = self.k + 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros((wide, wide), np.int64)
            for b in batches:
                _, p = _frequent_profiles(b, cls, wide)
                np.add.at(g.T, p.own, p.before)
                np.add.at(g, (p.own, p.own), p.same)
                # Pairs whose second word is not frequent are seen from the first one only.
                np.add.at(g[:, -1], p.own, p.after[:, -1])
            yield _matrix_rows(g)

        return _summed_matrix(self.near.mapInArrow(run, "at long, n long"), wide)

    def moved(self, cls: np.ndarray, g: np.ndarray, drops: int) -> np.ndarray:
        """Classes after a round; no more than HOT rows come to the driver."""
        k, keys = self.k, self.keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, ROWS):
                    ids, p = _frequent_profiles(b.slice(i, ROWS), cls, k + 2)
                    some = np.flatnonzero((p.own < k) & may_move(keys[ids], drops))
                    new = p.own.copy()
                    new[some] = exchanged(p.part(some), g)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(new.astype(np.int32))], names=["id", "cls"])

        out = cls.copy()
        t = self.near.mapInArrow(run, "id int, cls int").toArrow()
        out[t.column("id").to_numpy()] = t.column("cls").to_numpy()
        return out


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of batches that come sorted by the first one, cut where a value of it ends."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if cut or (held and held[-1][0][-1] != cols[0][0]):
            done = [*held, tuple(c[:cut] for c in cols)]
            yield tuple(np.concatenate(x) for x in zip(*done, strict=True))
            held = []
        held.append(tuple(c[cut:] for c in cols))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _others(text: DataFrame, pairs: DataFrame, keys: np.ndarray, cls: np.ndarray, g: np.ndarray, salt: int) -> tuple[DataFrame, np.ndarray]:
    """((key, n, cls) of the words that are not frequent, class pair counts of all pairs that have one).

    Each moves out of the common class by the classes beside it, as `g` counts them.
    """
    wide = len(g)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((wide, wide), np.int64)
        for key, b, n in _whole_runs(batches):
            new = np.append(True, key[1:] != key[:-1])
            row = np.cumsum(new) - 1
            first = np.append(np.flatnonzero(new), len(key))
            for i in range(0, len(first) - 1, ROWS):
                x, y = first[i], first[min(i + ROWS, len(first) - 1)]
                p = Profiles.of(np.full(min(ROWS, len(first) - 1 - i), wide - 1), row[x:y] - i, b[x:y], n[x:y], wide)
                cls = exchanged(p, g)
                # Neighbours that are not frequent either come with their own classes, below.
                np.add.at(pairs.T, cls, np.append(p.before[:, :-1], np.zeros((len(cls), 1), np.int64), axis=1))
                np.add.at(pairs, cls, np.append(p.after[:, :-1], np.zeros((len(cls), 1), np.int64), axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(key[first[i : i + len(cls)]]), pa.array(p.n), pa.array(cls.astype(np.int32))], names=["key", "n", "cls"])
        # What a task has seen of class pairs goes along, at keys below zero.
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - at), pa.array(pairs.ravel()[at]), pa.array(np.zeros(len(at), np.int32))], names=["key", "n", "cls"])

    # No word here has more than one in HOT tokens, so none is hot where words are dealt out, here and in the joins.
    beside = text.mapInArrow(_count_classes(keys, cls, wide - 2, salt), "a long, b long, n long").repartition("a").sortWithinPartitions("a")
    found = materialize(beside.mapInArrow(moved, "key long, n long, cls int"), "others", keep=True)
    out = _summed_matrix(found.where("key < 0").select((-1 - F.col("key")).alias("at"), "n"), wide)
    found = found.where("key >= 0")
    side = lambda c: found.select(F.col("key").alias(c), F.col("cls").alias(f"{c}_cls"))
    both = pairs.where("a >= 0").join(side("a"), "a").groupBy("a_cls", "b").agg(F.sum("n").alias("n")).join(side("b"), "b")
    out += _summed_matrix(both.select((F.col("a_cls").cast("long") * wide + F.col("b_cls")).alias("at"), "n"), wide)
    return found, out


@dataclass
class Model:
    """Words (key, word, n); keys, counts and classes of the frequent ones, and of all others as a table; totals and class pair counts."""

    words: DataFrame
    keys: np.ndarray
    counts: np.ndarray
    cls: np.ndarray
    others: DataFrame
    tokens: int
    types: int
    singles: int
    pairs: np.ndarray
    salt: int
    mix: float

    @property
    def classes(self) -> DataFrame:
        """(key, n, cls) of all words."""
        few = pa.table({"key": self.keys, "n": self.counts, "cls": self.cls.astype(np.int32)})
        return self.others.sparkSession.createDataFrame(few).unionByName(self.others)

    def steps(self) -> np.ndarray:
        """log10 of what a word's count is multiplied by, for each class before it and its own; the last class is that of unseen words.

        P(w | v) = (1 - u) (m T(c_w | c_v) n_w / n_c + (1 - m) n_w / n) for seen words, with half a count added to each transition to a class that has words, and
        u = (words seen once + 1) / (n + 2) for all unseen ones together, so the probabilities add up to one after any word.
        """
        wide = len(self.pairs)
        out = np.zeros((wide + 1, wide + 1))
        if self.tokens:
            unseen = (self.singles + 1) / (self.tokens + 2)
            size = self.pairs.sum(1)
            used = size > 0
            t = (self.pairs + 0.5 * used) / (size[:, None] + 0.5 * used.sum())
            out[:wide, :wide] = np.log10((1 - unseen) * (self.mix * t / np.maximum(size, 1) + (1 - self.mix) / self.tokens))
            out[wide, :wide] = np.log10((1 - unseen) / self.tokens)
            out[:, wide] = np.log10(unseen)
        return out


def train(texts: DataFrame, text_col: str, classes: int = 32, rounds: int = 4, mix: float = 0.9) -> Model:
    """A class bigram model of all rows of `texts`.

    Null and empty texts hold only the end token; repeated rows count each time; no rows give a model that has seen nothing. Words
    are runs of non-blank characters with A-Z lower-cased, the end token has a class of its own. Frequent words start in classes
    by hash and go through `rounds` rounds of exchange, then all others move once. As all words of a round move at once they may move in step and lose likelihood: such a
    round is undone, and from then on half as many words may move. Words are told apart by 63-bit hashes, which are checked: should two words share
    one, all is counted again with another hash.
    """
    text = texts.select(F.col(f"`{text_col}`").alias("text"))
    with scratch(text.sparkSession):
        for salt in range(8):
            counted = text.mapInArrow(_count_words(salt), "key long, word binary, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))
            words = materialize(counted, "words", keep=True)
            tokens, types, keys, singles = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_distinct("key"), F.count_if(F.col("n") == 1)).first()
            if types == keys:
                break
        if not tokens:
            none = words.select("key", "n", F.lit(0).alias("cls"))
            return Model(words, *[np.zeros(0, np.int64)] * 3, none, 0, 0, 0, np.zeros((classes + 1, classes + 1), np.int64), salt, mix)
        few = words.where((F.col("n") * HOT >= tokens) | (F.col("key") == END)).select("key", "n").orderBy("key").toArrow()
        keys, counts = few.column("key").to_numpy(), few.column("n").to_numpy()
        counted = text.mapInArrow(_count_pairs(keys, salt), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        pairs = materialize(counted, "pairs")
        # Ids are places in `keys`; the last class is that of all words without one.
        cls = np.append(np.where(keys == END, classes, keys % classes), classes + 1)
        frequent = _Frequent(pairs, keys, classes)
        best, kept, g, drops = -np.inf, cls, None, 0
        for left in range(rounds, -1, -1):
            now = frequent.matrix(cls)
            if likelihood(now) > best:
                best, kept, g = likelihood(now), cls, now
            else:
                drops += 1
            if left:
                cls = frequent.moved(kept, g, drops)
        if types == len(keys):
            others, more = words.where("false").select("key", "n", F.lit(0).alias("cls")), np.zeros_like(g)
        else:
            rest = g.copy()
            rest[-1, -1] = tokens - g.sum()  # what no frequent word has seen are pairs of two others
            others, more = _others(text, pairs, keys, kept, rest, salt)
    g = g[:-1, :-1] + more[:-1, :-1]
    return Model(words, keys, counts, kept[:-1], others, tokens, types, singles, g, salt, mix)


def score(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_tokens, n_known, base, score): log10 probabilities of every row's whole text, end token included.

    Tasks know the most frequent words; all others are looked up in the table of words, each with the classes beside it. Null and
    empty texts are the end token alone; repeated and null ids are rows like any; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    wide, steps = len(model.pairs), model.steps()
    # More words than exchange goes through by itself, but so many at most.
    more = model.others.where(F.col("n") * KNOWN >= model.tokens).select("key", "n", "cls").toArrow()
    keys, counts, cls = (np.concatenate([x, more.column(c).to_numpy()]) for x, c in ((model.keys, "key"), (model.counts, "n"), (model.cls, "cls")))
    order = np.argsort(keys)
    keys, counts, cls = keys[order], counts[order], cls[order].astype(np.int16)

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, emit = model_base(counts), np.log10(np.maximum(counts, 1))
        for batch in batches:
            buf, off = _flat.buffer_of(batch.column("text"))
            for i, j, b, o in _flat.blocks(buf, off, 1 << 20):
                key, row, _, _ = token_keys(b, o, salt)
                at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                own = np.where(hit, cls[at] if len(keys) else 0, -1)
                last = np.append(row[1:] != row[:-1], True)
                first = np.append(True, last[:-1])
                before = np.where(first, wide - 1, np.append(-1, own[:-1]))
                after = np.where(last, -1, np.append(own[1:], -1))
                sums = lambda x, row=row, rows=j - i: np.bincount(row, x, rows)
                worth = np.zeros(len(key))
                worth[hit] = emit[at[hit]]
                both = hit & (before >= 0)
                worth[both] += steps[before[both], own[both]]
                known = np.zeros(len(key))
                known[hit] = base[at[hit]]
                rare = np.flatnonzero(~hit)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(row[rare], minlength=j - i))).astype(np.int32))
                others = [pa.ListArray.from_arrays(ends, pa.array(x[rare].astype(t))) for x, t in ((key, np.int64), (before, np.int16), (after, np.int16))]
                cols = [batch.column("row").slice(i, j - i), batch.column("id").slice(i, j - i), pa.array(np.bincount(row, minlength=j - i)), pa.array(sums(hit).astype(np.int64)), pa.array(sums(known)), pa.array(sums(worth)), *others]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "n_tokens", "n_known", "base", "score", "keys", "before", "after"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, k, before, after, n, own in _whole_runs(batches):
            order = np.lexsort((k, row))
            row, before, after, n, own = (x[order] for x in (row, before, after, n, own))
            before = np.where(before >= 0, before, np.append(0, own[:-1]))
            worth = steps[before, own] + np.log10(np.maximum(n, 1)) + np.where(after >= 0, steps[own, after], 0)
            r, which = np.unique(row, return_inverse=True)
            cols = [r, np.bincount(which, n > 0).astype(np.int64), np.bincount(which, model_base(n)), np.bincount(which, worth)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "n_known", "base", "score"])

    # Functions that go to tasks must not hold the model's table.
    salt, tokens, types = model.salt, model.tokens, model.types
    model_base = lambda n: np.log10((n + 0.5) / (tokens + 0.5 * (types + 1)))

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = f"row long, id {kind}, n_tokens long, n_known long, base double, score double"
    part = materialize(given.mapInArrow(partly, f"{out}, keys array<long>, before array<short>, after array<short>"), "scores")
    whole = part.drop("keys", "before", "after")
    rare = part.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    if not rare:
        return whole
    spread = part.select("row", F.posexplode(F.arrays_zip("keys", "before", "after")).alias("k", "x")).select("row", "k", F.col("x.keys").alias("key"), "x.before", "x.after")
    # A word that no training text holds may still be frequent here, so it is the asked words that are told apart.
    asked = spread.groupBy("key").agg(F.count("*").alias("asked"))
    found = materialize(asked.join(model.others.where(F.col("n") * KNOWN < model.tokens), "key", "left"), "asked")
    met = look_up(spread, found, ["key"], F.col("asked") * HOT >= rare)
    met = met.select("row", "k", "before", "after", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cls", F.lit(wide)).alias("cls"))
    # A document's rows meet in one batch, which puts them in order: sorting by one number is cheap, by two is not.
    sums = met.repartition("row").sortWithinPartitions("row").mapInArrow(settled, "row long, n_known long, base double, score double")
    every = whole.unionByName(sums, allowMissingColumns=True).groupBy("row")
    return every.agg(F.first("id", ignorenulls=True).alias("id"), F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("n_known", "base", "score")])


def held_out(id_col: str) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out; nulls, ties and empty tables as in `train` and `score`."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id")), "text")
    rows = score(docs, model, "doc_id", "text")
    return rows.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
