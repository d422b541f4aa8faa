"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Seeds are the five-word n-grams of the test items. A passage of a text around shared seeds is a
candidate for each item it shares a seed with, however many texts hold that seed, so what a text
copies depends on the text and the items alone. Candidates are aligned word by word; the score is
the best local alignment's over that of a whole copy.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import _flat
from spanloom.llm._base import table

N = 5
MIN_SCORE = 0.5
#: Seeds that go to the executors at once, with the items that own each: some 150 bytes a seed; larger benchmarks take several passes.
SEEDS_AT_ONCE = 1_000_000
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5


def word_hashes(column: pa.Array):
    """Per block of rows: (first row, word hash, row in block) of lower-cased words."""
    buf, off = _flat.buffer_of(column)
    for i, _, b, o in _flat.blocks(buf, off):
        s, e, row = _flat.words(b, o, _flat.ALNUM)
        yield i, _flat.span_hashes(_flat.BYTE_VALUES[_flat.LOWER[b]], s, e), row


@dataclass
class Items:
    """Test items as word hashes, and their seeds: sorted hashes with the lengths in words that occur."""

    ids: list
    words: list[np.ndarray]
    seed: np.ndarray = field(default=None)
    reach: np.ndarray = field(default=None)
    lengths: list[int] = field(default_factory=list)
    owners: dict[int, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        owners, reach = defaultdict(list), Counter()
        for k, w in enumerate(self.words):
            n = min(N, len(w))
            if not n:
                continue
            self.lengths = sorted({*self.lengths, n})
            for h in set(_flat.ngrams(w, np.zeros(len(w), np.int64), n)[1].tolist()):
                owners[h].append(k)
                reach[h] = max(reach[h], len(w) + len(w) // 4 + N)
        self.owners = dict(owners)
        self.seed = np.array(sorted(owners), np.uint64)
        self.reach = np.array([reach[h] for h in self.seed.tolist()], np.int64)


def load_items(rows: Iterator, at_once: int = SEEDS_AT_ONCE) -> Iterator[Items]:
    """Items in runs of at most about `at_once` seeds."""
    ids, held, seeds = [], [], 0
    for r in rows:
        words = [h for _, h, _ in word_hashes(pa.array([r[1]], pa.string()))]
        ids.append(r[0])
        held.append(np.concatenate(words) if words else np.zeros(0, np.uint64))
        seeds += len(held[-1])
        if seeds >= at_once:
            yield Items(ids, held)
            ids, held, seeds = [], [], 0
    if ids:
        yield Items(ids, held)


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """(score, first word, last word) of the best local alignment of `item` in `text`, score over that of a whole copy."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
        slope = -GAP * np.arange(len(b) + 1)
        above, top, end = np.zeros(len(b) + 1), 0.0, 0
        for x in a:
            row = np.maximum(above + GAP, 0)
            np.maximum(row[1:], above[:-1] + np.where(b == x, MATCH, MISMATCH), out=row[1:])
            above = np.maximum.accumulate(row + slope) - slope
            k = int(above.argmax())
            if above[k] > top:
                top, end = float(above[k]), k
        return top, end

    score, end = best(item, text)
    if not score:
        return 0.0, 0, 0
    # The same alignment from its end backwards gives its start.
    _, back = best(item[::-1], text[:end][::-1])
    return score / (MATCH * len(item)), end - back, end - 1


def passages(items: Items, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, first word, words, seeds) of each run of words around seeds of the texts of an Arrow column."""
    for i, h, row in word_hashes(column):
        at, seed = [], []
        for n in items.lengths:
            a, g = _flat.ngrams(h, row, n)
            k = np.searchsorted(items.seed, g)
            hit = np.flatnonzero(items.seed[np.minimum(k, len(items.seed) - 1)] == g)
            at.append(a[hit])
            seed.append(k[hit])
        at, seed = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, seed))
        if not len(at):
            continue
        order = np.argsort(at, kind="stable")
        at, seed = at[order], seed[order]
        first = np.searchsorted(row, row[at], "left")
        last = np.searchsorted(row, row[at], "right")
        low, high = np.maximum(at - items.reach[seed], first), np.minimum(at + items.reach[seed], last)
        # Overlapping surroundings are one passage.
        far = np.maximum.accumulate(high)
        new = np.ones(len(at), bool)
        new[1:] = low[1:] >= far[:-1]
        cut = np.append(np.flatnonzero(new), len(at))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            x, y = int(low[a:b].min()), int(far[b - 1])
            yield i + int(row[at[a]]), x - int(first[a]), h[x:y], np.unique(items.seed[seed[a:b]])


def _passages(items: Items, key_kinds: str):
    """Rows (key..., first word, words, seeds) of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(passages(items, batch.column(batch.num_columns - 1)))
            if found:
                rows, start, words, seeds = zip(*found, strict=True)
                kept = [c.take(pa.array(rows)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(start, pa.int64()), pa.array([w.tobytes() for w in words], pa.binary()), pa.array([x.view(np.int64) for x in seeds], pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "first", "words", "seeds"])

    return run, f"{key_kinds}, first long, words binary, seeds array<long>"


def copies(items: Items, words: np.ndarray, seeds: list[int], min_score: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, last word) of the items of `seeds` that a passage copies."""
    for o in sorted({o for s in seeds for o in items.owners[s % (1 << 64)]}):
        score, a, b = align(items.words[o], words)
        if score >= min_score:
            yield o, score, a, b


def _aligned(items: Items, min_score: float, key_kinds: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (first, words, seeds) in enumerate(zip(*(batch.column(width + c).to_pylist() for c in range(3)), strict=True)):
                out += [(k, items.ids[o], score, first + a, first + b) for o, score, a, b in copies(items, np.frombuffer(words, np.uint64), seeds, min_score)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            rows = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:width]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=[*batch.schema.names[:width], "item_id", "score", "first_word", "last_word"])

    return run, f"{key_kinds}, item_id long, score double, first_word long, last_word long"


def _runs_of_items(benchmark: DataFrame) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator()
    return (items for items in load_items(rows) if len(items.seed))


def contaminated(docs: DataFrame, benchmark: DataFrame, keys: list[str], text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """(keys..., item_id, score, first_word, last_word) of each passage that copies a test item.

    Words are runs of ASCII letters and digits (any case) and other characters; places count
    words from 0. Null and empty texts and items match nothing; items of fewer than five words
    are one seed; items with equal words all match. Repeated rows give repeated results; empty
    tables give no rows; only the named columns are read. The benchmark streams through the
    driver in runs of SEEDS_AT_ONCE seeds, each run one pass over the texts, so its size is bounded
    on every machine whatever the benchmark's.
    """
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    found = None
    for items in _runs_of_items(benchmark):
        run, schema = _passages(items, kinds)
        passages = docs.select(*keys, F.col(text_col).alias("__text")).mapInArrow(run, schema)
        run, schema = _aligned(items, min_score, kinds, len(keys))
        got = passages.mapInArrow(run, schema)
        found = got if found is None else found.unionByName(got)
    return docs.sparkSession.createDataFrame([], f"{kinds}, item_id long, score double, first_word long, last_word long") if found is None else found


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that copy benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """`docs` without rows that copy a test item; all columns stay, whatever their names.

    What a text copies depends on the text and the items alone, so each task filters its own rows
    and nothing is moved. Null and empty texts stay, repeated rows stay or go together; an empty
    benchmark takes nothing, an empty table stays empty.
    """
    at, left = docs.columns.index(text_col), docs
    for items in _runs_of_items(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, _, words, seeds in passages(items, batch.column(at)):
                    if keep[row] and any(copies(items, words, seeds.tolist(), min_score)):
                        keep[row] = False
                yield batch.filter(pa.array(keep))

        left = left.mapInArrow(run, docs.schema)
    return left
