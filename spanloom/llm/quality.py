"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives P, unlabelled web text U and a class prior p give the risk
    p * R_P(+) + max(0, R_U(-) - p * R_P(-)),
which is unbiased but for the clipping that keeps it from going negative. The model is additive:
each text statistic is cut at its quantiles and each cell has a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import _flat
from spanloom.llm._base import materialize, table

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "punct", "odd_end", "lone_symbol", "distinct",
    "repeat_next", "top_share", "newline", "cap_words", "caps_in_word", "end_marks", "pair_distinct", "non_ascii", "long_words",
)
SAMPLE = 20_000
CELLS = 24

_UPPER = _flat._class(lambda b: 65 <= b <= 90)
_DIGIT = _flat._class(lambda b: 48 <= b <= 57)
_PUNCT = _flat._class(lambda b: 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126)
_MARK = _flat._class(lambda b: chr(b) in ".,;:!?" )


def features(column: pa.Array) -> np.ndarray:
    """Text statistics (rows x FEATURES) of an Arrow column; null counts as empty."""
    buf, off = _flat.buffer_of(column)
    out = np.zeros((len(off) - 1, len(FEATURES)))
    for i, j, b, o in _flat.blocks(buf, off):
        n, rows = np.diff(o), j - i
        s, e, row = _flat.words(b, o, _flat.NON_SPACE)
        nw = np.bincount(row, minlength=rows)
        per_byte, per_word = np.maximum(n, 1), np.maximum(nw, 1)

        def by_byte(cls, per=per_byte, b=b, o=o):
            total = np.concatenate([[0], np.cumsum(cls[b], dtype=np.int64)])
            return (total[o[1:]] - total[o[:-1]]) / per

        def by_word(flag, per=per_word, row=row, rows=rows):
            return np.bincount(row[flag], minlength=rows) / per

        up = np.concatenate([[0], np.cumsum(_UPPER[b], dtype=np.int64)])
        low = np.concatenate([[0], np.cumsum(_PUNCT[b], dtype=np.int64)])
        size, ups, puncts = e - s, up[e] - up[s], low[e] - low[s]
        h = _flat.span_hashes(_flat.BYTE_VALUES[b], s, e)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        order = np.lexsort((h, row))
        ho, ro = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (ho[1:] != ho[:-1]) | (ro[1:] != ro[:-1])
        kinds = np.bincount(ro[new], minlength=rows)
        top = np.zeros(rows)
        if len(h):
            np.maximum.at(top, ro[new], np.diff(np.append(np.flatnonzero(new), len(h))))
        at, pair = _flat.ngrams(h, row, 2)
        order = np.lexsort((pair, row[at]))
        po, pr = pair[order], row[at][order]
        new = np.ones(len(po), bool)
        new[1:] = (po[1:] != po[:-1]) | (pr[1:] != pr[:-1])
        pairs = np.bincount(pr[new], minlength=rows) / np.maximum(nw - 1, 1)
        final = b[e - 1] if len(e) else np.zeros(0, np.uint8)
        before = b[np.maximum(e - 2, 0)] if len(e) else final
        out[i:j] = np.stack([
            np.log1p(n), np.log1p(nw), np.bincount(row, size, rows) / per_word, by_byte(_UPPER), by_byte(_DIGIT), by_byte(_PUNCT),
            by_word(_PUNCT[final] & (~_MARK[final] | _PUNCT[before])), by_word(puncts == size), kinds / per_word, by_word(same), top / per_word,
            by_byte(_flat._class(lambda c: c == 10)), by_word(_UPPER[b[s]] if len(s) else same), by_word((ups > 1) & (ups * 2 > size)), by_word(_MARK[final]),
            pairs, by_byte(_flat._class(lambda c: c >= 128)), by_word(size > 18),
        ], 1)
    return out


@dataclass
class Model:
    edges: np.ndarray  # features x (CELLS - 1)
    weight: np.ndarray  # features * CELLS + 1
    prior: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        c = np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)
        return c + np.arange(len(self.edges)) * CELLS

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = self.weight[self.cells(x)].sum(1) + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1200, rate: float = 0.05, ridge: float = 2e-4) -> Model:
    """Minimise the non-negative risk with logistic loss; where the clipped part is negative, step back along it."""
    prior = min(max(prior, 0.01), 0.99)
    width = len(FEATURES)
    m = Model(np.zeros((width, CELLS - 1)), np.zeros(width * CELLS + 1), prior)
    m.weight[-1] = np.log(prior / (1 - prior))
    if not len(positive) or not len(unlabelled):
        return m
    m.edges = np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, CELLS + 1)[1:-1], axis=0).T
    cp, cu = m.cells(positive), m.cells(unlabelled)
    w, first, second = m.weight, np.zeros_like(m.weight), np.zeros_like(m.weight)

    def gradient(cells, d):
        g = np.bincount(cells.ravel(), np.repeat(d, width), len(w))
        g[-1] = d.sum()
        return g / len(d)

    for t in range(1, steps + 1):
        zp, zu = (w[c].sum(1) + w[-1] for c in (cp, cu))
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = gradient(cu, su) - prior * gradient(cp, sp)
        g = prior * gradient(cp, sp - 1) + negative if rest >= 0 else -negative
        g[:-1] += ridge * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    # The mean score of unlabelled text is the prior: set the intercept by bisection.
    z, low, high = w[cu].sum(1), -60.0, 60.0
    for _ in range(60):
        w[-1] = (low + high) / 2
        low, high = (low, w[-1]) if (1 / (1 + np.exp(-z - w[-1]))).mean() > prior else (w[-1], high)
    return m


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """Share of the positive class in unlabelled text, from positives and unlabelled text alone.

    Above any score, unlabelled text holds prior * (share of positives above) and whatever negatives
    score as high, so the ratio of the two shares is never below the prior and comes down to it
    where negatives run out. Each half is scored by a model of the other half; the smallest ratio
    over scores that at least `least` of the positives reach is taken.
    """
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    shares = []
    for k in (0, 1):
        m = fit(positive[k::2], unlabelled[k::2], 0.5, steps=300)
        p, u = np.sort(m.score(positive[1 - k :: 2])), np.sort(m.score(unlabelled[1 - k :: 2]))
        cuts = np.quantile(p, np.linspace(0, 1 - least, 41))
        shares.append([1 - np.searchsorted(z, cuts) / len(z) for z in (u, p)])
    u, p = ((x * n + 1) / (n + 2) for x, n in zip(np.mean(shares, 0), (len(unlabelled), len(positive)), strict=True))
    # Half a standard error on either side: the smallest of many noisy ratios would lie too low.
    above = u + 0.5 * np.sqrt(u * (1 - u) / len(unlabelled))
    below = p - 0.5 * np.sqrt(p * (1 - p) / len(positive))
    return float(np.clip(np.min(above / below), 0.01, 0.99))


def _sampled(x: DataFrame, rows: int, sample: int) -> np.ndarray:
    """About `sample` of the `rows` feature vectors, by a threshold on a hash of id and vector; twice that at most."""
    share = min(1.0, sample / max(rows, 1))
    if share < 1:
        x = x.where(F.pmod(F.xxhash64("id", "x", F.lit(4)), F.lit(1 << 40)) < int(share * (1 << 40)))
    v = x.select("x").limit(2 * sample).toPandas()["x"]
    if not len(v):
        return np.zeros((0, len(FEATURES)))
    # In an order that does not depend on partitions; taking every other one then gives two alike halves.
    v = np.stack(v.to_list()).astype(np.float64)
    return v[np.lexsort(v.T)]


def text_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of each text, written once; training and scoring both read them."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1)).astype(np.float32)
            flat = pa.array(x.ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), flat)], names=["id", "x"])

    return materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, x array<float>"), "features")


def held_out(id_col: str = "id"):
    """True where crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(x: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about `sample` trusted positives and `sample` unlabelled texts, taken by a hash of id and statistics.

    Positives are rows labelled 1 outside the held-out fold; all other rows, labelled 0 or not at
    all, are unlabelled text. The class prior is estimated from these two. Without a positive all
    scores are 0.5.
    """
    trusted = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").where(~held_out("doc_id"))
    positive = x.join(trusted, x["id"] == trusted["doc_id"], "left_semi")
    rest = x.join(trusted, x["id"] == trusted["doc_id"], "left_anti")
    known, other = positive.count(), rest.count()
    p, u = _sampled(positive, known, sample), _sampled(rest, other, sample)
    if not len(p):
        return fit(p, u, 0.5)
    # U must be drawn from all text: put the positives back in their share of it, once the prior of the rest is known.
    back = min(len(p), round(len(u) * known / max(other, 1)))
    prior = (estimate_prior(p, u) * len(u) + back) / max(len(u) + back, 1)
    return fit(p, np.concatenate([u, p[:back]]), prior)


def score(x: DataFrame, model: Model) -> DataFrame:
    kind = x.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(flat))], names=["id", "score"])

    return x.mapInArrow(run, f"id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of `docs`.

    Null texts count as empty and are scored; null or repeated ids are scored as any row; labels
    of ids that have several take the largest; with no positive label all scores are 0.5. Other
    columns are ignored, an empty table gives no rows.
    """
    x = text_features(docs, id_col, text_col)
    s = score(x, train(x, labels))
    return s.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; null and empty texts are scored, null and repeated ids are rows like others, see `classify`."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that the classifier rejects; all columns stay, whatever their names.

    The model is fitted on texts taken by a hash of id and text, 4 * sample of them about, in
    which positives and other texts have their shares of the table; every row is then scored in
    one pass that moves no text between machines. Null and empty texts, null ids and repeated rows
    are scored like any row; without a positive label all rows stay, an empty table stays empty.
    """
    share = min(1.0, 4 * sample / max(docs.count(), 1))
    taken = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)) < int(share * (1 << 40)))
    model = train(text_features(taken, id_col, text_col), labels, sample)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(features(b.column(at)).astype(np.float32).astype(np.float64)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
