"""Class bigram scores against plain Python that weighs every move by the whole likelihood."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import _flat, class_lm

SCHEMA = "doc_id long, text string, n int, key string, cls int, word string, row long, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, "w", 3, "x") for i, t in rows], SCHEMA)


def corpus(seed, n):
    """Texts of two vocabularies in which kinds of words alternate, and the odd cases."""
    rng = random.Random(seed)
    kinds = [[f"{a}{k}" for k in range(12)] for a in ("Ab", "cé", "d", "ß")]
    rows = []
    for i in range(n):
        first = rng.choice((0, 2))
        rows.append((i, " ".join(rng.choice(kinds[first + j % 2]) for j in range(rng.randrange(1, 40)))))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (None, "Ab1 cé1"), (3, rows[3][1]), (3, rows[3][1]), (n + 3, "never seen words"), (n + 4, "d1 " * 300), (n + 5, "unheard " * 50), (n + 6, "unheard d1 unheard")]
    return rows


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]


def key_of(word):
    if not word:
        return class_lm.END
    buf, off = _flat.buffer_of(pa.array([word]))
    return int(class_lm.token_keys(buf, off)[0][0])


def plain_model(texts, classes, rounds):
    sequences = [["", *tokens(t)] for t in texts]
    count = Counter(w for s in sequences for w in s[1:])
    pairs = Counter(p for s in sequences for p in zip(s, s[1:], strict=False))
    frequent = {w for w, n in count.items() if n * class_lm.HOT >= sum(count.values()) or not w}
    cls = {w: (key_of(w) % classes if w else classes) if w in frequent else classes + 1 for w in count}

    def matrix(c, wide=classes + 2):
        g = np.zeros((wide, wide))
        for (v, w), n in pairs.items():
            g[c[v], c[w]] += n
        return g

    def likelihood(g):
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    def moved(words, kept, stay):
        out = dict(kept)
        for w in words:
            worth = [likelihood(matrix({**kept, w: c})) for c in range(classes)]
            if not stay or max(worth) > worth[kept[w]] + 1e-7:
                out[w] = int(np.argmax(np.array(worth) > max(worth) - 1e-7))
        return out

    best, kept, drops = -math.inf, cls, 0
    for left in range(rounds, -1, -1):
        if likelihood(matrix(cls)) > best:
            best, kept = likelihood(matrix(cls)), cls
        else:
            drops += 1
        if left:
            cls = moved([w for w in frequent if w and class_lm.may_move(np.array([key_of(w)]), drops)[0]], kept, True)
    kept = moved(set(count) - frequent, kept, False)
    return count, kept, matrix(kept, classes + 1), drops


def plain_score(text, count, cls, g, mix=0.9):
    total, types, singles = sum(count.values()), len(count), sum(n == 1 for n in count.values())
    size, unseen = g.sum(1), (singles + 1) / (total + 2)
    base = score = known = 0
    before = ""
    for w in tokens(text):
        c = count[w]
        known += c > 0
        base += math.log10((c + 0.5) / (total + 0.5 * (types + 1)))
        if not c:
            p = unseen
        elif before in count:
            a, b = cls[before], cls[w]
            p = (1 - unseen) * (mix * (g[a, b] + 0.5) / (size[a] + 0.5 * (size > 0).sum()) * c / size[b] + (1 - mix) * c / total)
        else:
            p = (1 - unseen) * c / total
        score += math.log10(p)
        before = w
    return known, base, score


@pytest.mark.parametrize(("hot", "classes", "rounds", "undone"), [(1 << 18, 5, 3, True), (12, 5, 3, None), (50, 6, 2, None), (1 << 18, 12, 0, False)])
def test_model_and_scores(spark, monkeypatch, hot, classes, rounds, undone):
    monkeypatch.setattr(class_lm, "HOT", hot)
    monkeypatch.setattr(class_lm, "KNOWN", 2 * hot)
    rows = corpus(4, 60)
    learned = [(i, t) for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1]
    docs = table(spark, rows)
    model = class_lm.train(docs.where(~class_lm.held_out("doc_id")), "text", classes, rounds)
    count, cls, g, drops = plain_model([t for _, t in learned], classes, rounds)
    assert undone is None or (drops > 0) == undone
    assert {bytes(r.word).decode(): r.n for r in model.words.collect()} == dict(count)
    assert {r.key: (r.n, r.cls) for r in model.classes.collect()} == {key_of(w): (count[w], c) for w, c in cls.items()}
    assert (model.pairs == g).all()
    got = class_lm.score(docs, model, "doc_id", "text").collect()
    assert len(got) == len(rows)
    at = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    want = sorted(((i, len(tokens(t)), *plain_score(t, count, cls, g)) for i, t in rows), key=at)
    for r, w in zip(sorted(((r.id, r.n_tokens, r.n_known, r.base, r.score) for r in got), key=at), want, strict=True):
        assert r[:3] == w[:3] and r[3:] == pytest.approx(w[3:], abs=1e-8), (r, w)


def test_probabilities_add_up(spark):
    docs = table(spark, corpus(9, 30))
    model = class_lm.train(docs, "text", classes=4, rounds=1)
    rows, steps = model.classes.collect(), model.steps()
    for before in range(len(steps)):
        assert sum(r.n * 10 ** steps[before, r.cls] for r in rows) + 10 ** steps[before, -1] == pytest.approx(1)


def test_held_out_text_is_likelier_than_by_single_words(spark):
    docs = table(spark, corpus(6, 300)[:300])
    model = class_lm.train(docs.where(~class_lm.held_out("doc_id")), "text", classes=6, rounds=4)
    rows = class_lm.score(docs.where(class_lm.held_out("doc_id")), model, "doc_id", "text").collect()
    words = sum(r.n_tokens for r in rows)
    perplexity = [10 ** (-sum(r[c] for r in rows) / words) for c in ("score", "base")]
    assert perplexity[0] < 0.7 * perplexity[1]


def test_nothing_learned_and_nothing_scored(spark):
    docs = table(spark, corpus(2, 10))
    empty = docs.where("false")
    model = class_lm.train(empty, "text", classes=4)
    rows = class_lm.score(docs, model, "doc_id", "text").collect()
    assert len(rows) == docs.count() and all((r.n_known, r.base, r.score) == (0, 0, 0) for r in rows)
    assert class_lm.score(empty, class_lm.train(docs, "text", classes=4, rounds=1), "doc_id", "text").count() == 0


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    real = class_lm._values
    monkeypatch.setattr(class_lm, "_values", lambda salt: np.full(256, 3, np.uint64) if salt == 0 else real(salt))
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]) for t in ("ab x", "cd x")]
    for salt, keys in ((0, 3), (1, 4)):
        rows = {(k, w) for b in class_lm._count_words(salt)(iter(batches)) for k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        assert len(rows) == 4 and len({k for k, _ in rows}) == keys  # ab and cd share a key under the first
    pairs = class_lm._summed([(np.array([1, 1, 2]), np.array([5, 5, 6]), np.array([1, 2, 3]))])
    assert sorted(zip(*map(list, pairs), strict=True)) == [(1, 5, 3), (2, 6, 3)]
    monkeypatch.setattr(_flat, "mix", lambda h: np.zeros_like(h))
    pairs = class_lm._summed([(np.array([1, 1, 2]), np.array([5, 5, 6]), np.array([1, 2, 3]))])
    assert sorted(zip(*map(list, pairs), strict=True)) == [(1, 5, 3), (2, 6, 3)]
