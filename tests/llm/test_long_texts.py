"""Texts of several megabytes: what stands at their end counts like what stands at their beginning."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from spanloom.llm import class_lm, contamination, licenses, paragraphs, quality, simhash

WORDS = [a + b + c for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwxyz"]


@pytest.fixture(scope="module")
def long():
    rng = random.Random(5)
    words = [rng.choice(WORDS) for _ in range(800_000)]
    return "\n".join(" ".join(words[i : i + 50]) for i in range(0, len(words), 50))


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_licenses_and_words(spark, long):
    got = {r.id: r for r in licenses.scan(docs(spark, [long + "\nMIT License", "mit license"])).collect()}
    assert got[0].n_words == 800_002 and [(b.first, b.last) for b in got[0].base] == [(800_000, 800_000)]


def test_fingerprints(long):
    words = long.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(h))
    assert simhash.fingerprints(pa.array([long])).tolist() == [want]


def test_quality_statistics(long):
    x = quality.features(pa.array([long, long[: len(long) // 2]]))
    assert np.isfinite(x).all() and x[0, 1] == pytest.approx(np.log1p(800_000))


def test_copied_items_and_lines(spark, long):
    rng = random.Random(6)
    item, line = (" ".join(f"{rng.choice(WORDS)}{k}" for k in range(40)) for _ in range(2))
    d = docs(spark, [line, long + "\n" + item + "\n" + line, "short"])
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id for r in contamination.drop_contaminated(d, items).collect()} == {0, 2}
    cut = {r.doc_id: r.text for r in paragraphs.cut_repeats(d).collect()}
    assert line in cut[0] and line not in cut[1] and item in cut[1]


def test_scores(spark, long):
    d = docs(spark, [long, "abc", None])
    model = class_lm.train(d, "text", classes=4, rounds=1)
    rows = {r.id: r for r in class_lm.score(d, model, "doc_id", "text").collect()}
    assert model.tokens == 800_004 and rows[0].n_tokens == rows[0].n_known == 800_001 and rows[0].score > rows[0].base - 1e-6 * abs(rows[0].base)
