"""Every stage of the corpus pipeline on awkward rows, and the whole of it against plain Python."""

import collections
import random
import re
import zlib

import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from spanloom.llm import packing, paragraphs, quality, queries, sharding, simhash, suffixes, token_files, tokens, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, k string, t long, row string, __gone string, length long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "web", None if t is None else len(t), "a", "b", 1, "c", "d", 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark whose documents hold every case at once."""
    rng = random.Random(61)
    base, line = prose(rng, 120), prose(rng, 60)
    item = prose(rng, 40)
    texts = [prose(rng, 100).capitalize() + "." for _ in range(40)]
    texts += [base, base, base + " tail", f"{prose(rng, 30)}\n{line}\n{prose(rng, 30)}", f"{prose(rng, 35)}\n{line}\n{prose(rng, 25)}"]
    texts += [f"{prose(rng, 40)} {item} {prose(rng, 40)}", None, "", "\n\n", "é中😀 " * 50, "<|endoftext|> " + prose(rng, 20), prose(rng, 4000)]
    folder = str(tmp_path_factory.mktemp("tables"))
    ids = [*range(len(texts) - 1), None]
    frame(spark, texts, ids).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(48) if i != 31] + [(None, 1, 0), (31, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def key(r):
    return tuple(r)


def test_stages_one_by_one(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before = [key(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        rows = [key(r) for r in out.collect()]
        if name == "substrings":
            # No document goes, and only texts and their lengths change.
            assert collections.Counter((r[0], *r[2:4], *r[5:]) for r in rows) == collections.Counter((r[0], *r[2:4], *r[5:]) for r in before)
            assert all(r[4] == (None if r[1] is None else len(r[1])) for r in rows)
        else:
            assert not collections.Counter(rows) - collections.Counter(before), name
        if name == "simhash":
            assert sorted(map(repr, rows)) == sorted(map(repr, brute_keep_one(before)))
        if name == "decontamination":
            assert {r[0] for r in before} - {r[0] for r in rows} == {45}
    check_pieces(corpus_pipeline.packing_stage(spark, docs, tables).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum((v >> b) & 1 for v in h) * 2 > len(h))


def brute_keep_one(rows):
    import hashlib

    fp = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 4) for i in range(len(rows))]
    groups = collections.defaultdict(list)
    for r, g in zip(rows, root, strict=True):
        groups[g].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())) for g in groups.values()]


def check_pieces(rows, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path())
    want = collections.Counter()
    for i, t in docs:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        for p, (a, z) in enumerate([(0, first), *((k, k + 2048) for k in range(first, len(ids), 2048))]):
            want[i, p, a, z - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:z]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048


def test_whole_pipeline(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert rows and {r.doc_id for r in rows} >= set(range(30)) and 45 not in {r.doc_id for r in rows}
    assert len({r.doc_id for r in rows} & {40, 41, 42}) == 1


def test_stages_on_nothing(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_queries_on_awkward_tables(spark, tables):
    """The registered queries themselves, each over the whole of these tables."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    n = len(docs)
    check_pieces(queries.QUERIES["op3_packing"](spark, tables).collect(), docs)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path())
    counts = queries.QUERIES["op5_token_counts"](spark, tables)
    # In the files a separator that a text writes out is text.
    lib.encode_special_tokens = True
    assert collections.Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in docs) == collections.Counter((r.doc_id, r.n_tokens) for r in counts.collect())
    for name in ("op1_licenses", "op2_suffix_dedup", "op4_quality", "op7_sharding", "op8_simhash"):
        assert queries.QUERIES[name](spark, tables).count() == n, name
    fps = collections.Counter((r.doc_id, r.fingerprint) for r in queries.QUERIES["op8_simhash"](spark, tables).collect())
    assert fps == collections.Counter((i, f"{brute_fingerprint(t):016x}") for i, t in docs)
    assert {r.doc_id for r in queries.QUERIES["op6_decontamination"](spark, tables).collect()} == {45}


def test_repeated_units_against_brute_force(spark):
    """Clusters of lines by exact Jaccard, and every run of 60 equal words of two documents is touched."""
    rng = random.Random(62)
    vocabulary = [prose(rng, 1) for _ in range(3000)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    lines = [words(rng.randrange(10, 60)) for _ in range(25)]
    for k in range(12):
        w = list(lines[k])
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        lines.append(w)
    texts = [" ".join(w) for w in lines]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in lines]
    root = list(range(len(lines)))
    for _ in lines:
        root = [min(root[j] for j in range(len(lines)) if near(sets[i], sets[j])) for i in range(len(lines))]
    groups = collections.Counter(root)
    rows = paragraphs.repeated_units(frame(spark, texts)).collect()
    whole = {r.id: (r.cluster, r.removed) for r in rows if r.words == len(lines[r.id])}
    assert set(whole) == {i for i, g in enumerate(root) if groups[g] > 1}
    assert all((whole[i][0] == whole[j][0]) == (root[i] == root[j]) for i in whole for j in whole)
    assert all(removed == (root[i] != i) for i, (_, removed) in whole.items())
    # Passages inside lines, with no border of line or sentence beside them.
    shared = [words(60) for _ in range(12)]
    inside = [" ".join([*words(33), *p, *words(41)]) for p in shared for _ in range(2)]
    cut = [r.text for r in paragraphs.cut_repeats(frame(spark, inside)).orderBy("doc_id").collect()]
    hit = sum(len(cut[2 * k + 1]) < len(inside[2 * k + 1]) - 80 for k in range(12))
    assert hit >= 11 and all(cut[2 * k] == inside[2 * k] for k in range(12))


def test_hot_bands_lose_no_link(spark, monkeypatch):
    """One band with many lines, cut into small pieces: the components stay those of all pairs."""
    rng = random.Random(63)
    core = prose(rng, 150).split()
    lines = []
    for k in range(40):
        w = list(core)
        w[rng.randrange(150)] = f"x{k}"
        lines.append(w)
    lines += [prose(rng, 30).split() + core[:25] for _ in range(6)]
    lines.append([*lines[-1][:-1], "end"])
    texts = [" ".join(w) for w in lines]
    want = None
    for piece in (4096, 3):
        monkeypatch.setattr(paragraphs, "PIECE", piece)
        rows = paragraphs.repeated_units(frame(spark, texts)).collect()
        got = sorted((r.id, r.first, r.end, r.removed) for r in rows)
        want = want or got
        assert got == want and len({r.cluster for r in rows if r.words == 150}) == 1
