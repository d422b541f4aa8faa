"""Streams that must be sorted, and read files that many tasks share."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.sources import sequences as Q
from spanloom.streaming import sorted_streams as T


@pytest.fixture
def store(spark):
    before = spark.conf.get(T.STORE[0], None)
    spark.conf.set(*T.STORE)
    yield
    spark.conf.set(T.STORE[0], before) if before else spark.conf.unset(T.STORE[0])


def step(spark, tmp_path, k, rows, operator):
    """One micro-batch with a file of `rows`, continuing from the checkpoint; all that has been passed on."""
    spark.createDataFrame(rows, T.FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = operator(spark.readStream.schema(T.FIELDS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted((r.ord, r.score) for r in spark.read.schema(T.FIELDS).parquet(f"{tmp_path}/out").collect())


def test_unique_trees_over_restarts(spark, tmp_path, store):
    first = [("s", 1, 9, "d", 0.5, 1), ("s", 1, 9, "d", 0.9, 2), ("s", 1, 9, "e", 0.1, 3), ("t", 5, 6, "d", None, 4)]
    assert step(spark, tmp_path, 0, first, T.unique_trees) == [(2, 0.9)]
    # The row that waits in the state meets an equal one of a later run of the query.
    second = [("s", 1, 9, "e", 0.3, 5), ("s", 2, 9, "e", 0.3, 6), ("t", 5, 6, "d", 0.2, 7), ("t", 7, 8, "d", 0.2, 8)]
    assert step(spark, tmp_path, 1, second, T.unique_trees) == [(2, 0.9), (5, 0.3), (7, 0.2)]


def test_disorder_ends_the_stream(spark, tmp_path, store):
    rows = [("s", 1, 9, "d", 0.5, 1), ("s", 3, 4, "d", 0.5, 2), ("t", 1, 2, "d", 0.5, 3)]
    assert len(step(spark, tmp_path, 0, rows, T.ensure_sorted)) == 3
    assert len(step(spark, tmp_path, 1, [("s", 3, 4, "e", 0.5, 4)], T.ensure_sorted)) == 4
    with pytest.raises(Exception, match="comes after 3-4"):
        step(spark, tmp_path, 2, [("s", 2, 9, "d", 0.5, 5)], T.ensure_sorted)


@pytest.mark.parametrize("end", ["\n", ""])
def test_records_of_split_files(spark, tmp_path, end):
    rng = random.Random(71)
    text = []
    for k in range(300):
        n = rng.randrange(1, 60)
        qual = "".join(rng.choice("@+!IH@") for _ in range(n))
        text.append(f"@read {k}\n{''.join(rng.choice('acgt') for _ in range(n))}\n+\n{qual}")
    text[100] = "@short\nacgt\n+\nII"
    path = str(tmp_path / "r.fastq")
    with open(path, "w") as f:
        f.write("\n".join(text) + end)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("128m", "3k", "997"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = Q.read_fastq_splits(spark, path)
            rows = sorted(map(tuple, got["records"].select("description", "seq", "qual").collect()))
            bad = [r.description for r in got["problems"].collect()]
            assert spark.read.option("lineSep", "\n@").text(path).rdd.getNumPartitions() > (1 if size != "128m" else 0)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
            spark.conf.set("spark.sql.files.openCostInBytes", before[1])
        want = sorted((r.split("\n")[0][1:], r.split("\n")[1], r.split("\n")[3]) for k, r in enumerate(text) if k != 100)
        assert rows == want
        assert bad == ["short"]


def test_formats_are_told_apart(spark, tmp_path):
    texts = {"fasta": "\n>x y\nac\ngt\n", "fastq": "@q\nacgt\n+\n!!!!\n", "plain": "ac gt\n\tac\n", "genbank": "LOCUS x\nDEFINITION  some\nACCESSION y\nORIGIN\n 1 acgt ac\n//\n"}
    for kind, text in texts.items():
        path = str(tmp_path / kind)
        with open(path, "w") as f:
            f.write(text)
        assert Q.guess_format(spark, path) == kind
        assert [r.seq for r in Q.read_sequences(spark, path).select(F.lower("seq").alias("seq")).collect()] == [{"plain": "acgtac", "genbank": "acgtac"}.get(kind, "acgt")]
