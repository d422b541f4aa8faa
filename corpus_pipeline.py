"""The corpus pipeline: each stage takes documents and gives documents, the last gives packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import contamination, packing, paragraphs, quality, simhash
from spanloom.llm._base import materialize, table, temporary
from spanloom.llm.tokens import default_path

#: Tables of the stage that ran last: its result has been written when the next one begins.
_last: list[str] = []


def _staged(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with temporary(spark, _last):
            return stage(spark, docs, sf_dir)

    return run


@_staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_staged
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


@_staged
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and sentences are cut from all documents but the first; no document goes."""
    return paragraphs.cut_repeats(docs)


@_staged
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy a benchmark item go."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_staged
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of 2048 tokens."""
    return packing.packed_documents(docs, default_path())


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained scores, components and packing have no SQL form; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
