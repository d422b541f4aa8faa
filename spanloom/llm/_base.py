"""Session helpers shared by the corpus operators: shared folder, tables that cut lineage, text keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a write go as soon as it has ended: the table it wrote stands for them.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that goes to a Python worker: the default bounds rows only, and rows here are whole texts.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
_written: list[str] = []
_scopes: list[list[str]] = []
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir; unset, a local run has one of its own, a cluster none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def bounded_batches(spark: SparkSession) -> None:
    """Bound batches to Python workers by bytes, for this session from here on; a smaller bound that is set stays."""
    now = spark.conf.get(_BATCH).rstrip("b")
    if not now.isdigit() or int(now) > _BATCH_BYTES:
        spark.conf.set(_BATCH, str(_BATCH_BYTES))


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read instead of a recomputation, and fixes
    whatever was non-deterministic. The folder goes when the Python process ends, or with the innermost
    `scratch` block around it unless it is to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/spanloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before or "false")
    if not _written:
        atexit.register(_delete, spark, _written)
    _written.append(path)
    for scope in _scopes:
        scope.append(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    if spark.sparkContext._jsc is None:
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    paths.clear()


@contextmanager
def temporary(spark: SparkSession, paths: list[str]) -> Iterator[None]:
    """Delete the tables of an earlier scope listed in `paths`, whose results have been written, and list those of this one."""
    _delete(spark, paths)
    bounded_batches(spark)
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.pop()


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that `df` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def look_up(left: DataFrame, right: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """All rows of `left` with the columns of `right`, whose keys are unique; nulls where it has none.

    Rows of `right` where `hot` holds must have a proven bound: they go out by broadcast, so a key that
    holds much of `left` moves nothing; only the other rows of `left` are dealt out by key.
    """
    few, rest = right.where(hot), right.where(~hot)
    met = left.join(F.broadcast(few), keys)
    unmet = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest, keys, "left")
    return met.unionByName(unmet)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside, but for those to be kept, when the block ends."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.pop()
        _delete(spark, paths)
