"""Token counts from flat, unindexed token files: a vectorised separator scan with a prefix scan over blocks.

A token file is one stream of ids, each document ended by a separator, cut into blocks of a fixed
number of ids without regard to documents. A block alone knows its own separators only; a prefix
scan over block summaries (ids, separators, place of the last one) tells each block how many
documents ended before it and where its first one began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import _flat
from spanloom.llm._base import materialize, table
from spanloom.llm.tokens import default_path, encoder

SEPARATOR = 50256
BLOCK = 1 << 18
_WIDTH = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


def token_files(docs: DataFrame, path: str, separator: int = SEPARATOR, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Write every document's ids and a separator to flat files: rows (file, kind, no, payload).

    Kind 't' holds blocks of `block` ids of `width` bytes; kind 'd' holds the doc_ids in file
    order and which of them are null, kept beside the files and never read by the scan. A separator
    written out in a text is text like any other, so ids of texts never hold one by that name. Ids that
    do not fit `width` bytes are refused. A null or empty text is a separator alone; repeated rows are written as often
    as they occur, null ids are marked; an empty table gives no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, name = encoder(path, False), TaskContext.get().partitionId()
        held, size, at, row = [], 0, 0, 0

        def out(kind: str, no: int, data: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([kind]), pa.array([no], pa.int64()), pa.array([data.tobytes()], pa.binary())], names=["file", "kind", "no", "payload"])

        for batch in batches:
            ids = batch.column(0)
            # An id and a flag for each document.
            yield out("d", row, np.stack([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)], 1).astype("<i8"))
            row += len(ids)
            buf, off = _flat.buffer_of(batch.column(1))
            for _, _, b, o in _flat.blocks(buf, off, 1 << 21):
                tokens, counts = enc.encode(b, o)
                if len(tokens) and int(tokens.max()) >> (8 * width) or separator >> (8 * width):
                    raise ValueError(f"an id does not fit {width} bytes")
                held.append(np.insert(tokens, np.cumsum(counts), separator).astype(_WIDTH[width]))
                size += len(held[-1])
                if size >= block:
                    flat = np.concatenate(held)
                    for k in range(0, size - size % block, block):
                        yield out("t", at, flat[k : k + block])
                        at += 1
                    held = [flat[size - size % block :]]
                    size %= block
        if size:
            yield out("t", at, np.concatenate(held))

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(chosen.mapInArrow(run, "file long, kind string, no long, payload binary"), "token-files")


def document_counts(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document of flat token files.

    `blocks` has (file, no, payload): payload is the block's ids, `no` orders the blocks of a
    file. n_tokens leaves the separator out. Ids after the last separator of a file are a last,
    unended document; a file that ends with a separator has none. Empty and null payloads are
    blocks without ids; no blocks give no rows.
    """
    kind = _WIDTH[width]

    def ends(payload) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(payload.as_buffer(), kind) == separator) if payload.is_valid else np.zeros(0, np.int64)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ends(x) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([(len(x.as_buffer()) // width if x.is_valid else 0) for x in b.column(2)], pa.int64()),
                pa.array([len(x) for x in found], pa.int64()), pa.array([int(x[-1]) if len(x) else None for x in found], pa.int64()),
            ], names=["file", "no", "n", "seps", "last"])

    blocks = blocks.select("file", "no", "payload")
    sums = materialize(blocks.mapInArrow(summary, "file long, no long, n long, seps long, last long"), "blocks")
    order = Window.partitionBy("file").orderBy("no")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    scan = sums.withColumn("begin", F.coalesce(F.sum("n").over(past), F.lit(0))).select(
        "file", "no", "n", "begin", F.coalesce(F.sum("seps").over(past), F.lit(0)).alias("ended"),
        F.coalesce(F.max(F.col("begin") + F.col("last")).over(past) + 1, F.lit(0)).alias("open"),
        F.lead("no").over(order).isNull().alias("final"),
    )

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, payload, n, begin, ended, opened, final in zip(b.column(0).to_pylist(), b.column(1), *(b.column(k).to_pylist() for k in range(2, 7)), strict=True):
                stop = ends(payload) + begin
                if final and begin + n > (stop[-1] + 1 if len(stop) else opened):
                    stop = np.append(stop, begin + n)
                start = np.append([opened], stop[:-1] + 1)[: len(stop)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(stop), file, np.int64)), pa.array(ended + np.arange(len(stop), dtype=np.int64)), pa.array(start), pa.array((stop - start).astype(np.int64))], names=["file", "ordinal", "start", "n_tokens"])

    # The scan's rows are a few numbers a block: they go to the blocks, which stay where they are.
    joined = blocks.join(scan, ["file", "no"]).select("file", "payload", "n", "begin", "ended", "open", "final")
    return joined.mapInArrow(stitch, "file long, ordinal long, start long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and number of ids of every document, from a scan of flat token files of all of them."""
    files = token_files(table(spark, sf_dir, "documents"), default_path())
    counts = document_counts(files.where("kind = 't'"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, no, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                pairs = np.frombuffer(payload.as_buffer(), "<i8").reshape(-1, 2)
                ids = pairs[:, 0]
                keep = pa.array(ids, mask=pairs[:, 1] == 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), file)), pa.array(no + np.arange(len(ids))), keep], names=["file", "ordinal", "doc_id"])

    ids = files.where("kind = 'd'").select("file", "no", "payload").mapInArrow(named, "file long, ordinal long, doc_id long")
    return ids.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
