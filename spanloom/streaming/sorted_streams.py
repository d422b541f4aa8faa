"""Operators over streams that arrive in order, with one row a key as state: repeated trees and the order itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps arbitrary state; set it before a stream of this module starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FIELDS = "seqid string, start long, end long, digest string, score double, ord long"


class DisorderError(ValueError):
    """A row of a stream that must be sorted comes after a later one."""


def _behind(held: tuple | None, start: int, end: int) -> bool:
    return held is not None and (start, end) < (held[1], held[2])


class _LastRow(StatefulProcessor):
    """State: the last row of the key, as it would be passed on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", FIELDS)

    def close(self) -> None:
        pass

    def rows(self, key: tuple, batches: Iterator[pd.DataFrame]) -> tuple[tuple | None, list[tuple]]:
        """(row held, rows of this batch by place); a row before the held one, or out of place by itself, is an error."""
        held = tuple(self._last.get()) if self._last.exists() else None
        rows = [(r.seqid, int(r.start), int(r.end), r.digest, None if pd.isna(r.score) else float(r.score), int(r.ord)) for b in batches for r in b.itertuples()]
        # A micro-batch holds the rows of a key in any order: `ord` is the order in which the source had them.
        rows.sort(key=lambda r: r[5])
        for before, r in zip([held, *rows], rows, strict=False):
            if _behind(before, r[1], r[2]):
                raise DisorderError(f"{r[0]}: {r[1]}-{r[2]} comes after {before[1]}-{before[2]}")
        return held, rows


class _Checked(_LastRow):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, got = self.rows(key, rows)
        if got:
            self._last.update(got[-1])
            yield pd.DataFrame(got, columns=["seqid", "start", "end", "digest", "score", "ord"])


class _Unique(_LastRow):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, got = self.rows(key, rows)
        out = []
        for r in got:
            if held is not None and r[1:4] == held[1:4]:
                # Equal trees: the first stays, unless a later one has the higher score.
                held = r if (r[4] if r[4] is not None else float("-inf")) > (held[4] if held[4] is not None else float("-inf")) else held
                continue
            if held is not None:
                out.append(held)
            held = r
        if held is not None:
            self._last.update(held)
        if out:
            yield pd.DataFrame(out, columns=["seqid", "start", "end", "digest", "score", "ord"])


def ensure_sorted(stream: DataFrame) -> DataFrame:
    """Rows (seqid, start, end, digest, score, ord) passed on as they are; the query fails with DisorderError at a row before the one that it follows.

    What the last row of each sequence was is kept from one micro-batch to the next and over restarts.
    """
    return stream.groupBy("seqid").transformWithStateInPandas(_Checked(), FIELDS, "Append", "None")


def unique_trees(stream: DataFrame) -> DataFrame:
    """One row of each run of equal trees (same range and digest) of a sequence: the first with the highest score.

    A row is passed on once a different one follows; the last of each sequence waits in the state.
    """
    return stream.groupBy("seqid").transformWithStateInPandas(_Unique(), FIELDS, "Append", "None")
