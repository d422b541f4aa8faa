"""Algebra of closed, 1-based ranges as Column expressions.

A range is two long columns, start <= end. Every function takes columns or column names and
stays inside generated code, so filters on it still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def length(start: C, end: C) -> Column:
    return _c(end) - _c(start) + 1


def overlap(s1: C, e1: C, s2: C, e2: C) -> Column:
    return (_c(s1) <= _c(e2)) & (_c(e1) >= _c(s2))


def overlap_length(s1: C, e1: C, s2: C, e2: C) -> Column:
    """Common positions; 0 or less where there are none."""
    return F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)) + 1


def overlap_delta(s1: C, e1: C, s2: C, e2: C, delta: int) -> Column:
    """At least `delta` common positions; both ranges must be that long."""
    return (length(s1, e1) >= delta) & (length(s2, e2) >= delta) & (overlap_length(s1, e1, s2, e2) >= delta)


def contains(s1: C, e1: C, s2: C, e2: C) -> Column:
    """The first range holds the second."""
    return (_c(s1) <= _c(s2)) & (_c(e1) >= _c(e2))


def within(start: C, end: C, point: C) -> Column:
    return _c(point).between(_c(start), _c(end))


def hull_start(*starts: C) -> Column:
    return F.least(*map(_c, starts))


def hull_end(*ends: C) -> Column:
    return F.greatest(*map(_c, ends))


def equal_with_delta(s1: C, e1: C, s2: C, e2: C, delta: int) -> Column:
    return (F.abs(_c(s1) - _c(s2)) <= delta) & (F.abs(_c(e1) - _c(e2)) <= delta)


def compare(s1: C, e1: C, s2: C, e2: C) -> Column:
    """-1, 0 or 1 by start, then end."""
    return F.when(_c(s1) != _c(s2), F.signum(_c(s1) - _c(s2))).otherwise(F.signum(_c(e1) - _c(e2))).cast("int")


def compare_with_delta(s1: C, e1: C, s2: C, e2: C, delta: int) -> Column:
    return F.when(equal_with_delta(s1, e1, s2, e2, delta), F.lit(0)).otherwise(compare(s1, e1, s2, e2))


def compare_by_length(s1: C, e1: C, s2: C, e2: C) -> Column:
    """Longer ranges first."""
    return F.signum(length(s2, e2) - length(s1, e1)).cast("int")


def offset(start: C, end: C, by: int) -> tuple[Column, Column]:
    return _c(start) + by, _c(end) + by


def reorder(start: C, end: C) -> tuple[Column, Column]:
    return F.least(_c(start), _c(end)), F.greatest(_c(start), _c(end))


def opposite_strand(start: C, end: C, total: C) -> tuple[Column, Column]:
    """The range seen from the other strand of a sequence of `total` positions."""
    return _c(total) - _c(end) + 1, _c(total) - _c(start) + 1


def consecutive(end: C, next_start: C) -> Column:
    return _c(end) + 1 == _c(next_start)


# Arrays of ranges: array<struct<start, end>>.


def sort_ranges(a: C) -> Column:
    return F.array_sort(_c(a))


def ranges_are_sorted(a: C) -> Column:
    """True if no range is smaller, by start and end, than the one before it."""
    return _c(a) == F.array_sort(_c(a))


def ranges_do_not_overlap(a: C) -> Column:
    """True if each range begins after the one before it has ended."""
    x = _c(a)
    pairs = F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda p, q: q["start"] > p["end"])
    return F.forall(pairs, lambda ok: ok)


def unique_ranges(a: C) -> Column:
    return F.array_distinct(F.array_sort(_c(a)))


def unique_range_counts(a: C) -> Column:
    """How often each of `unique_ranges` occurs, in its order."""
    x = _c(a)
    return F.transform(unique_ranges(x), lambda r: F.size(F.filter(x, lambda q: q == r)))


def total_range_length(a: C) -> Column:
    return F.aggregate(_c(a), F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"] + 1)


def spanned_range_length(a: C) -> Column:
    """From the first start to the last end; 0 without ranges."""
    x = _c(a)
    return F.when(F.size(x) > 0, F.array_max(F.transform(x, lambda r: r["end"])) - F.array_min(F.transform(x, lambda r: r["start"])) + 1).otherwise(F.lit(0))
