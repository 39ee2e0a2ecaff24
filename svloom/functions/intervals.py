"""Expressions over half-open intervals; every argument is a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(s1, s2) < F.least(e1, e2)


def overlap_size(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def overlap_percent(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """How much of the first lies in the second."""
    inside = (s1 >= s2) & (e1 <= e2)
    return F.when(inside, F.lit(1.0)).otherwise(F.try_divide(overlap_size(s1, e1, s2, e2), e1 - s1))


def reciprocal_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    got = F.try_divide(overlap_size(s1, e1, s2, e2), F.greatest(e1 - s1, e2 - s2))
    return F.when(overlaps(s1, e1, s2, e2), got).otherwise(F.lit(0.0))


def within(qs: Column, qe: Column, rs: Column, re: Column, end_within: Column) -> Column:
    """Whether the query lies in the region; end_within: its end may be the region's end (not for insertions)."""
    spans = qs.isin(rs, rs - 1) & (qe == re)
    return spans | ((qs >= rs) & F.when(end_within, qe <= re).otherwise(qe < re))


def size_similarity(a: Column, b: Column) -> Column:
    x, y = F.greatest(a, F.lit(1)), F.greatest(b, F.lit(1))
    return F.when((a == 0) & (b == 0), F.lit(1.0)).otherwise(F.least(x, y) / F.greatest(x, y))


def size_difference(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), F.lit(0)).otherwise(F.greatest(a, F.lit(1)) - F.greatest(b, F.lit(1)))


def inflated(start: Column, end: Column, svtype: Column, svlen: Column) -> tuple[Column, Column]:
    """Boundaries in which an insertion reaches half its length to either side."""
    half = F.when(svtype == "INS", F.floor(svlen / 2)).otherwise(F.lit(0))
    return start - half, end + half
