"""Joins on time: points in ranges, overlapping intervals, and the latest row as of a time. Each is an equi-join or a running value, never a comparison of all rows with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.runtime import fresh_name


def _slices(start, end, size: int):
    first = F.floor(start / size)
    return F.sequence(first, F.greatest(F.floor(end / size), first))


def range_join(points: DataFrame, ranges: DataFrame, on: list[str], at: str, start: str, end: str, size: int) -> DataFrame:
    """Points with every range of the same ``on`` that holds them (start <= at <= end). A range is put into each slice of ``size`` it touches, so the join is on (on, slice); take ``size`` near
    the usual length of a range. Reversed ranges hold nothing; null bounds and times match nothing."""
    part = fresh_name([*points.columns, *ranges.columns], "__slice")
    spread = ranges.filter(F.col(start) <= F.col(end)).withColumn(part, F.explode(_slices(F.col(start), F.col(end), size)))
    return points.withColumn(part, F.floor(F.col(at) / size)).join(spread, [*on, part]).filter(F.col(at).between(F.col(start), F.col(end))).drop(part)


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_start: str, a_end: str, b_start: str, b_end: str, size: int) -> DataFrame:
    """Intervals of ``a`` with those of ``b`` that overlap them, ends included. Both are put into slices; a pair is kept only in the slice where its overlap begins, so it comes once."""
    part = fresh_name([*a.columns, *b.columns], "__slice")
    left = a.filter(F.col(a_start) <= F.col(a_end)).withColumn(part, F.explode(_slices(F.col(a_start), F.col(a_end), size)))
    right = b.filter(F.col(b_start) <= F.col(b_end)).withColumn(part, F.explode(_slices(F.col(b_start), F.col(b_end), size)))
    met = left.join(right, [*on, part]).filter((F.col(a_start) <= F.col(b_end)) & (F.col(b_start) <= F.col(a_end)))
    return met.filter(F.floor(F.greatest(a_start, b_start) / size) == F.col(part)).drop(part)


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, take: list[str]) -> DataFrame:
    """``left`` plus the columns ``take`` of the latest row of ``right`` with the same ``on`` and ``right_at`` <= ``left_at``, null where there is none. Of equal times the row greatest by
    ``take`` counts. Both sides are put in one order of time and a running maximum is carried along, so a hot key is spread like any other."""
    names = [*left.columns, *right.columns]
    at, seen, mine = (fresh_name(names, x) for x in ("__at", "__seen", "__left"))
    rows = left.withColumn(at, F.col(left_at)).withColumn(mine, F.lit(True))
    facts = right.filter(F.col(right_at).isNotNull()).select(*on, F.col(right_at).alias(at), F.lit(False).alias(mine), F.struct(F.col(right_at).alias("at"), *take).alias(seen))
    both = rows.unionByName(facts, allowMissingColumns=True)
    told = ordered.running(both, on, [at, mine], F.col(seen), f"{seen}_", "max")  # false before true: equal times are seen
    return told.filter(F.col(mine)).select(*left.columns, *(F.when(F.col(at).isNotNull(), F.col(f"{seen}_")[c]).alias(c) for c in take))
