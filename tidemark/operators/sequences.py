"""Typed event sequences ``key, ts_ms, gid, action_type, duration, author_id``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ("gid", "action_type", "duration", "author_id")
_FILTER = re.compile(r"\s*(\w+)\s*(!=|>=|<=|=|>|<)\s*(-?\d+)\s*$")
_OPS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
}


def parse_filters(texts: list[str]) -> list[tuple[str, str, int]]:
    """``field op value`` filters; a later filter on a field replaces the earlier one."""
    out: dict[str, tuple[str, str, int]] = {}
    for text in texts:
        if not (m := _FILTER.match(text)):
            raise ValueError(f"not a filter: {text!r}")
        out[m[1]] = (m[1], m[2], int(m[3]))
    return list(out.values())


def condition(filters: list[tuple[str, str, int]]) -> Column:
    """All filters at once; a field that does not exist matches nothing."""
    parts = [_OPS[op](F.col(field), F.lit(value)) if field in FIELDS else F.lit(False) for field, op, value in filters]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def query(rows: DataFrame, start_ms: int, end_ms: int, count: int, filters: list[tuple[str, str, int]] = ()) -> DataFrame:
    """Per key the oldest ``count`` rows with start <= ts <= end, then the filters: the limit counts scanned rows."""
    w = W.partitionBy("key").orderBy("ts_ms", "gid")
    scanned = rows.filter(F.col("ts_ms").between(start_ms, end_ms)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= count)
    return scanned.drop("_n").filter(condition(list(filters)))


def batch_query(rows: DataFrame, specs: DataFrame, slice_ms: int = 86_400_000) -> DataFrame:
    """Many windows at once. ``specs`` has ``spec_id, key, start_ms, end_ms, count`` and optionally ``min_duration``; the result has the
    rows of each spec with ``spec_id``. A spec is put into every slice of time it touches, so the equi-join on (key, slice) brings together only what lies near, also for a
    hot key; the range is checked exactly afterwards. The scan limit is per spec, the filter after it."""
    slices = F.sequence(F.floor(F.col("start_ms") / slice_ms), F.greatest(F.floor(F.col("end_ms") / slice_ms), F.floor(F.col("start_ms") / slice_ms)))
    spread = specs.withColumn("_slice", F.explode(slices))
    hit = rows.withColumn("_slice", F.floor(F.col("ts_ms") / slice_ms)).join(spread, ["key", "_slice"]).filter(F.col("ts_ms").between(F.col("start_ms"), F.col("end_ms")))
    w = W.partitionBy("spec_id").orderBy("ts_ms", "gid")
    out = hit.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= F.col("count"))
    if "min_duration" in specs.columns:
        out = out.filter(F.col("min_duration").isNull() | (F.col("duration") >= F.col("min_duration")))
    return out.select("spec_id", *rows.columns)
