"""Feature series: per key, time-ordered points ``key, ts_ms, value, seq`` (one point per key and time; ``seq`` is write order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_POINTS = 10_000
#: Points of one key beyond which a write is refused (fixed value).
REFUSE_ABOVE = 100_000


def numeric(value: Column) -> Column:
    """The value as BIGINT if it is a decimal integer with optional leading white space and sign, else null."""
    return F.when(value.rlike(r"^\s*[+-]?[0-9]+$"), value.try_cast("bigint"))


def _latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key combination: that of the highest ``seq`` (map-side combined, so hot keys do not travel)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("r")).select(*keys, *(F.col("r")[c].alias(c) for c in rest)).select(*df.columns)


def _earliest(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("seq")).alias("r")).select(*keys, *(F.col("r")[c].alias(c) for c in rest)).select(*df.columns)


def append(series: DataFrame, new: DataFrame, policy: str = "upsert", max_points: int | None = MAX_POINTS) -> DataFrame:
    """The series after a write. ``upsert``: the last write of a time wins. ``first``: existing points and the first of a batch stay.
    ``update``: only existing times change. ``block`` is refused. Then the oldest points beyond ``max_points`` per key go."""
    key = ["key", "ts_ms"]
    if policy == "upsert":
        out = _latest(series.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(new), key) if series is not None else _latest(new, key)
    elif policy == "first":
        out = series.unionByName(_earliest(new, key).join(series.select(*key), key, "left_anti"))
    elif policy == "update":
        changed = _latest(new, key).join(series.select(*key), key, "left_semi")
        out = series.join(changed.select(*key), key, "left_anti").unionByName(changed)
    else:
        raise ValueError(f"write policy {policy!r} is not accepted")
    return trim(out, max_points) if max_points else out


def refused(series: DataFrame | None, new: DataFrame, most: int = REFUSE_ABOVE) -> DataFrame:
    """``key, points`` of the keys whose write is refused: with it they would hold more than ``most`` times."""
    key = ["key", "ts_ms"]
    both = new.select(*key) if series is None else series.select(*key).unionByName(new.select(*key)).join(new.select("key").distinct(), "key", "left_semi")
    return both.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") > most)


def trim(series: DataFrame, max_points: int = MAX_POINTS) -> DataFrame:
    """The newest ``max_points`` points of each key. The rank filter is pushed below the shuffle as a group limit."""
    w = W.partitionBy("key").orderBy(F.col("ts_ms").desc())
    return series.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_points).drop("_n")


def window(series: DataFrame, start_ms: int, end_ms: int, count: int | None = None) -> DataFrame:
    """Points with start <= ts <= end, the oldest ``count`` per key; reversed bounds give nothing."""
    rows = series.filter(F.col("ts_ms").between(start_ms, end_ms))
    if count is None:
        return rows
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("ts_ms"))).filter(F.col("_n") <= count).drop("_n")


def window_filtered(series: DataFrame, start_ms: int, end_ms: int, count: int, condition: Column) -> DataFrame:
    """As :func:`window`, then ``condition``: the limit counts scanned points, not matching ones."""
    return window(series, start_ms, end_ms, count).filter(condition)


def replace(series: DataFrame, start_ms: int, end_ms: int, new: DataFrame, max_points: int = MAX_POINTS) -> DataFrame:
    """The keys of ``new`` lose their points in [start, end] and take the new ones (which may lie outside)."""
    keys = new.select("key").distinct().withColumn("_touched", F.lit(True))
    gone = F.coalesce(F.col("_touched"), F.lit(False)) & F.col("ts_ms").between(start_ms, end_ms)
    kept = series.join(keys, "key", "left").filter(~gone).drop("_touched")
    return append(kept, new, "upsert", max_points)


def delete(series: DataFrame, keys: DataFrame) -> DataFrame:
    """The series without the given keys."""
    return series.join(keys.select("key").distinct(), "key", "left_anti")


AGGREGATORS = ["sum", "avg", "min", "max", "first", "last", "count"]
ALIASES = {"average": "avg", "events": "count"}


def aggregates(series: DataFrame, start_ms: int, end_ms: int, count: int | None = None) -> DataFrame:
    """``key, sum, avg, min, max, first, last, count`` over the window, all BIGINT.

    Values that are no integers are skipped by sum, avg, min and max but counted by count; avg truncates toward zero; first and last are
    positional and 0 where the boundary value is no integer. Keys without points in the window have no row (see :func:`for_keys`).
    """
    v = numeric(F.col("value"))
    rows = window(series, start_ms, end_ms, count).withColumn("_v", v)
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.groupBy("key").agg(
        z(F.sum("_v")).alias("sum"), z(F.expr("sum(_v) div nullif(count(_v), 0)")).alias("avg"), z(F.min("_v")).alias("min"), z(F.max("_v")).alias("max"),
        z(F.min_by("_v", "ts_ms")).alias("first"), z(F.max_by("_v", "ts_ms")).alias("last"), F.count(F.lit(1)).alias("count"))


def aggregate(series: DataFrame, start_ms: int, end_ms: int, aggregator: str, count: int | None = None) -> DataFrame:
    """``key, value`` of one aggregator; a name that is not known counts."""
    name = ALIASES.get(aggregator, aggregator)
    return aggregates(series, start_ms, end_ms, count).select("key", F.col(name if name in AGGREGATORS else "count").alias("value"))


def for_keys(result: DataFrame, keys: DataFrame) -> DataFrame:
    """``result`` for exactly the given keys: 0 where a key has nothing."""
    return keys.select("key").distinct().join(result, "key", "left").na.fill(0)
