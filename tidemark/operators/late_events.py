"""Per-period aggregates by event time, corrected as late rows arrive.

State is a value-count multiset per (group, period): rows ``(tenant, hour_ms, value, n)``. A batch, however
late, adds its counts to the state; every statistic (count, mean, exact median, distinct values, extremes) is
re-derived from cumulative counts. The state is itself a plain additive aggregate, so a hot tenant-hour is
combined map-side before any shuffle, and replays of batches in any order give the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import cut

HOUR_MS = 3_600_000
LATENESS_MS = 21_600_000


def in_ms(c: Column) -> Column:
    """An epoch time of unknown unit in milliseconds. The unit follows from the magnitude: below 1e11 seconds,
    below 1e14 milliseconds, below 1e17 microseconds, else nanoseconds. Null stays null."""
    return (
        F.when(F.abs(c) < 100_000_000_000, c * 1000)
        .when(F.abs(c) < 100_000_000_000_000, c)
        .when(F.abs(c) < 100_000_000_000_000_000, F.floor(c / 1000))
        .otherwise(F.floor(c / 1_000_000))
        .cast("bigint")
    )


def _time(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(0))


def happened_ms(ts: str = "ts_ms", fallbacks: tuple[str, ...] = ("hook_observed_at_ms", "created_at_ms")) -> Column:
    """When a row happened: ``ts`` with its unit put right, else the first fallback that is neither null nor 0."""
    return F.coalesce(in_ms(_time(ts)), *(_time(c) for c in fallbacks))


def with_period(df: DataFrame, arrived: str = "ingestion_time_ms", period_ms: int = HOUR_MS, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """``df`` plus ``happened_ms``, ``hour_ms`` (start of the period; null without a time) and ``set_aside``.

    A row is set aside when it arrives more than ``lateness_ms`` after the end of its period. Rows without a time
    of happening, or whose arrival is null or 0, are not set aside; the former belong to no period.
    """
    out = df.withColumn("happened_ms", happened_ms())
    out = out.withColumn("hour_ms", F.col("happened_ms") - F.pmod("happened_ms", F.lit(period_ms)))
    return out.withColumn("set_aside", F.coalesce(_time(arrived) - (F.col("hour_ms") + period_ms) > lateness_ms, F.lit(False)))


def multiset(rows: DataFrame, value: str = "importance") -> DataFrame:
    """Value counts ``tenant, hour_ms, value, n`` of the rows that belong to a period. A null value is counted as
    its own entry (it takes part in the row count, not in the statistics); NaN is treated as null; values are FLOAT."""
    v = F.nullif(F.col(value).cast("float"), F.lit(float("nan")).cast("float"))
    return rows.filter(F.col("hour_ms").isNotNull()).groupBy("tenant", "hour_ms", v.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def apply_batch(state: DataFrame, batch: DataFrame, value: str = "importance", sign: int = 1) -> DataFrame:
    """The state after a batch of accepted rows (``sign`` -1 takes a batch back). Empty counts leave the state."""
    delta = multiset(batch, value).withColumn("n", F.col("n") * sign)
    return state.unionByName(delta).groupBy("tenant", "hour_ms", "value").agg(F.sum("n").alias("n")).filter("n <> 0")


def statistics(state: DataFrame, median: bool = True) -> DataFrame:
    """``tenant, hour_ms, n_events, mean_value, n_distinct, min_value, max_value`` and, if asked for, ``median_value`` of every period.

    All but the median is one aggregate over the multiset. The median is the lower middle element; it is found in two steps, so
    that no task sorts all values of a period: cumulative counts over at most 65,536 slices of the value range, then over the
    distinct values of the one slice that holds the middle. For it the state is written once and read twice.
    """
    period = ["tenant", "hour_ms"]
    if median:
        state = cut(state)
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    stats = state.groupBy(*period).agg(
        F.sum("n").alias("n_events"), (F.sum(F.col("value").cast("double") * F.col("n")) / F.sum(known)).alias("mean_value"),
        F.count("value").alias("n_distinct"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    if not median:
        return stats
    sliced = state.filter(F.col("value").isNotNull()).withColumn("slice", _slice(F.col("value")))
    coarse = sliced.groupBy(*period, "slice").agg(F.sum("n").alias("n"))
    target = F.floor((F.sum("n").over(W.partitionBy(*period)) + 1) / 2)
    middle = (
        coarse.withColumn("upto", F.sum("n").over(W.partitionBy(*period).orderBy("slice"))).withColumn("target", target)
        .filter((F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("n") < F.col("target")))
        .select(*period, "slice", (F.col("target") - (F.col("upto") - F.col("n"))).alias("left_"))
    )
    fine = F.sum("n").over(W.partitionBy(*period, "slice").orderBy("value"))
    medians = (
        sliced.join(middle, [*period, "slice"]).withColumn("upto", fine)
        .filter((F.col("upto") >= F.col("left_")) & (F.col("upto") - F.col("n") < F.col("left_")))
        .select(*period, F.col("value").alias("median_value"))
    )
    return stats.join(medians, period, "left")


def _slice(value: Column) -> Column:
    """One of 65,536 slices, monotone in ``value``: x / (1 + |x|) maps all finite and infinite values onto [-1, 1]."""
    d = value.cast("double")
    squeezed = F.when(F.abs(d) == float("inf"), F.signum(d)).otherwise(d / (F.abs(d) + 1.0))
    return F.least(F.floor((squeezed + 1.0) * 32768), F.lit(65535)).cast("int")
