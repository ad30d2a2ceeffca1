"""Bucketed counters, distinct sets, first/last selections, running reads and the roll-up ladder.

Increments are rows ``family, key, ts_ms, amount, seq``. A logical key is one series within its family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.runtime import cut

#: Roll-up levels in milliseconds, fine to coarse (fixed values).
LADDER = (1_000, 60_000, 3_600_000, 86_400_000)
#: Named precisions in milliseconds (fixed values).
PRECISION = {"1s": 1_000, "5s": 5_000, "10s": 10_000, "1m": 60_000, "5m": 300_000, "10m": 600_000, "1h": 3_600_000, "1d": 86_400_000, "30d": 2_592_000_000}
DEDUP_MS = 300_000


def bucket(ts: Column, precision_ms: int | None) -> Column:
    """Start of the bucket a time falls in; without precision the time itself."""
    return ts - ts % precision_ms if precision_ms else ts


def buckets(increments: DataFrame, precision_ms: int | None = None) -> DataFrame:
    """``family, key, bucket_ms, amount``: the additive state of every counter."""
    return increments.groupBy("family", "key", bucket(F.col("ts_ms"), precision_ms).alias("bucket_ms")).agg(F.sum("amount").alias("amount"))


def _value(aggregator: str) -> Column:
    known = {
        "events": F.count(F.lit(1)), "len": F.count(F.lit(1)), "min": F.min("amount"), "max": F.max("amount"), "first": F.min_by("amount", "bucket_ms"), "last": F.max_by("amount", "bucket_ms"),
    }
    return known.get(aggregator, F.sum("amount"))


def read(state: DataFrame, start_ms: int, end_ms: int, aggregator: str = "sum") -> DataFrame:
    """``family, key, value`` over buckets whose start lies in [start, end]. ``sum``, ``count`` and unknown names add amounts up; ``events``
    and ``len`` count buckets; ``min``, ``max``, ``first`` and ``last`` look at bucket amounts."""
    return read_many(state, start_ms, end_ms, [aggregator]).withColumnRenamed(aggregator, "value")


def read_many(state: DataFrame, start_ms: int, end_ms: int, aggregators: list[str]) -> DataFrame:
    """``family, key`` and a column for each of the aggregators of :func:`read`, in one pass."""
    return state.filter(F.col("bucket_ms").between(start_ms, end_ms)).groupBy("family", "key").agg(*(_value(a).alias(a) for a in aggregators))


def detail(state: DataFrame, start_ms: int, end_ms: int, count: int | None = None) -> DataFrame:
    """``family, key, bucket_ms, amount`` (amount as text) of the oldest ``count`` buckets in range per counter."""
    rows = state.filter(F.col("bucket_ms").between(start_ms, end_ms))
    if count is not None:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("family", "key").orderBy("bucket_ms"))).filter(F.col("_n") <= count).drop("_n")
    return rows.withColumn("amount", F.col("amount").cast("string"))


def distinct_values(changes: DataFrame, start_ms: int, end_ms: int, precision_ms: int | None = None) -> DataFrame:
    """``key, value``: exact number of distinct values of ``changes(key, ts_ms, value)`` over buckets that start in range."""
    rows = changes.withColumn("b", bucket(F.col("ts_ms"), precision_ms)).filter(F.col("b").between(start_ms, end_ms))
    return rows.select("key", "value").distinct().groupBy("key").agg(F.count("value").alias("value"))


def alive(state: DataFrame, increments: DataFrame, now_ms: int) -> DataFrame:
    """The state without the counters that have expired: a write with ``ttl_ms`` puts off the end of its whole counter to its time plus that; the last such write counts."""
    until = increments.groupBy("family", "key").agg(F.max_by(F.col("ts_ms") + F.col("ttl_ms"), F.when(F.col("ttl_ms").isNotNull(), F.col("seq"))).alias("_until"))
    return state.join(until.filter(F.col("_until") <= now_ms).select("family", "key"), ["family", "key"], "left_anti")


#: Distinct values of a bucket above which it is kept as a sketch.
SKETCH_ABOVE = 4_096


def distinct_mixed(changes: DataFrame, start_ms: int, end_ms: int, precision_ms: int, most: int = SKETCH_ABOVE, lg_k: int = 12) -> DataFrame:
    """``key, value, sketched``: distinct values over the buckets that start in [start, end]. Exact while every bucket holds at most ``most`` values; once one holds
    more it is a sketch, and all buckets of the key are merged into one estimate."""
    once = changes.select("key", bucket(F.col("ts_ms"), precision_ms).alias("b"), "value").filter(F.col("b").between(start_ms, end_ms) & F.col("value").isNotNull()).distinct()
    sizes = once.groupBy("key", "b").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.groupBy("key").agg((F.max("n") > most).alias("sketched"))
    exact = once.select("key", "value").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("exact"))
    rough = once.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("value", lg_k)).alias("rough"))
    return large.join(exact, "key").join(rough, "key").select("key", F.when(F.col("sketched"), F.col("rough")).otherwise(F.col("exact")).alias("value"), "sketched")


def distinct_sketches(changes: DataFrame, precision_ms: int, lg_k: int = 12) -> DataFrame:
    """``key, bucket_ms, sketch``: a mergeable HyperLogLog per bucket, for sets too large to keep."""
    return changes.groupBy("key", bucket(F.col("ts_ms"), precision_ms).alias("bucket_ms")).agg(F.hll_sketch_agg("value", lg_k).alias("sketch"))


def distinct_estimate(sketches: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """``key, value``: the estimate over a window, from the union of its buckets' sketches."""
    rows = sketches.filter(F.col("bucket_ms").between(start_ms, end_ms))
    return rows.groupBy("key").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("value"))


def select_first_last(writes: DataFrame, which: str) -> DataFrame:
    """``key, value, occur_time_ms`` of the first or last write by time of ``writes(key, value, occur_time_ms, seq)``; among equal
    times the earliest written stays."""
    at = F.struct(F.col("occur_time_ms"), F.col("seq") if which == "first" else -F.col("seq"))
    pick = F.min_by if which == "first" else F.max_by
    return writes.groupBy("key").agg(pick(F.struct("value", "occur_time_ms"), at).alias("r")).select("key", "r.value", "r.occur_time_ms")


def selection_at(writes: DataFrame, which: str, now_ms: int) -> DataFrame:
    """:func:`select_first_last` with expiry: a write at time 0 happened when it was made (``made_ms``), and one with ``ttl_ms`` above 0 puts off the end of its key; keys whose last such end has passed
    by ``now_ms`` have no value."""
    told = writes.withColumn("occur_time_ms", F.when(F.coalesce("occur_time_ms", F.lit(0)) == 0, F.col("made_ms")).otherwise(F.col("occur_time_ms")))
    until = told.filter("ttl_ms > 0").groupBy("key").agg(F.max_by(F.col("made_ms") + F.col("ttl_ms"), "seq").alias("_until"))
    return select_first_last(told, which).join(until.filter(F.col("_until") <= now_ms).select("key"), "key", "left_anti")


def set_and_get(increments: DataFrame, window_ms: int, precision_ms: int | None = None, uuid: str | None = None) -> DataFrame:
    """Every increment with ``value``: the counter's sum over the trailing window after it, in write order of equal times.

    With ``uuid`` a repeat of an id within five minutes of event time (batch replay has no processing time) adds nothing but still reads.
    Buckets count by their start, as everywhere. The trailing sum is a range window; within equal buckets, by ``seq``.
    """
    rows = increments.withColumn("_b", bucket(F.col("ts_ms"), precision_ms)).withColumn("_amount", F.col("amount"))
    if uuid:
        told = ordered.lagged(rows, ["family", "key", uuid], ["ts_ms", "seq"], F.col("ts_ms"), "_before")
        again = F.col(uuid).isNotNull() & F.col("_before").isNotNull() & (F.col("ts_ms") - F.col("_before") <= DEDUP_MS)
        rows = told.withColumn("_amount", F.when(again, 0).otherwise(F.col("amount"))).drop("_before")
    # all earlier buckets of the window, and the own bucket up to this row
    rows = ordered.trailing(rows, ["family", "key"], "_b", window_ms, F.col("_amount"), "_earlier", lag=1)
    rows = ordered.running(rows, ["family", "key", "_b"], ["ts_ms", "seq"], F.col("_amount"), "_own")
    return rows.withColumn("value", F.col("_earlier") + F.col("_own")).drop("_b", "_amount", "_earlier", "_own")


def manager(state: DataFrame, op: str, start_ms: int | None = None, end_ms: int | None = None, at: list[int] | None = None) -> DataFrame:
    """Maintenance reads by code: ``2`` values of given buckets, ``5`` bucket list as text, ``6`` bucket count, ``7`` everything,
    any other code a summary across families."""
    rows = state if start_ms is None else state.filter(F.col("bucket_ms").between(start_ms, end_ms))
    if op == "2":
        return rows.filter(F.col("bucket_ms").isin(at or []))
    if op == "5":
        return rows.groupBy("family", "key").agg(F.array_join(F.sort_array(F.collect_list("bucket_ms")).cast("array<string>"), ",").alias("fields"))
    if op == "6":
        return rows.groupBy("family", "key").agg(F.count(F.lit(1)).alias("fields"))
    if op == "7":
        return rows
    return rows.groupBy("key").agg(F.count_distinct("family").alias("families"), F.count(F.lit(1)).alias("buckets"), F.sum("amount").alias("total"))


def debug(state: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Per counter: buckets and sum overall and in the window, first and last bucket in the window; one pass."""
    inside = F.col("bucket_ms").between(start_ms, end_ms)
    return state.groupBy("family", "key").agg(
        F.count(F.lit(1)).alias("events"), F.sum("amount").alias("sum"), F.count_if(inside).alias("window_events"),
        F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0)).alias("window_sum"),
        F.min(F.when(inside, F.col("bucket_ms"))).alias("first_ms"), F.max(F.when(inside, F.col("bucket_ms"))).alias("last_ms"))


def ladder(increments: DataFrame) -> DataFrame:
    """``family, key, level_ms, bucket_ms, amount`` at every level. Each level is summed from the one below, which is checkpointed, so the raw rows are
    read and shuffled once whatever is asked of the result."""
    level, out = cut(buckets(increments, LADDER[0])), None
    for ms in LADDER:
        if ms != LADDER[0]:
            level = cut(level.groupBy("family", "key", bucket(F.col("bucket_ms"), ms).alias("bucket_ms")).agg(F.sum("amount").alias("amount")))
        cells = level.withColumn("level_ms", F.lit(ms).cast("bigint"))
        out = cells if out is None else out.unionByName(cells)
    return out.select("family", "key", "level_ms", "bucket_ms", "amount")


def cells_of(increments: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """The cells of the ladder that tile [start, end], ``level_ms`` 0 for raw edges, straight from the increments: one filtered scan and one aggregate,
    where no ladder is stored."""
    pieces = cover(start_ms, end_ms)
    ts, level = F.col("ts_ms"), F.when(F.lit(False), F.lit(0))
    for ms, a, b in pieces:
        level = level.when((ts >= a) & (ts < b), F.lit(ms))
    rows = increments.filter(ts.between(start_ms, end_ms)).withColumn("level_ms", level.cast("bigint"))
    at = F.when(F.col("level_ms") > 0, ts - F.pmod(ts, F.greatest(F.col("level_ms"), F.lit(1)))).otherwise(ts)
    return rows.groupBy("family", "key", "level_ms", at.alias("bucket_ms")).agg(F.sum("amount").alias("amount"))


def cover(start_ms: int, end_ms: int) -> list[tuple[int, int, int]]:
    """(level, first bucket, end) pieces that tile [start, end] with the coarsest whole buckets; level 0 pieces are raw edges."""
    pieces, lo, hi = [], start_ms, end_ms + 1
    if hi <= lo:
        return pieces

    def fill(a: int, b: int, levels: tuple[int, ...]) -> None:
        if a >= b:
            return
        if not levels:
            pieces.append((0, a, b))
            return
        ms = levels[-1]
        first, last = -(-a // ms) * ms, b // ms * ms
        if first >= last:
            fill(a, b, levels[:-1])
            return
        fill(a, first, levels[:-1])
        pieces.append((ms, first, last))
        fill(last, b, levels[:-1])

    fill(lo, hi, LADDER)
    return pieces


def window_sum(cells: DataFrame, increments: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """``family, key, value`` of a window sum read from the ladder: coarse cells inside, raw rows at the edges. Equals the plain sum."""
    parts = cover(start_ms, end_ms)
    inside, edge = F.lit(False), F.lit(False)
    for level, a, b in parts:
        if level:
            inside = inside | ((F.col("level_ms") == level) & (F.col("bucket_ms") >= a) & (F.col("bucket_ms") < b))
        else:
            edge = edge | ((F.col("ts_ms") >= a) & (F.col("ts_ms") < b))
    both = cells.filter(inside).select("family", "key", "amount").unionByName(increments.filter(edge).select("family", "key", "amount"))
    return both.groupBy("family", "key").agg(F.sum("amount").alias("value"))


def long_window(increments: DataFrame, start_ms: int, now_ms: int, precision_ms: int) -> DataFrame:
    """``family, key, count, sum, min, max, avg`` over sealed buckets from ``start_ms`` plus the raw tail since the last bucket edge.

    Sealed buckets enter min and max by their sums; avg floors. ``count`` adds amounts on the sealed side and rows in the tail.
    """
    tail = now_ms // precision_ms * precision_ms
    sealed = buckets(increments.filter((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < tail)), precision_ms).select("family", "key", "amount", F.col("amount").alias("n"))
    raw = increments.filter(F.col("ts_ms").between(tail, now_ms)).select("family", "key", "amount", F.lit(1).cast("bigint").alias("n"))
    return sealed.unionByName(raw).groupBy("family", "key").agg(
        F.sum("n").alias("count"), F.sum("amount").alias("sum"), F.min("amount").alias("min"), F.max("amount").alias("max"),
        F.floor(F.sum("amount").cast("decimal(38,0)") / F.nullif(F.sum("n"), F.lit(0)).cast("decimal(38,0)")).cast("bigint").alias("avg"))
