"""Running decisions over event replays: caps, quotas, suppression, rate limits, debounce, slots and budgets.

Where every attempt counts, a decision is a running window. Where only accepted attempts count, unit costs still reduce to a rank;
weighted costs and slots are a true fold, done as a streaming pass over rows sorted by key and time that carries one number per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.runtime import fresh_name, repartition_for

DAY_MS = 86_400_000


def once(df: DataFrame, keys: list[str], event: str, ts: str, seq: str) -> DataFrame:
    """``df`` plus BOOLEAN ``counts``: whether the row is the first of its event id under its key (rows without id always count)."""
    at = fresh_name(df.columns, "__place")
    told = ordered.running(df, [*keys, event], [ts, seq], F.lit(1), at, "count")
    return told.withColumn("counts", F.col(event).isNull() | (F.col(at) == 1)).drop(at)


def _per_day(df: DataFrame, keys: list[str], ts: str, day: bool) -> tuple[DataFrame, list[str], list[str]]:
    """(rows with their UTC day if wanted, the keys of a running value, columns to drop afterwards)."""
    if not day:
        return df, keys, []
    name = fresh_name(df.columns, "__day")
    return df.withColumn(name, F.col(ts) - F.pmod(F.col(ts), F.lit(DAY_MS))), [*keys, name], [name]


def running_cap(df: DataFrame, keys: list[str], limit: int, ts: str = "ts_ms", seq: str = "seq", amount: Column | None = None, day: bool = True) -> DataFrame:
    """Increment, then compare: ``used`` is the (weighted) sum per key and UTC day up to and with the row, ``allowed`` is used <= limit."""
    rows, by, extra = _per_day(df, keys, ts, day)
    out = ordered.running(rows, by, [ts, seq], amount if amount is not None else F.lit(1), "used").drop(*extra)
    return out.withColumn("allowed", F.col("used") <= limit)


def accepted_cap(df: DataFrame, keys: list[str], limit: int, ts: str = "ts_ms", seq: str = "seq", day: bool = True) -> DataFrame:
    """Compare, then increment: a blocked attempt does not count, so exactly the first ``limit`` attempts are allowed."""
    rows, by, extra = _per_day(df, keys, ts, day)
    at = fresh_name(rows.columns, "__place")
    return ordered.running(rows, by, [ts, seq], F.lit(1), at, "count").withColumn("allowed", F.col(at) <= limit).drop(at, *extra)


def counted_impressions(df: DataFrame, keys: list[str], event: str, limit: int, ts: str = "ts_ms", seq: str = "seq") -> DataFrame:
    """A cap that counts every event id once: ``counts`` as :func:`once`, ``used`` the day's ids so far, ``allowed``."""
    return running_cap(once(df, keys, event, ts, seq), keys, limit, ts, seq, F.col("counts").cast("int"))


def trailing_count(df: DataFrame, keys: list[str], window_ms: int, ts: str = "ts_ms") -> DataFrame:
    """``df`` plus ``recent``: rows of the key within the trailing window, the row itself and equal times included."""
    return ordered.trailing(df, keys, ts, window_ms, F.lit(1), "recent")


def suppressed(df: DataFrame, keys: list[str], window_ms: int, threshold: int, ts: str = "ts_ms") -> DataFrame:
    return trailing_count(df, keys, window_ms, ts).withColumn("suppressed", F.col("recent") >= threshold)


def rate_limited(df: DataFrame, keys: list[str], window_ms: int, limit: int, ts: str = "ts_ms") -> DataFrame:
    return trailing_count(df, keys, window_ms, ts).withColumn("allowed", F.col("recent") <= limit)


def debounced(df: DataFrame, keys: list[str], quiet_ms: int, ts: str = "ts_ms", seq: str = "seq") -> DataFrame:
    """Allowed only after a quiet time; every attempt, allowed or not, restarts it."""
    before = fresh_name(df.columns, "__before")
    told = ordered.lagged(df, keys, [ts, seq], F.col(ts), before)
    return told.withColumn("allowed", F.col(before).isNull() | (F.col(ts) - F.col(before) > quiet_ms)).drop(before)


def trailing_distinct(df: DataFrame, keys: list[str], value: str, window_ms: int, ts: str = "ts_ms") -> DataFrame:
    """``df`` plus ``uniques``: distinct values of the key within the trailing window of each row (null is a value).

    An occurrence stands for its value until it leaves the window or the value comes again; so the number is a running sum of
    starts and ends, and no set is held for any row."""
    at, delta, real, again, back = (fresh_name(df.columns, x) for x in ("__at", "__delta", "__real", "__again", "__back"))

    def marked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows that start to count at their time, the times at which they stop)."""
        leaves = F.col(ts) + window_ms + 1
        ends = rows.select(*keys, F.least(leaves, F.coalesce(again, leaves)).alias(at), F.lit(-1).alias(delta), F.lit(False).alias(real))
        return rows.drop(again), ends

    def plain(rows: DataFrame) -> DataFrame:
        told, ends = marked(rows.withColumn(again, F.lead(ts).over(W.partitionBy(*keys, value).orderBy(ts))))
        both = told.withColumn(at, F.col(ts)).withColumn(delta, F.lit(1)).withColumn(real, F.lit(True)).unionByName(ends, allowMissingColumns=True)
        return both.withColumn("uniques", F.sum(delta).over(W.partitionBy(*keys).orderBy(at))).filter(real).drop(at, delta, real)

    def sliced(rows: DataFrame) -> DataFrame:
        later = ordered.lagged(rows.withColumn(back, -F.col(ts)), [*keys, value], [back], F.col(ts), again).drop(back)
        told, ends = marked(later)
        starts = told.select(*keys, F.col(ts).alias(at), F.lit(1).alias(delta), F.lit(False).alias(real))
        reads = told.withColumn(at, F.col(ts)).withColumn(real, F.lit(True))  # false before true: a row reads after all changes of its time
        both = reads.unionByName(starts.unionByName(ends), allowMissingColumns=True)
        return ordered.running(both, keys, [at, real], F.col(delta), "uniques").filter(real).drop(at, delta, real)

    return ordered.split_hot(df, keys, plain, sliced)


def pacing(spent: Column, target: Column) -> Column:
    """Delivery factor of spend against target: speed up below 95 %, slow down above 105 %, rounded to 3 places."""
    ratio = spent / target
    return F.round(F.when(ratio < 0.95, F.least(F.lit(2.0), 1 + (1 - ratio))).when(ratio > 1.05, F.greatest(F.lit(0.0), 1 - (ratio - 1))).otherwise(1.0), 3)


def remaining(limit: int, used: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(limit) - used)


def fold(df: DataFrame, keys: list[str], ts: str, seq: str, amount: str, step: Callable[[float, float], tuple[float, bool]], flag: str = "allowed", level: str = "level") -> DataFrame:
    """A sequential fold per key: ``step(level, amount)`` gives the next level and whether the row is allowed.

    Rows stream through the worker in key and time order; only the current key's level is held, so a key of any size fits. A null
    amount is 0. Keys are partitioned, so a single hot key is one task's sequential work, which no fold can avoid.
    """
    key = fresh_name(df.columns, "__key")
    tagged = df.withColumn(key, F.to_json(F.struct(*keys)))
    types = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, now = None, 0
        for batch in batches:
            flags, levels = [], []
            for k, a in zip(batch.column(key).to_pylist(), batch.column(amount).to_pylist()):
                if k != current:
                    current, now = k, 0
                now, ok = step(now, a or 0)
                flags.append(ok)
                levels.append(now)
            t = batch.drop_columns([key])
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(flags, pa.bool_()), pa.array(levels, pa.float64())], names=[*t.schema.names, flag, level])

    return repartition_for(tagged, key).sortWithinPartitions(key, ts, seq).mapInArrow(run, f"{types}, `{flag}` boolean, `{level}` double")


def budget_gate(df: DataFrame, keys: list[str], budget: float, amount: str, ts: str = "ts_ms", seq: str = "seq") -> DataFrame:
    """Charges that fit what is left of the budget; one that does not fit is refused and charges nothing."""
    return fold(df, keys, ts, seq, amount, lambda used, a: (used + a, True) if used + a <= budget else (used, False))


def slots(df: DataFrame, keys: list[str], limit: int, delta: str, ts: str = "ts_ms", seq: str = "seq") -> DataFrame:
    """A semaphore: +1 acquires if a slot is free, else is rolled back; -1 releases and never goes below zero."""
    return fold(df, keys, ts, seq, delta, lambda held, d: (held + d, True) if d < 0 and held + d >= 0 else ((0, True) if d < 0 else ((held + d, True) if held + d <= limit else (held, False))))


def last_instances(df: DataFrame, uid: str, last: int, top_k: int, features: str, ts: str = "ts_ms", where: Column | None = None, slot: int | None = None) -> DataFrame:
    """Per uid, the ``top_k`` features by total weight over its last instances that meet ``where`` (action, table and the like): ``features`` is
    ARRAY<STRUCT<id, v1>>, with ``slot`` in it if one slot is asked for."""
    kept = df if where is None else df.filter(where)
    recent = kept.withColumn("_n", F.row_number().over(W.partitionBy(uid).orderBy(F.col(ts).desc()))).filter(F.col("_n") <= last)
    flat = recent.select(uid, F.explode(features).alias("f"))
    flat = flat if slot is None else flat.filter(F.col("f.slot") == slot)
    sums = flat.groupBy(uid, F.col("f.id").alias("id")).agg(F.sum("f.v1").alias("total"))
    return sums.withColumn("_n", F.row_number().over(W.partitionBy(uid).orderBy(F.col("total").desc(), "id"))).filter(F.col("_n") <= top_k).drop("_n")
