"""Running values and predecessors within keys, where one key may hold any share of the rows.

A window puts all rows of a key into one task. Keys of up to ``HOT_ROWS`` rows are served that way. The few above it (at most one per ``HOT_ROWS`` rows)
are range-partitioned by (key, order) into slices, each slice is run by itself, and what the slices before it leave is added: a key crosses a slice's edge
only at its first and last rows, so these carries are at most two rows a slice and are broadcast. Both ways give the same values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import cut, fresh_name

#: Rows of one key above which it is spread over slices.
HOT_ROWS = 1_000_000


def split_hot(df: DataFrame, by: list[str], plain, sliced) -> DataFrame:
    """``plain`` over the rows of ordinary keys, ``sliced`` over those of hot ones."""
    far = [fresh_name(df.columns, f"__{c}") for c in by]
    hot = df.groupBy(*(F.col(c).alias(f) for c, f in zip(by, far))).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > HOT_ROWS).drop("__rows")
    if hot.isEmpty():
        return plain(df)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f)) for c, f in zip(by, far)])
    hot = F.broadcast(hot)
    cold = plain(df.join(hot, same, "left_anti"))
    return cold.unionByName(sliced(df.join(hot, same, "left_semi")).select(*cold.columns))


def _slices(df: DataFrame, by: list[str], order: list) -> tuple[DataFrame, str]:
    part = fresh_name(df.columns, "__slice")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *by, *order).withColumn(part, F.spark_partition_id())), part


def _carried(rows: DataFrame, ends: DataFrame, by: list[str], part: str, carry: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the carry of its (key, slice) out of ``ends`` (a row for each); keys within one slice have none."""
    far = [fresh_name([*rows.columns, name], f"__{c}") for c in [*by, part]]
    many = F.count(F.lit(1)).over(W.partitionBy(*by))
    told = ends.withColumn("__many", many).withColumn(name, carry).filter("__many > 1").select(*(F.col(c).alias(f) for c, f in zip([*by, part], far)), name)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f)) for c, f in zip([*by, part], far)])
    return rows.join(F.broadcast(told), same, "left").drop(*far)  # at most two rows a slice


def running(df: DataFrame, by: list[str], order: list, amount: Column, name: str, how: str = "sum", inclusive: bool = True) -> DataFrame:
    """``df`` plus ``name``: the sum, count or maximum of ``amount`` over the rows of the same ``by`` up to the row in ``order`` (without it: ``inclusive=False``). Null
    where there is none (a count is 0). Equal places in ``order`` are taken in any order; end it in a unique column."""
    total = {"sum": F.sum, "max": F.max, "count": F.count}[how]
    add = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": lambda a, b: F.greatest(a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}[how]
    until = W.currentRow if inclusive else -1

    def over(rows: DataFrame, keys: list[str]) -> Column:
        return total(amount).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, until))

    def sliced(rows: DataFrame) -> DataFrame:
        placed, part = _slices(rows, by, order)
        ends = placed.groupBy(*by, part).agg(total(amount).alias("__total"))
        before = {"sum": F.sum, "max": F.max, "count": F.sum}[how]("__total").over(W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
        inner = placed.withColumn(name, over(placed, [*by, part]))
        return _carried(inner, ends, by, part, before, "__carry").withColumn(name, add(F.col(name), F.col("__carry"))).drop("__carry", part)

    return split_hot(df, by, lambda rows: rows.withColumn(name, over(rows, by)), sliced)


def lagged(df: DataFrame, by: list[str], order: list, value: Column, name: str) -> DataFrame:
    """``df`` plus ``name``: ``value`` of the row before in ``order`` within the same ``by``, null for the first."""

    def over(keys: list[str]) -> Column:
        return F.lag(value).over(W.partitionBy(*keys).orderBy(*order))

    def sliced(rows: DataFrame) -> DataFrame:
        placed, part = _slices(rows, by, order)
        key = F.struct(*(c if isinstance(c, Column) else F.col(c) for c in order))
        ends = placed.groupBy(*by, part).agg(F.max_by(F.struct(value.alias("v")), key).alias("__last"))
        before = F.lag("__last").over(W.partitionBy(*by).orderBy(part))
        first = fresh_name(placed.columns, "__first")
        inner = placed.withColumn(name, over([*by, part])).withColumn(first, F.row_number().over(W.partitionBy(*by, part).orderBy(*order)) == 1)
        return _carried(inner, ends, by, part, before, "__carry").withColumn(name, F.when(F.col(first), F.col("__carry.v")).otherwise(F.col(name))).drop("__carry", part, first)

    return split_hot(df, by, lambda rows: rows.withColumn(name, over(by)), sliced)


def trailing(df: DataFrame, by: list[str], ts: str, window: int, amount: Column, name: str, lag: int = 0) -> DataFrame:
    """``df`` plus ``name``: the sum of ``amount`` over the rows of the same ``by`` with ``ts`` in [ts - window, ts - lag] of the row; 0 where there is none.

    For a hot key every row enters at its time, leaves after the window, and reads what is in: a running sum over three rows each."""

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.coalesce(F.sum(amount).over(W.partitionBy(*by).orderBy(ts).rangeBetween(-window, -lag)), F.lit(0)))

    def sliced(rows: DataFrame) -> DataFrame:
        at, kind, change = (fresh_name([*rows.columns, name], x) for x in ("__at", "__kind", "__change"))
        enters = rows.select(*by, F.col(ts).alias(at), F.lit(0).alias(kind), amount.alias(change))
        leaves = rows.select(*by, (F.col(ts) + window - lag + 1).alias(at), F.lit(0).alias(kind), (-amount).alias(change))
        reads = rows.withColumn(at, F.col(ts) - lag).withColumn(kind, F.lit(1))
        told = running(reads.unionByName(enters.unionByName(leaves), allowMissingColumns=True), by, [at, kind], F.col(change), name)
        return told.filter(F.col(kind) == 1).withColumn(name, F.coalesce(name, F.lit(0))).drop(at, kind, change)

    return split_hot(df, by, plain, sliced)
