"""One ranking out of several scores of different scales: a rank-walk Markov chain.

From an item, pick one of the scores at random and jump to an item that this score ranks strictly higher, uniformly; at a
score's top, stay. With damping, the stationary probability orders the items. Only the order within each score matters, so
neither ranges nor units nor heavy tails weigh. With each score sorted, one step of the walk is a prefix sum per score, so a
step costs time linear in the number of items. Each step brings the weights closer to the stationary ones by the factor
``damping`` (sum of absolute differences), so the number of steps follows from the error allowed and needs no test of convergence.

Groups of ordinary size are walked many at a time as flat arrays with segment boundaries; those above ``large`` items, which no task should
hold, are all walked at once by Spark, each step as prefix sums over slices of (group, score, rank). Both give the same weights and
places: weights are compared relative to the group's mean weight, so large groups are told apart as finely as small ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import cut, fresh_name, repartition_for

DAMPING = 0.85
#: Largest sum of absolute differences between the weights and the stationary ones.
ERROR = 1e-5
#: Decimals of a weight, in units of its group's mean, that decide between items.
DECIMALS = 9
#: Items with one value of a score beyond which their rows are salted, and into how many parts.
HOT, SALTS = 100_000, 32


def steps_for(error: float = ERROR, damping: float = DAMPING) -> int:
    """Steps after which a walk from equal weights is within ``error`` of the stationary weights (the first difference is at most 2)."""
    return math.ceil(math.log(error / 2) / math.log(damping))


STEPS = steps_for()


def _sides(values: np.ndarray, group: np.ndarray, base: np.ndarray, size: np.ndarray):
    """For one score: the order (best first within each group), the number of strictly higher items of each row, and
    the positions in that order where the row's ties begin and end."""
    low = np.isnan(values)
    order = np.lexsort((np.where(low, 0.0, -values), low, group))
    v, g, z = values[order], group[order], low[order]
    new = np.ones(len(v), bool)
    new[1:] = (g[1:] != g[:-1]) | ((v[1:] != v[:-1]) & ~(z[1:] & z[:-1]))
    starts = np.flatnonzero(new)
    block = np.cumsum(new) - 1
    ends = np.append(starts[1:], len(v))
    begin, end = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    begin[order], end[order] = starts[block], ends[block]
    return order, begin - base, begin, end, size


def walk(group: np.ndarray, scores: list[np.ndarray], damping: float = DAMPING, steps: int = STEPS):
    """Stationary weight of each item, and per score the number of strictly higher items and of items with its value (0 for NaN).

    ``group`` holds group numbers in ascending runs; NaN is below every value."""
    n = len(group)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    sizes = np.diff(np.append(starts, n))
    base, size = starts[run], sizes[run]
    last = base + size
    sides = [_sides(s, group, base, size) for s in scores]
    pi = 1.0 / size
    for _ in range(steps):
        flow = np.zeros(n)
        for order, higher, _, end, _ in sides:
            with np.errstate(divide="ignore"):
                sent = np.where(higher > 0, pi / np.maximum(higher, 1), 0.0)
            total = np.concatenate([[0.0], np.cumsum(sent[order])])
            flow += total[last] - total[end] + np.where(higher == 0, pi, 0.0)
        pi = damping * flow / len(scores) + (1 - damping) / size
    return pi, [(higher, np.where(np.isnan(s), 0, end - begin)) for s, (_, higher, begin, end, _) in zip(scores, sides)]


def _walk_groups(group: str, item: str, scores: list[str], damping: float, steps: int):
    names = [group, item, "weight", "place", *(f"{s}_higher" for s in scores), *(f"{s}_tied" for s in scores)]

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        again = ~_differs(t[group]) & ~_differs(t[item])
        t = t.filter(pa.array(np.concatenate([[True], ~again])))  # rows come sorted, an item's best row first
        g = t[group].combine_chunks()
        codes = np.cumsum(np.concatenate([[0], _differs(g)]))
        values = [t[s].to_numpy(zero_copy_only=False).astype(float) for s in scores]
        pi, sides = walk(codes, values, damping, steps)
        # a stable order: weight first (relative to the mean and rounded, so that the last bits of a sum decide nothing), then the item
        ids = pc.rank(t[item].combine_chunks(), tiebreaker="dense").to_numpy()
        sizes = np.bincount(codes)
        order = np.lexsort((ids, -np.round(pi * sizes[codes], DECIMALS), codes))
        start = np.concatenate([[True], codes[1:] != codes[:-1]])
        at = np.maximum.accumulate(np.where(start, np.arange(len(codes)), 0))
        place = np.empty(len(codes), np.int64)
        place[order] = np.arange(len(codes)) - at + 1
        cols = [g, t[item].combine_chunks(), pa.array(pi), pa.array(place), *(pa.array(h) for h, _ in sides), *(pa.array(k) for _, k in sides)]
        yield from pa.Table.from_arrays(cols, names=names).to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 100_000:  # whole groups only: the last one stays for the next round
                t = pa.Table.from_batches(held)
                cuts = np.flatnonzero(_differs(t[group].combine_chunks()))
                if len(cuts):
                    k = int(cuts[-1]) + 1
                    yield from out(t.slice(0, k))
                    held, rows = t.slice(k).to_batches(), t.num_rows - k
        if rows:
            yield from out(pa.Table.from_batches(held))

    return run


def _differs(a: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it (there are no nulls)."""
    return pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False)


def rank_walk(df: DataFrame, group: str, item: str, scores: list[str], large: int = 1_000_000, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """``group, item, weight, place`` and, per score, ``<score>_higher`` (items strictly above it) and
    ``<score>_tied`` (items with its value, itself included; 0 for a null) of every item.

    ``place`` is 1 for the item that comes first; equal weights are settled by ``item``, ascending. Null and NaN scores rank
    below every value and tie with one another. Rows repeated for an item count once (of differing rows the one with the
    highest scores, taken in the order given). Rows with a null group or item are left out. Other columns are ignored.
    """
    n = len(scores)
    inner = [f"s{i}" for i in range(n)]
    clean = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).alias("g"), F.col(item).alias("i"), *(F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")).alias(x) for s, x in zip(scores, inner)))
    big = clean.groupBy("g").count().filter(F.col("count") > large).select("g")
    some = not big.isEmpty()
    kinds = dict(clean.dtypes)
    cols = [f"g {kinds['g']}", f"i {kinds['i']}", "weight double", "place bigint", *(f"{s}_higher bigint" for s in inner), *(f"{s}_tied bigint" for s in inner)]
    small = clean.join(big, "g", "left_anti") if some else clean
    flat = repartition_for(small, "g").sortWithinPartitions("g", "i", *(F.col(s).desc_nulls_last() for s in inner)).mapInArrow(_walk_groups("g", "i", inner, damping, steps), ", ".join(cols))
    if some:
        once = clean.join(big, "g", "left_semi").groupBy("g", "i").agg(F.max(F.struct(*inner)).alias("s")).select("g", "i", *(F.col("s")[s].alias(s) for s in inner))
        flat = flat.unionByName(_walk_large(once, inner, damping, steps).select(*flat.columns))
    given = [group, item]
    return flat.select(
        F.col("g").alias(group), F.col("i").alias(item), F.col("weight").alias(fresh_name(given, "weight")), F.col("place").alias(fresh_name(given, "place")),
        *(F.col(f"{x}_{k}").alias(fresh_name(given, f"{s}_{k}")) for s, x in zip(scores, inner) for k in ("higher", "tied")))


def _prefix(df: DataFrame, by: list[str], order: list, total: str, amount: str) -> DataFrame:
    """``df`` plus ``total``: the sum of ``amount`` over all rows of the same ``by`` before in ``order``, without one task seeing all rows.

    Rows are range-partitioned into slices; a slice's own running sum is added to the sums of the slices before it, one row for each slice and
    value of ``by``."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(slices, *by, *order).withColumn("__slice", F.spark_partition_id()))
    sums = placed.groupBy(*by, "__slice").agg(F.sum(amount).alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(W.partitionBy(*by).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).drop("__sum")
    inner = F.coalesce(F.sum(amount).over(W.partitionBy(*by, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return placed.withColumn("__inner", inner).join(before, [*by, "__slice"]).withColumn(total, F.col("__inner") + F.col("__before")).drop("__slice", "__inner", "__before")


def _walk_large(df: DataFrame, scores: list[str], damping: float, steps: int) -> DataFrame:
    """The walk over all groups ``g`` too large for a task. Each item's ranks are fixed once; a step sums what the items of one rank send, takes prefix sums
    of these by (group, score, rank), and hands every item what lower ranks sent. Items that share a rank may be many (nulls): beyond ``HOT``
    of them their rows are salted and the rank's sum is sent to every salt."""
    n = F.col("__n")
    values = df.select("g", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(s).alias("v")) for k, s in enumerate(scores)))).alias("e")).select("g", "e.k", "e.v")
    sizes = values.groupBy("g", "k", "v").agg(F.count(F.lit(1)).cast("double").alias("tied"))
    heads = _prefix(sizes, ["g", "k"], [F.col("v").desc_nulls_last()], "higher", "tied")
    heads = cut(heads.withColumn("salts", F.when(F.col("tied") > HOT, SALTS).otherwise(1)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))))
    hot = heads.filter("salts > 1").select("g", "k", "v").distinct()
    ranked = df.join(df.groupBy("g").agg(F.count(F.lit(1)).alias("__n")), "g")
    own = F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")
    for k, s in enumerate(scores):
        mine = hot.filter(F.col("k") == k).select(F.col("g").alias("hg"), F.col("v").alias("hv"), F.lit(True).alias("__hot"))  # at most a row per HOT items
        ranked = ranked.join(mine, (F.col("g") == F.col("hg")) & F.col(s).eqNullSafe(F.col("hv")), "left").withColumn(f"{s}_salt", F.when(F.col("__hot"), own).otherwise(0)).drop("hg", "hv", "__hot")
        h = heads.filter(F.col("k") == k).select(F.col("g").alias("hg"), F.col("v").alias("hv"), F.col("salt").alias("hs"), F.col("higher").cast("bigint").alias(f"{s}_higher"), F.when(F.col("v").isNull(), 0).otherwise(F.col("tied")).cast("bigint").alias(f"{s}_tied"))
        ranked = ranked.join(h, (F.col("g") == F.col("hg")) & F.col(s).eqNullSafe(F.col("hv")) & (F.col(f"{s}_salt") == F.col("hs"))).drop("hg", "hv", "hs")
    keep = ["g", "i", "__n", *(f"{s}_{x}" for s in scores for x in ("higher", "tied", "salt"))]
    state = cut(ranked.select(*keep, (F.lit(1.0) / n).alias("weight")))
    for _ in range(steps):
        sent = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"{s}_higher").alias("h"), F.col(f"{s}_salt").alias("salt"), F.when(F.col(f"{s}_higher") > 0, F.col("weight") / F.col(f"{s}_higher")).otherwise(0.0).alias("a")) for k, s in enumerate(scores)))
        ranks = state.select("g", F.explode(sent).alias("e")).select("g", "e.*").groupBy("g", "k", "h").agg(F.sum("a").alias("a"), F.max("salt").alias("top"))
        got = cut(_prefix(ranks, ["g", "k"], [F.col("h").desc()], "got", "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("top") > 0, SALTS - 1).otherwise(0)))).select("g", "k", "h", "salt", "got"))
        out = state.withColumn("__flow", F.lit(0.0))
        for k, s in enumerate(scores):
            h, part = F.col(f"{s}_higher"), got.filter(F.col("k") == k).select(F.col("g").alias("hg"), F.col("h").alias("hh"), F.col("salt").alias("hs"), "got")
            out = out.join(part, (F.col("g") == F.col("hg")) & (h == F.col("hh")) & (F.col(f"{s}_salt") == F.col("hs"))).withColumn("__flow", F.col("__flow") + F.col("got") + F.when(h == 0, F.col("weight")).otherwise(0.0)).drop("hg", "hh", "hs", "got")
        state = cut(out.select(*keep, (damping * F.col("__flow") / len(scores) + (1 - damping) / n).alias("weight")))
    ones = state.withColumn("__w", F.round(F.col("weight") * n, DECIMALS)).withColumn("__one", F.lit(1.0))
    return _prefix(ones, ["g"], [F.col("__w").desc(), F.col("i")], "__place", "__one").withColumn("place", (F.col("__place") + 1).cast("bigint"))


def always_first(ranked: DataFrame, scores: list[str]) -> DataFrame:
    """Of a :func:`rank_walk` result, the items that come first whatever the scores' weights: alone at the top of all scores but
    at most one, and with at most one item higher in each.

    Read from the counts alone; the walk may place such an item lower, where one item stands above a long tie in the score left.
    With three scores or more at most one item of a group fits; with fewer it must be alone at the top of all."""
    alone = sum(((F.col(f"{s}_higher") == 0) & (F.col(f"{s}_tied") == 1)).cast("int") for s in scores)
    near = F.lit(True)
    for s in scores:
        near = near & (F.col(f"{s}_higher") <= 1)
    return ranked.filter((alone >= (len(scores) - 1 if len(scores) > 2 else len(scores))) & near)
