"""Exactly-one copy of messages that were delivered at least once.

A message is named by a producer and a sequence number. What has been seen of a producer is a set of disjoint ranges of numbers. A
number that no range covers is accepted once and extends the range it touches, joins two ranges or opens a new one; a covered number is a copy.

Rows are range-partitioned and sorted by (producer, number, preference), seen ranges among them by their lower end, so a producer, or one
message with a huge number of copies, is spread over as many partitions as it needs. A partition is swept once with one open range in
hand: the ranges before it are closed, those after it not yet reached. What earlier partitions have seen of a partition's first producer is one
range end, taken from a summary of one row per partition. The sweep can give the accepted rows or the merged ranges.

Identifiers that are no sequence numbers are settled by an exact keyed lookup (:func:`copies_by_lookup`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut, fresh_name

INT64_MIN = -(2**63)
RANGES = "producer {}, lo bigint, hi bigint"
#: A text that is a sequence number: decimal, without sign or leading zeros.
SEQUENCE = "^(0|[1-9][0-9]{0,18})$"


class _Seen:
    """The open range of a sweep over entries sorted by (producer, start): a batch at a time, vectorised."""

    def __init__(self, producer=None, lo: int = 0, hi: int = 0, known: bool = False):
        self.producer, self.lo, self.hi, self.known = producer, lo, hi, known

    def advance(self, p: pa.Array, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(covered, whether a range opens, lower end of the range) of each entry; entries are [start, end]."""
        n = len(start)
        change = np.ones(n, bool)
        change[1:] = pc.not_equal(p[1:], p[:-1]).to_numpy(zero_copy_only=False)
        change[0] = not self.known or p[0].as_py() != self.producer
        # the farthest number seen of the producer before each entry
        reach = end.copy()
        if not np.array_equal(start, end):
            heads = np.flatnonzero(change | (np.arange(n) == 0))
            for a, b in zip(heads, [*heads[1:], n]):
                np.maximum.accumulate(reach[a:b], out=reach[a:b])
        if not change[0]:
            run = int(np.flatnonzero(change)[0]) if change.any() else n
            np.maximum(reach[:run], self.hi, out=reach[:run])
        before = np.empty(n, np.int64)
        before[1:] = reach[:-1]
        before[0] = self.hi
        beyond = change | (start > before)
        opens = change | ((start > before) & (start.view(np.uint64) - before.view(np.uint64) != 1))
        at = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
        lo = np.where(at < 0, self.lo, start[np.maximum(at, 0)])
        self.producer, self.lo, self.hi, self.known = p[n - 1].as_py(), int(lo[-1]), int(reach[-1]), True
        return ~beyond, opens, lo


def _carried(tails: list) -> dict[int, tuple]:
    """Per partition that continues its predecessors' last producer: (producer, the farthest number seen of it)."""
    out, last, hi = {}, None, None
    for r in sorted(tails, key=lambda r: r["part"]):
        if last is not None and r["first"] == last[0]:
            out[r["part"]] = (last[0], hi)
        if last is not None and r["last"]["p"] == last[0]:
            hi = max(hi, r["last"]["hi"])
        else:
            hi = r["last"]["hi"]
        last = (r["last"]["p"],)
    return out


class _Sweep:
    """Batch rows and seen ranges in order, checkpointed, with what each partition takes over from those before it."""

    def __init__(self, df: DataFrame, producer: str, number: str, prefer: list[Column], ranges: DataFrame | None):
        self.names, self.types, self.producer, self.number = df.columns, dict(df.dtypes), producer, number
        self.end, self.part = (fresh_name(df.columns, x) for x in ("__end", "__part"))
        entries = df.withColumn(self.end, F.lit(None).cast("bigint"))
        if ranges is not None:
            blank = [F.lit(None).cast(t).alias(c) for c, t in df.dtypes if c not in (producer, number)]
            entries = entries.unionByName(ranges.select(F.col("producer").cast(self.types[producer]).alias(producer), F.col("lo").cast(self.types[number]).alias(number), F.col("hi").alias(self.end), *blank))
        keys = [F.col(producer), F.col(number), F.col(self.end).desc_nulls_last(), *prefer]
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = entries.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        self.rows = cut(spread.withColumn(self.part, F.spark_partition_id()))
        reach = F.struct(F.col(producer).alias("p"), F.coalesce(F.col(self.end), F.col(number).cast("bigint")).alias("hi"))
        tails = self.rows.groupBy(F.col(self.part).alias("part")).agg(F.min(producer).alias("first"), F.max(reach).alias("last")).collect()  # a row per partition
        self.carry = _carried(tails)

    def _run(self, give):
        producer, number, end, part, carry = self.producer, self.number, self.end, self.part, self.carry

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = None
            for b in batches:
                if not b.num_rows:
                    continue
                if seen is None:
                    p, hi = carry.get(b.column(part)[0].as_py(), (None, 0))
                    seen = _Seen(p, INT64_MIN, hi, p is not None)
                start = b.column(number).cast(pa.int64())
                stop = pc.coalesce(b.column(end), start)
                before = (seen.producer, seen.lo, seen.hi) if seen.known else None
                told = seen.advance(b.column(producer), start.to_numpy(zero_copy_only=False).copy(), stop.to_numpy(zero_copy_only=False).copy())
                yield from give(b, before, seen, *told)
            yield from give(None, (seen.producer, seen.lo, seen.hi) if seen is not None else None, seen, None, None, None)

        return run

    def marked(self, flag: str) -> DataFrame:
        """The batch's rows with BOOLEAN ``flag``: whether the number was uncovered."""
        end, names = self.end, self.names

        def give(b, before, seen, covered, opens, lo):
            if b is not None:
                out = pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(~covered)], names=[*names, flag])
                yield out.filter(b.column(end).is_null())

        return self.rows.mapInArrow(self._run(give), ", ".join(f"`{c}` {self.types[c]}" for c in names) + f", `{flag}` boolean")

    def ranges(self) -> DataFrame:
        """``producer, lo, hi``: all that has been seen, disjoint and merged. Closed ranges come out of the sweep; of a range that crosses partition
        edges each partition knows its piece, and the pieces, one per partition, are joined on the driver."""
        kind, producer, number, end, part = self.types[self.producer], self.producer, self.number, self.end, self.part

        def give(b, before, seen, covered, opens, lo):
            if b is None:
                if before is not None:
                    yield pa.array([before[0]]), [before[1]], [before[2]]
                return
            at = np.flatnonzero(opens)
            if not len(at):
                return
            p, start = b.column(producer), b.column(number).cast(pa.int64())
            reach = pc.coalesce(b.column(end), start).to_numpy(zero_copy_only=False)
            # the range open before the batch, then those the batch opens but for the last, which stays open
            if before is not None:
                yield pa.array([before[0]]), [before[1]], [max(before[2], *reach[: at[0]].tolist())] if at[0] else [before[2]]
            if len(at) > 1:
                yield p.take(pa.array(at[:-1])), lo[at[:-1]], np.maximum.reduceat(reach, at)[:-1]

        sweep = self._run(give)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where = []

            def watched():
                for b in batches:
                    if b.num_rows and not where:
                        where.append(b.column(part)[0].as_py())
                    yield b

            held = None
            for p, lo, hi in sweep(watched()):
                if held is not None:
                    yield held
                n = len(p)
                arrays = [p, pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array([where[0]] * n, pa.int32()), pa.array([False] * n)]
                held = pa.RecordBatch.from_arrays(arrays, names=["producer", "lo", "hi", "part", "last"])
            if held is not None:  # what stays open at the partition's end
                yield held.set_column(4, "last", pa.array([False] * (held.num_rows - 1) + [True]))

        found = cut(self.rows.mapInArrow(run, f"producer {kind}, lo bigint, hi bigint, part int, last boolean"))
        # pieces that may join across an edge: each partition's last range and what continues it, at most two of a partition
        heads = found.groupBy("part").agg(F.min(F.struct("producer", "lo", "hi")).alias("r")).select("part", "r.*")
        tails = found.filter("last").select("part", "producer", "lo", "hi")
        pieces = sorted({(r["part"], r["producer"], r["lo"], r["hi"]) for r in [*heads.collect(), *tails.collect()]}, key=lambda r: (r[0], r[1], r[2]))
        merged: list[list] = []
        for _, p, lo, hi in pieces:
            m = merged[-1] if merged else None
            if m and m[0] == p and (lo == INT64_MIN or lo - 1 <= m[2]):
                m[2] = max(m[2], hi)
            else:
                merged.append([p, lo, hi])
        spark = found.sparkSession
        edge = spark.createDataFrame([(a, b, c, d) for a, b, c, d in pieces], f"part int, producer {kind}, lo bigint, hi bigint")
        inner = found.drop("last").join(F.broadcast(edge), ["part", "producer", "lo", "hi"], "left_anti").select("producer", "lo", "hi")
        return inner.unionByName(spark.createDataFrame([tuple(m) for m in merged], RANGES.format(kind)))


def _named(producer: str, number: str) -> Column:
    return F.coalesce(F.col(number).isNotNull() & F.col(producer).isNotNull() & (F.col(number) != 0), F.lit(False))


def mark_copies(df: DataFrame, producer: str, number: str, prefer: list[Column], flag: str = "accepted") -> DataFrame:
    """``df`` plus BOOLEAN ``flag``: true for the one kept row of each (producer, number) message.

    ``number`` is BIGINT, ``producer`` of any type that sorts. ``prefer`` orders the copies, best first; it should end in a
    unique column, else ties are settled arbitrarily but still leave one row. Rows whose producer or number is
    null, or whose number is 0, name no message: they are all kept. All other columns pass through, whatever
    their names, but for one called ``flag``, which is replaced; an empty table gives an empty table. Equal rows count as copies like any others.
    """
    df = df.drop(flag)
    named = _named(producer, number)
    rest = df.filter(~named).withColumn(flag, F.lit(True))
    return _Sweep(df.filter(named), producer, number, prefer, None).marked(flag).unionByName(rest.select(*df.columns, flag))


def seen_ranges(accepted: DataFrame, producer: str, number: str) -> DataFrame:
    """The numbers of each producer as disjoint, merged ranges: ``producer, lo, hi`` (inclusive), by one sweep. Rows that name no message count for nothing."""
    return _Sweep(accepted.filter(_named(producer, number)).select(producer, number), producer, number, [], None).ranges()


def accept_batch(batch: DataFrame, ranges: DataFrame | None, producer: str, number: str, prefer: list[Column]) -> tuple[DataFrame, DataFrame]:
    """One delivered batch against the ranges seen so far: (accepted rows, merged ranges).

    Within the batch the best copy of each message is kept; a message whose number lies in a seen range is
    dropped. Rows that name no message are accepted and enter no range. ``ranges`` has the columns
    ``producer, lo, hi`` as given by an earlier call; None for none. Batch and ranges are swept together, so a producer
    with any number of ranges costs one pass.
    """
    named, flag = _named(producer, number), fresh_name(batch.columns, "__accepted")
    sweep = _Sweep(batch.filter(named), producer, number, prefer, ranges)
    return sweep.marked(flag).filter(flag).drop(flag).unionByName(batch.filter(~named)), sweep.ranges()


def copies_by_lookup(df: DataFrame, key: list[str], prefer: list[Column], flag: str = "accepted") -> DataFrame:
    """The same flag for identifiers that are no numbers: exact keyed lookup of the best copy.

    The best copy of each key is found by a map-side combined minimum over ``prefer`` (orderable, unique in
    its last column; nulls first), so a key with a third of all rows shuffles a few rows per task; rows are then compared with
    their key's minimum. A key with a null part names nothing: all its rows are kept.
    """
    best = fresh_name(df.columns, "__best")
    named = F.lit(True)
    for k in key:
        named = named & F.col(k).isNotNull()
    mins = df.filter(named).groupBy(*key).agg(F.min(F.struct(*prefer)).alias(best))
    return (
        df.filter(~named).withColumn(flag, F.lit(True))
        .unionByName(df.filter(named).join(mins, key).withColumn(flag, F.struct(*prefer).eqNullSafe(F.col(best))).select(*df.columns, flag))
    )


def mark_identified(df: DataFrame, producer: str, identifier: str, prefer: list[str], flag: str = "accepted") -> DataFrame:
    """The flag for identifiers given as text: those that are sequence numbers go by ranges, malformed ones by exact lookup.

    A sequence number is decimal digits without sign or leading zeros, within BIGINT; any other text names a message by its exact letters.
    Null, empty and "0" name none. ``prefer`` names columns, lowest first, null last, the last one unique.
    """
    df = df.drop(flag)
    number, lost = (fresh_name([*df.columns, flag], x) for x in ("__number", "__lost"))
    text = F.col(identifier)
    order = [c for p in prefer for c in (F.col(p).isNull(), F.col(p))]
    rows = df.withColumn(number, F.when(text.rlike(SEQUENCE), text.try_cast("bigint")))
    well = F.col(number).isNotNull() | text.isNull() | (text == "") | F.col(producer).isNull()
    by_range = mark_copies(rows.filter(well), producer, number, order, flag)
    odd = rows.filter(~well)
    by_key = copies_by_lookup(odd, [producer, identifier], [c.alias(f"{lost}{i}") for i, c in enumerate(order)], flag)
    return by_range.unionByName(by_key).drop(number)
