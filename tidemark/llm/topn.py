"""The N best items of every group, by partition lower bounds.

Each input partition keeps, in its Python worker, at most N distinct items per group (its local best), so rows are cut
where they are read and the full rows are never shuffled. The local N-th best of any partition is a lower bound for the
group's true N-th best; the strongest bound per group meets the group's rows, rows under it are dropped, and the few survivors,
at most N per partition and group, are ranked. A group with a third of all rows costs no more than N rows per partition.

The local lists are exchanged once, by group: bound, cut, distinct items and rank all follow from that one partitioning, so nothing
is written in between and a group's bound needs no join of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import fresh_name, repartition_for


def _codes(*columns) -> np.ndarray:
    """Equal numbers for equal values of the columns, nulls included."""
    out = None
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        ids = pc.dictionary_encode(c, null_encoding="encode")
        ids = (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = ids if out is None else np.unique(out * (ids.max() + 1 if len(ids) else 1) + ids, return_inverse=True)[1]
    return out


def _local_best(group: list[str], item: str, order: list[tuple[str, str]], n: int, nth: str):
    def best(t: pa.Table) -> pa.Table:
        """At most n distinct items of each group, in order within the group."""
        if not t.num_rows:
            return t
        g = _codes(*(t[c] for c in group))
        t = t.append_column(nth, pa.array(g))  # nth is a free name
        t = t.take(pc.sort_indices(t, sort_keys=[(nth, "ascending"), *order], null_placement="at_end"))
        g, i = t[nth].to_numpy(), _codes(t[nth], t[item])
        _, first = np.unique(i, return_index=True)  # an item counts once, at its best row
        first.sort()
        g = g[first]
        start = np.concatenate([[True], g[1:] != g[:-1]])
        rank = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
        return t.take(pa.array(first[rank < n])).drop_columns([nth])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, limit, schema = 0, 100_000, None
        for batch in batches:
            schema = batch.schema
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows > limit:
                held = [best(pa.concat_tables(held))]
                rows = held[0].num_rows
                limit = max(100_000, 2 * rows)
        if schema is None or not rows:
            return
        t = best(pa.concat_tables(held)).combine_chunks()
        g = _codes(*(t[c] for c in group))
        start = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
        rank = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
        yield from t.append_column(nth, pa.array(rank == n - 1)).to_batches(max_chunksize=10_000)

    return run


def top_n(df: DataFrame, group: list[str], item: str, order: list[tuple[str, str]], n: int = 5, rank: str = "rank") -> DataFrame:
    """The first ``n`` items of every group with their 1-based ``rank``: columns ``group..., item, order..., rank``.

    ``order`` lists (column, "ascending" or "descending"); nulls come last; ``item`` ascending decides what is left, so
    the result is always the same. Rows whose first order column is null or NaN are not ranked. An item that stands in
    several rows of its group counts once, at its best row. A null group is a group, a null item an item. Descending
    columns must be numeric. Columns other than the named ones are ignored.
    """
    used = list(dict.fromkeys([*group, item, *(c for c, _ in order)]))
    nth, key, bound = (fresh_name(used, x) for x in ("__nth", "__key", "__bound"))
    lead = F.col(order[0][0])
    rows = df.select(*used).filter(lead.isNotNull())
    if dict(df.dtypes)[order[0][0]] in ("double", "float"):
        rows = rows.filter(~F.isnan(lead))
    full = order if item in [c for c, _ in order] else [*order, (item, "ascending")]
    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    local = rows.mapInArrow(_local_best(group, item, full, n, nth), f"{types}, `{nth}` boolean")
    placed = repartition_for(local, *group).withColumn(key, F.struct(*_key(rows, full))).sortWithinPartitions(*group, item, key)
    # the struct orders best first, so the strongest lower bound is the least of the local n-th bests
    strongest = F.min(F.when(F.col(nth), F.col(key))).over(W.partitionBy(*group))
    survivors = placed.withColumn(bound, strongest).filter(F.col(bound).isNull() | (F.col(key) <= F.col(bound))).select(*used, key)
    once = survivors.withColumn(bound, F.row_number().over(W.partitionBy(*group, item).orderBy(key))).filter(F.col(bound) == 1).drop(bound)
    rank = fresh_name(used, rank)
    return once.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(key))).filter(F.col(rank) <= n).select(*used, rank)


def _key(df: DataFrame, order: list[tuple[str, str]]) -> list[Column]:
    kinds, out = dict(df.dtypes), []
    for i, (name, way) in enumerate(order):
        c = F.col(name)
        if way == "descending":
            c = -c if kinds[name] in ("double", "float") else F.bitwise_not(c)
        out += [c.isNull().alias(f"n{i}"), c.alias(f"v{i}")]
    return out
