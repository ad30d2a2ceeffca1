"""The record log as it is kept and forgotten: tombstones in order, their closure over derivatives, scopes, and what a session may still commit.

A record is ``seq, record_id, tenant, user_id, sources`` (ARRAY of the records it was made from; none for what was ingested); a tombstone ``seq, kind, target_id, tenant, user_id`` with
kind ``delete`` (one record), ``forget`` (a user of a tenant) or ``reset`` (a tenant). It removes matching records that stand before it in the log; what is
written again afterwards lives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def surviving(records: DataFrame, tombstones: DataFrame, closure: bool = True) -> DataFrame:
    """Records that no later tombstone removes. With ``closure`` a deletion also removes the records before it that were made from the deleted record alone.

    Only the last tombstone per target, user or tenant can decide, so each kind folds to one row per key before its join; a target without id removes nothing."""
    last = lambda kind, *keys: tombstones.filter(F.col("kind") == kind).groupBy(*keys).agg(F.max("seq").alias(f"_{kind}"))
    gone = last("delete", "target_id").filter("coalesce(target_id, '') <> ''")
    out = records.join(gone.withColumnRenamed("target_id", "record_id"), "record_id", "left")
    out = out.join(last("forget", "tenant", "user_id"), ["tenant", "user_id"], "left").join(last("reset", "tenant"), "tenant", "left")
    ends = ["_delete", "_forget", "_reset"]
    if closure:
        only = F.when(F.size(F.coalesce("sources", F.array().cast("array<string>"))) == 1, F.col("sources")[0])
        out = out.withColumn("_only", only).join(gone.select(F.col("target_id").alias("_only"), F.col("_delete").alias("_derived")), "_only", "left")
        ends.append("_derived")
    lives = reduce(lambda a, b: a & b, [F.col(c).isNull() | (F.col("seq") > F.col(c)) for c in ends])
    return out.filter(lives).select(*records.columns)


def without_orphans(postings: DataFrame, records: DataFrame, ref: str = "record_id") -> DataFrame:
    """Postings or embeddings whose record survives."""
    return postings.join(records.select(ref).distinct(), ref, "left_semi")


def committable(pending: DataFrame, records: DataFrame, tombstones: DataFrame, now_ms: int, threshold: int = 20, idle_ms: int = 900_000, force: bool = False, most: int | None = None) -> DataFrame:
    """Sessions to commit: ``session_id, pending, reason``, from the pending events (``session_id, record_id, ts_ms``) whose source survives. ``reason`` is ``force``, ``threshold`` or ``idle``;
    ``most`` caps the number told as pending to what one commit takes."""
    alive = surviving(records, tombstones).select("record_id").distinct()
    g = pending.join(alive, "record_id", "left_semi").filter("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("pending"), F.max("ts_ms").alias("_last"))
    reason = F.when(F.lit(force), "force").when(F.col("pending") >= threshold, "threshold").when(F.col("_last") < now_ms - idle_ms, "idle")
    out = g.withColumn("reason", reason).filter("reason is not null").drop("_last")
    return out if most is None else out.withColumn("pending", F.least("pending", F.lit(most)))


def forget(records: DataFrame, scope: dict[str, object], needed: tuple[str, ...] = ("tenant", "user_id")) -> tuple[DataFrame, DataFrame]:
    """(records left, ``removed``: how many went per record type or as one number): exactly those that carry every value of ``scope``. A scope without one of the ``needed`` fields
    is refused, since it would reach beyond one subject."""
    if any(scope.get(f) in (None, "", 0) for f in needed):
        raise ValueError(f"a scope to forget needs {', '.join(needed)}")
    hit = reduce(lambda a, b: a & b, [F.coalesce(F.col(f) == F.lit(v), F.lit(False)) for f, v in scope.items()])
    return records.filter(~hit), records.filter(hit).agg(F.count(F.lit(1)).alias("removed"))


def due_flushes(marks: DataFrame, now_ms: int, quiet_ms: int = 2_000, longest_ms: int = 30_000) -> DataFrame:
    """``scope, first_ms, last_ms, marks, reason``: scopes (``scope, ts_ms``) to flush now, since nothing has come for ``quiet_ms`` (``quiet``) or the first mark has waited ``longest_ms`` (``waited``). In a stream this runs per
    micro-batch under a processing-time trigger."""
    g = marks.filter("scope is not null").groupBy("scope").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("ts_ms").alias("marks"))
    reason = F.when(F.col("last_ms") <= now_ms - quiet_ms, "quiet").when(F.col("first_ms") <= now_ms - longest_ms, "waited")
    return g.withColumn("reason", reason).filter("reason is not null")
