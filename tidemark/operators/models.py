"""Writes and reads of the context models beyond events: ids, entities, edges, embeddings, summary versions, audits, postings and dirty marks.

Every upsert is the last write per key (:func:`tidemark.operators.kv.latest`); hashes are 64-bit patterns in BIGINT and sort without their sign.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import context, kv

BUCKET_MS = 3_600_000
FAMILIES = ["event_kind", "status", "source", "event_time_bucket", "entity"]


def unsigned(h: Column) -> Column:
    """A 64-bit pattern as its unsigned number, DECIMAL(20,0); also its order."""
    n = h.cast("decimal(20,0)")
    return F.when(h < 0, n + F.lit(Decimal(2**64))).otherwise(n).cast("decimal(20,0)")


def with_event_ids(events: DataFrame) -> DataFrame:
    """``events`` with the ids that are null or 0 derived from node, time and text, so that the same event written again has the same id."""
    unset = F.coalesce(F.col("event_id_hash"), F.lit(0)) == 0
    named = F.concat_ws(":", F.lit("context_event"), unsigned(F.col("node_hash")).cast("string"), unsigned(F.col("ts_ms")).cast("string"), F.coalesce("text", F.lit("")))
    return events.withColumn("event_id_hash", F.when(unset, hashing.fnv1a(F.when(unset, named))).otherwise(F.col("event_id_hash")))


def upsert(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last write of each key. Writes without a key part, or with 0 for one, are refused."""
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull() & (F.col(k) != 0)
    return kv.latest(rows.filter(ok), keys, seq=seq)


def insert_edges(edges: DataFrame, seq: str = "seq", existing: DataFrame | None = None) -> DataFrame:
    """``edges`` (``tenant, parent_hash, child_hash, ...``) with ``created``: whether the write is the first of its edge; an edge that exists stays as it is."""
    key = ["tenant", "parent_hash", "child_hash"]
    first = F.row_number().over(W.partitionBy(*key).orderBy(seq)) == 1
    out = edges.withColumn("created", first)
    if existing is None:
        return out
    there = existing.select(*key).distinct().withColumn("_there", F.lit(True))
    return out.join(there, key, "left").withColumn("created", F.col("created") & F.col("_there").isNull()).select(*edges.columns, "created")


def entities_of(entities: DataFrame, limit: int | None = None) -> DataFrame:
    """The entities of every node in order of their hash, at most ``limit`` each."""
    w = W.partitionBy("tenant", "node_hash").orderBy(unsigned(F.col("entity_hash")))
    return entities.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= context.limited(limit)).drop("_n")


def summary_versions(summaries: DataFrame, as_of_ms: int, limit: int | None = None) -> DataFrame:
    """The versions of every node and level that were valid by ``as_of_ms``, oldest first, at most ``limit`` each. Of two versions with one start the later write counts."""
    once = kv.latest(summaries.filter(F.col("valid_from_ms") <= as_of_ms), ["tenant", "node_hash", "level", "valid_from_ms"])
    w = W.partitionBy("tenant", "node_hash", "level").orderBy("valid_from_ms")
    return once.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= context.limited(limit)).drop("_n")


def session_audits(audits: DataFrame, start_ms: int, end_ms: int, limit: int | None = None) -> DataFrame:
    """Audits of every session in [start, end], oldest first, at most ``limit`` each."""
    w = W.partitionBy("tenant", "session_id").orderBy("request_time_ms", "query_id")
    return audits.filter(F.col("request_time_ms").between(start_ms, end_ms)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= context.limited(limit)).drop("_n")


def postings(events: DataFrame, scope: Column | None = None, disabled: tuple[str, ...] = (), bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``tenant, index_name, value_hash, scope_hash, time_ms, node_hash, event_time_ms, event_id_hash`` of every event: its kind, status, source, time bucket and
    entities (``event_type, status, source_hash``, ARRAY ``entity_hashes``), but for ``disabled`` families. A value or time of 0 or null enters no index; an
    entity named twice is posted twice."""
    bucket = F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(bucket_ms))
    single = {"event_kind": F.col("event_type"), "status": F.col("status"), "source": F.col("source_hash"), "event_time_bucket": bucket}
    entry = lambda name, v, t: F.struct(F.lit(name).alias("index_name"), v.cast("bigint").alias("value_hash"), t.alias("time_ms"))
    parts = F.array(*(entry(n, v, bucket if n == "event_time_bucket" else F.col("ts_ms")) for n, v in single.items() if n not in disabled))
    if "entity" not in disabled:
        parts = F.concat(parts, F.transform(F.coalesce("entity_hashes", F.array().cast("array<bigint>")), lambda h: entry("entity", h, F.col("ts_ms"))))
    flat = events.select("tenant", "node_hash", F.col("ts_ms").alias("event_time_ms"), "event_id_hash", (scope if scope is not None else F.lit(0)).cast("bigint").alias("scope_hash"), F.explode(parts).alias("p"))
    out = flat.select("tenant", "p.index_name", "p.value_hash", "scope_hash", "p.time_ms", "node_hash", "event_time_ms", "event_id_hash")
    return out.filter((F.col("value_hash") != 0) & (F.col("time_ms") != 0))


def lookup(rows: DataFrame, index_name: str, value_hash: int, scope_hash: int, start_ms: int, end_ms: int, limit: int | None = None) -> DataFrame:
    """Postings of one value within one scope in [start, end], oldest first, at most ``limit`` per tenant."""
    return context.query_index(rows.filter(F.col("scope_hash") == scope_hash), index_name, value_hash, start_ms, end_ms, limit)


def intersection_counters(rows: DataFrame, predicates: list[tuple[str, int, int, int]]) -> DataFrame:
    """``tenant, predicate, scanned, repeated``: how many postings each predicate meets, and how many of these name an identity it has met already."""
    key = ["time_ms", "event_id_hash", "node_hash"]
    met = F.array_compact(F.array(*(F.when((F.col("index_name") == n) & (F.col("value_hash") == v) & F.col("time_ms").between(a, b), i) for i, (n, v, a, b) in enumerate(predicates))))
    hits = rows.select("tenant", *key, F.explode(met).alias("predicate")).groupBy("tenant", *key, "predicate").agg(F.count(F.lit(1)).alias("n"))
    return hits.groupBy("tenant", "predicate").agg(F.sum("n").alias("scanned"), F.sum(F.col("n") - 1).alias("repeated"))


def marked_dirty(marks: DataFrame, clears: DataFrame) -> DataFrame:
    """One marker per node (:func:`context.coalesce_dirty`) out of the marks written after the node's last clear (``tenant, node_hash, seq``)."""
    last = clears.groupBy("tenant", "node_hash").agg(F.max("seq").alias("_c"))
    return context.coalesce_dirty(marks.join(last, ["tenant", "node_hash"], "left").filter(F.col("_c").isNull() | (F.col("seq") > F.col("_c"))).drop("_c"))


def sweep_dirty(markers: DataFrame, tenant: int = 0, start_ms: int = 0, end_ms: int = 2**62, limit: int | None = None) -> DataFrame:
    """Markers of a tenant (0: of all) that overlap a window, in key order, at most ``limit``."""
    rows = context.overlapping(markers, start_ms, end_ms)
    rows = rows if tenant == 0 else rows.filter(F.col("tenant") == tenant)
    return rows.orderBy(unsigned(F.col("tenant")), unsigned(F.col("node_hash"))).limit(context.limited(limit))


def cold_windows(nodes: DataFrame, compressions: DataFrame, start_ms: int, end_ms: int, limit: int | None = None) -> DataFrame:
    """The compressions of every node that overlap the cold window, latest source first, at most ``limit`` each: the rows behind ``context.node_context``'s count."""
    return context.query_compressions(compressions.join(nodes.select("tenant", "node_hash").distinct(), ["tenant", "node_hash"], "left_semi"), start_ms, end_ms, limit)
