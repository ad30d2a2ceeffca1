"""Registered queries of the general data problems 2, 5 and 6, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dedup, late_events, nested
from tidemark.runtime import table

def _prefer() -> list:
    return [F.col("created_at_ms").asc_nulls_last(), F.col("delivery_id").asc()]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of ``context_event`` that are not kept."""
    events = table(spark, sf_dir, "context_event").select("delivery_id", "tenant", "event_id_hash", "created_at_ms")
    return dedup.mark_copies(events, "tenant", "event_id_hash", _prefer()).filter("not accepted").select("delivery_id")


def p2_kept_per_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "context_event").select("delivery_id", "tenant", "event_id_hash", "created_at_ms")
    marked = dedup.mark_copies(events, "tenant", "event_id_hash", _prefer())
    return marked.groupBy("tenant").agg(F.count_if("accepted").alias("kept"), F.count_if(~F.col("accepted")).alias("dropped"))


def p2_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same deliveries where identifiers are texts and those with a sign are no sequence numbers."""
    events = table(spark, sf_dir, "context_event").select("delivery_id", "tenant", F.col("event_id_hash").cast("string").alias("identifier"), "created_at_ms")
    return dedup.mark_identified(events, "tenant", "identifier", ["created_at_ms", "delivery_id"]).filter("not accepted").select("delivery_id")


#: Into how many rounds the batches are put.
ROUNDS = 4


def _p2_rounds(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    events = table(spark, sf_dir, "context_event").select("delivery_id", "batch_id", "tenant", "event_id_hash", "created_at_ms")
    low, high = events.agg(F.min("batch_id"), F.max("batch_id")).first()
    turn = F.floor((F.col("batch_id") - F.lit(low or 0)) * ROUNDS / F.lit((high or 0) - (low or 0) + 1))
    out, ranges = [], None
    for k in range(ROUNDS):
        kept, ranges = dedup.accept_batch(events.filter(turn == k), ranges, "tenant", "event_id_hash", _prefer())
        out.append(kept.select("delivery_id", F.lit(k).alias("round")))
    return out, ranges


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries accepted when the batches come in four rounds and each is held against the ranges of those before it."""
    out, _ = _p2_rounds(spark, sf_dir)
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


#: By how many bits ids are shortened where ranges are shown, so that neighbours occur and ranges merge.
SHORTENED = 46


def p2_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged ranges of each tenant's shortened ids after one half of the deliveries is held against the ranges of the other."""
    events = table(spark, sf_dir, "context_event").select("delivery_id", "tenant", F.shiftright("event_id_hash", SHORTENED).alias("number"))
    seen = dedup.seen_ranges(events.filter("delivery_id % 2 = 0"), "tenant", "number")
    _, ranges = dedup.accept_batch(events.filter("delivery_id % 2 <> 0"), seen, "tenant", "number", [F.col("delivery_id")])
    return ranges.select(F.col("producer").alias("tenant"), "lo", "hi")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child row of ``context_record``."""
    return nested.children(table(spark, sf_dir, "context_record"), values=False).select("seq", "child", "child_key").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of ``context_event`` that came after the cut-off."""
    return late_events.with_period(table(spark, sf_dir, "context_event")).filter("set_aside").select("delivery_id")


def _p6_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_events.multiset(late_events.with_period(table(spark, sf_dir, "context_event")).filter("not set_aside"))


def p6_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and mean importance per tenant and UTC hour, without the rows set aside."""
    stats = late_events.statistics(_p6_state(spark, sf_dir), median=False)
    return stats.select("tenant", "hour_ms", "n_events", F.round("mean_value", 6).alias("mean_importance"))


def p6_hourly_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, distinct values and extremes of importance per tenant and UTC hour."""
    stats = late_events.statistics(_p6_state(spark, sf_dir))
    return stats.select("tenant", "hour_ms", *(F.col(c).cast("double").alias(c) for c in ("median_value", "min_value", "max_value")), "n_distinct")


QUERIES = {f.__name__: f for f in (p2_found, p2_kept_per_tenant, p2_identifiers, p2_batches, p2_ranges, p5_found, p6_found, p6_hourly, p6_hourly_exact)}

_MARKED = """
  SELECT *, event_id_hash IS NULL OR event_id_hash = 0 OR tenant IS NULL
         OR row_number() OVER (PARTITION BY tenant, event_id_hash ORDER BY created_at_ms ASC NULLS LAST, delivery_id) = 1 AS accepted
  FROM context_event
"""
_HAPPENED = """
  SELECT *, CAST(floor(happened_ms / 3600000.0) AS BIGINT) * 3600000 AS hour_ms FROM (
    SELECT *, CAST(coalesce(
      CASE WHEN ts_ms = 0 THEN NULL
           WHEN abs(ts_ms) < 100000000000 THEN ts_ms * 1000
           WHEN abs(ts_ms) < 100000000000000 THEN ts_ms
           WHEN abs(ts_ms) < 100000000000000000 THEN floor(ts_ms / 1000.0)
           ELSE floor(ts_ms / 1000000.0) END,
      nullif(hook_observed_at_ms, 0), nullif(created_at_ms, 0)) AS BIGINT) AS happened_ms
    FROM context_event)
"""
_LATE = "coalesce(nullif(ingestion_time_ms, 0) - (hour_ms + 3600000) > 21600000, false)"

ORACLE = {
    "p2_found": f"SELECT delivery_id FROM ({_MARKED}) WHERE NOT accepted",
    "p2_kept_per_tenant": f"SELECT tenant, CAST(count(*) FILTER (accepted) AS BIGINT) AS kept, CAST(count(*) FILTER (NOT accepted) AS BIGINT) AS dropped FROM ({_MARKED}) GROUP BY tenant",
    "p2_identifiers": f"SELECT delivery_id FROM ({_MARKED}) WHERE NOT accepted",
    "p2_batches": f"""WITH r AS (SELECT *, CAST(floor((batch_id - lo) * {ROUNDS} / CAST(hi - lo + 1 AS DOUBLE)) AS INT) AS round FROM context_event, (SELECT min(batch_id) AS lo, max(batch_id) AS hi FROM context_event))
      SELECT delivery_id, round FROM r WHERE round IS NOT NULL QUALIFY event_id_hash IS NULL OR event_id_hash = 0 OR tenant IS NULL
        OR row_number() OVER (PARTITION BY tenant, event_id_hash ORDER BY round, created_at_ms ASC NULLS LAST, delivery_id) = 1""",
    "p2_ranges": f"""WITH n AS (SELECT DISTINCT tenant, event_id_hash >> {SHORTENED} AS number FROM context_event WHERE tenant IS NOT NULL AND event_id_hash IS NOT NULL AND event_id_hash >> {SHORTENED} <> 0),
      g AS (SELECT *, number - row_number() OVER (PARTITION BY tenant ORDER BY number) AS isle FROM n)
      SELECT tenant, min(number) AS lo, max(number) AS hi FROM g GROUP BY tenant, isle""",
    "p6_found": f"SELECT delivery_id FROM ({_HAPPENED}) WHERE {_LATE}",
    "p6_hourly": f"""SELECT tenant, hour_ms, count(*) AS n_events, round(avg(CAST(importance AS DOUBLE)), 6) AS mean_importance
      FROM ({_HAPPENED}) WHERE hour_ms IS NOT NULL AND NOT {_LATE} GROUP BY tenant, hour_ms""",
    "p6_hourly_exact": f"""SELECT tenant, hour_ms, CAST(quantile_disc(importance, 0.5) AS DOUBLE) AS median_value, CAST(min(importance) AS DOUBLE) AS min_value,
      CAST(max(importance) AS DOUBLE) AS max_value, count(DISTINCT importance) AS n_distinct
      FROM ({_HAPPENED}) WHERE hour_ms IS NOT NULL AND NOT {_LATE} GROUP BY tenant, hour_ms""",
}
