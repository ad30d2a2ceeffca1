"""Shapes of the core models, and how the generic event table is read into them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "key string, ts_ms bigint, value string, seq bigint"
SEQUENCE_ROW = "key string, ts_ms bigint, gid bigint, action_type bigint, duration bigint, author_id bigint"
COUNTER = "family string, key string, ts_ms bigint, amount bigint, seq bigint"
NODE = "tenant bigint, node_hash bigint, parent_hash bigint, kind int, canonical_name string, l0 string, last_event_time_ms bigint"
POSTING = "tenant bigint, index_name string, value_hash bigint, scope_hash bigint, time_ms bigint, node_hash bigint, event_time_ms bigint, event_id_hash bigint"
COMMAND = "seq bigint, now_ms bigint, kind string, key string, field string, value string, member string, increment bigint, ttl_ms bigint, condition string"


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a zone-less timestamp read as UTC, built from its fields, so that no session time zone takes part."""
    days = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.expr(f"extract(second from `{ts}`) * 1000")).cast("bigint")


def within(events: DataFrame, start_ms: int, end_ms: int, ts: str = "ts") -> DataFrame:
    """``events`` cut to [start, end] on the stored timestamp itself, a filter the parquet scan can use to skip row groups."""
    stamp = lambda ms: f"timestamp_ntz'{datetime.fromtimestamp(ms / 1000, timezone.utc):%Y-%m-%d %H:%M:%S.%f}'"
    return events.filter(f"`{ts}` >= {stamp(start_ms)} and `{ts}` < {stamp(end_ms + 1)}")


def points(events: DataFrame) -> DataFrame:
    """``events`` as feature points: one series per user, the value's whole part as text."""
    return events.select(
        F.col("user_id").cast("string").alias("key"), epoch_ms("ts").alias("ts_ms"), F.floor("value").cast("bigint").cast("string").alias("value"), F.col("event_id").alias("seq"))


ACTIONS = ["click", "view", "purchase", "signup", "error"]


def sequence_rows(events: DataFrame) -> DataFrame:
    """``events`` as typed sequence rows; action_type is the 1-based place of the type in ``ACTIONS``."""
    action = F.array_position(F.array(*(F.lit(a) for a in ACTIONS)), F.col("event_type"))
    return events.select(
        F.col("user_id").cast("string").alias("key"), epoch_ms("ts").alias("ts_ms"), F.col("event_id").alias("gid"), action.cast("bigint").alias("action_type"),
        F.floor("value").cast("bigint").alias("duration"), F.get_json_object("props", "$.k").cast("bigint").alias("author_id"))
