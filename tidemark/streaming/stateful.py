"""Stateful stream verbs that are more than an aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class AcceptedCapProcessor(StatefulProcessor):
    """Compare, then increment: per key the first ``limit`` attempts are allowed, in order of (time, seq) within a micro-batch; one number of state per key."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.used.get()[0] if self.used.exists() else 0
        # a key's rows of one micro-batch may come in several parts; they are put in order together
        whole = pd.concat(list(rows), ignore_index=True).sort_values(["ts_ms", "seq"])
        allowed = [(n + i) < self.limit for i in range(len(whole))]
        n = min(self.limit, n + len(whole))
        yield pd.DataFrame({"key": [key[0]] * len(whole), "seq": whole["seq"].to_numpy(), "allowed": allowed})
        self.used.update((n,))

    def close(self) -> None:
        pass


def accepted_cap(stream: DataFrame, limit: int) -> DataFrame:
    """``key, seq, allowed`` of a stream of ``key, ts_ms, seq``. Needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(AcceptedCapProcessor(limit), "key string, seq bigint, allowed boolean", "append", "none")


def dedup(stream: DataFrame, keys: list[str], event_time: str, within: str = "5 minutes") -> DataFrame:
    """One row per key within the delay; state older than that is dropped."""
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)


def buckets(stream: DataFrame, size: str, event_time: str, keys: list[str], amount: str, watermark: str = "30 days") -> DataFrame:
    """Tumbling sums in update mode: a late row corrects its bucket; the watermark only bounds how long state is kept."""
    return stream.withWatermark(event_time, watermark).groupBy(F.window(event_time, size), *keys).agg(F.sum(amount).alias("amount"))
