"""The value-count multiset of late events as a stream: every micro-batch appends its count deltas, reads add them up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import late_events


def apply(batch: DataFrame, batch_id: int, path: str) -> None:
    """Add a micro-batch: its deltas and the rows set aside, in folders of the batch, so a replay overwrites itself."""
    rows = late_events.with_period(batch)
    late_events.multiset(rows.filter("not set_aside")).write.mode("overwrite").parquet(f"{path}/deltas/batch={batch_id}")
    rows.filter("set_aside").write.mode("overwrite").parquet(f"{path}/aside/batch={batch_id}")


def state(spark: SparkSession, path: str) -> DataFrame:
    """The multiset so far."""
    return spark.read.parquet(f"{path}/deltas").groupBy("tenant", "hour_ms", "value").agg(F.sum("n").alias("n"))


def run(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.foreachBatch(lambda b, i: apply(b, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
