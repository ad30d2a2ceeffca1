"""Idempotent ingestion of record streams: offset ledger, dead letters, additive state.

A record is ``source STRING, part STRING, position BIGINT`` plus its payload columns. Positions (Kafka offsets, checkpoint indexes, sequence
numbers) rise within (source, part); what lies at or below the committed position, or repeats within a batch, goes to the dead letters.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEDGER = "source string, part string, committed bigint"


def validate(batch: DataFrame, ledger: DataFrame, max_in_flight: int | None = None) -> DataFrame:
    """``batch`` plus ``reason``: null for records to apply, else ``missing_position``, ``committed``, ``duplicate`` or ``backpressure`` (more than
    ``max_in_flight`` beyond the committed position)."""
    key = ["source", "part"]
    there = ledger.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "committed")
    # a source without parts has the part null, which is a part like any other
    known = batch.join(there, F.col("source").eqNullSafe(F.col("_s")) & F.col("part").eqNullSafe(F.col("_p")), "left").drop("_s", "_p").withColumn("committed", F.coalesce("committed", F.lit(-1)))
    again = F.row_number().over(W.partitionBy(*key, "position").orderBy(F.monotonically_increasing_id())) > 1
    reason = F.when(F.col("position").isNull() | F.col("source").isNull(), "missing_position").when(F.col("position") <= F.col("committed"), "committed").when(F.col("_again"), "duplicate")
    if max_in_flight is not None:
        reason = reason.when(F.col("position") > F.col("committed") + max_in_flight, "backpressure")
    return known.withColumn("_again", again).withColumn("reason", reason).drop("committed", "_again")


def advance(ledger: DataFrame, applied: DataFrame) -> DataFrame:
    """The ledger after a batch: the highest applied position per (source, part)."""
    new = applied.groupBy("source", "part").agg(F.max("position").alias("committed"))
    return ledger.select("source", "part", "committed").unionByName(new).groupBy("source", "part").agg(F.max("committed").alias("committed"))


def lag(ledger: DataFrame, heads: DataFrame) -> DataFrame:
    """``source, lag``: the largest distance of a part's head position from what is committed."""
    there = ledger.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "committed")
    return heads.join(there, F.col("source").eqNullSafe(F.col("_s")) & F.col("part").eqNullSafe(F.col("_p")), "left").groupBy("source").agg(F.max(F.col("head") - F.coalesce("committed", F.lit(-1))).alias("lag"))


class Store:
    """Accepted records, dead letters and ledger as versioned parquet folders; a batch id is applied at most once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = fs.getFileSystem(self.spark._jsc.hadoopConfiguration())
        base = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, "ledger"))
        if not files.exists(base):
            return []
        names = [s.getPath() for s in files.listStatus(base)]
        done = [p for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def ledger(self) -> DataFrame:
        """The newest complete ledger."""
        v = self._versions()
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/v={v[-1]}") if v else self.spark.createDataFrame([], LEDGER)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: records and dead letters into folders of the batch (overwritten on replay), the ledger last, as the commit."""
        if batch_id in self._versions():
            return
        before = self.ledger()
        told = validate(batch, before).persist()
        try:
            told.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{self.path}/records/batch={batch_id}")
            told.filter("reason is not null").write.mode("overwrite").parquet(f"{self.path}/dead/batch={batch_id}")
            advance(before, told.filter("reason is null")).write.mode("overwrite").parquet(f"{self.path}/ledger/v={batch_id}")
        finally:
            told.unpersist()

    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records")

    def dead(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/dead")


def run(stream: DataFrame, store: Store, checkpoint: str, once: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Start ingesting a stream; with ``once`` everything there is, then stop."""
    writer = stream.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
