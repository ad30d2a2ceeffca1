"""Session-level helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Only a local session may leave it unset (tests); a cluster without it is an error,
    since files in a folder of one machine are lost with it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"tidemark-{spark.sparkContext.applicationId}")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in :func:`shared_dir`.

    Used where a result feeds several branches: it is computed once, and a lost executor
    costs a re-read of the files rather than a recomputation. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes
    the files once no DataFrame refers to them.
    """
    context, wanted = df.sparkSession.sparkContext, shared_dir(df.sparkSession)
    if wanted not in (context.getCheckpointDir() or ""):
        context.setCheckpointDir(wanted)
    return df.checkpoint(eager=True)


def fresh_name(columns: list[str], stem: str) -> str:
    """A column name built on ``stem`` that clashes with none of ``columns`` (compared without case)."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def repartition_for(df: DataFrame, *keys) -> DataFrame:
    """Hash partitioning on ``keys`` with the session's shuffle partition count."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
