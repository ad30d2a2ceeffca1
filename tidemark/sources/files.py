"""Files into documents and tables, and the layouts results are written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Readers by format: how a folder of files becomes ``uri, text`` rows (fixed values).
TEXT_FORMATS = ("md", "txt", "html", "csv", "tsv", "json", "jsonl", "log")


def strip_html(html: Column) -> Column:
    """Visible text: scripts, styles and tags dropped, the common entities resolved, white space compacted."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def documents(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """``uri, kind, text`` of all files under ``path``; HTML as visible text, rows of JSON lines as one document each."""
    if kind == "jsonl":
        return spark.read.text(path).select(F.input_file_name().alias("uri"), F.lit("jsonl").alias("kind"), F.col("value").alias("text"))
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("uri"), F.col("value").alias("text"))
    raw = raw.withColumn("kind", F.lit(kind) if kind else F.lower(F.regexp_extract("uri", r"\.([A-Za-z0-9]+)$", 1)))
    return raw.select("uri", "kind", F.when(F.col("kind").isin("html", "htm"), strip_html(F.col("text"))).otherwise(F.col("text")).alias("text"))


def rows(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """A typed table from csv, tsv, json or parquet files; malformed rows become nulls, kept rather than dropped."""
    reader = spark.read.schema(schema)
    if kind in ("csv", "tsv"):
        return reader.option("header", "true").option("sep", "\t" if kind == "tsv" else ",").csv(path)
    return reader.json(path) if kind == "json" else reader.parquet(path)


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length, content`` of attachments; select the columns needed, content is read only if used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def records(log: DataFrame, payload: str = "payload") -> DataFrame:
    """A record log with its JSON as VARIANT ``body``, null where it cannot be read."""
    return log.withColumn("body", F.try_parse_json(payload))


def write_series(series: DataFrame, path: str, key: str = "key", ts: str = "ts_ms", files: int | None = None) -> None:
    """A series by day folder, sorted by key and time within each file, so that range reads prune folders and row groups."""
    day = F.date_from_unix_date((F.floor(F.col(ts) / 86_400_000)).cast("int"))
    n = files or int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series.withColumn("day", day).repartitionByRange(n, "day", key, ts).sortWithinPartitions("day", key, ts).write.partitionBy("day").mode("overwrite").parquet(path)


def read_series(spark: SparkSession, path: str, start_ms: int, end_ms: int, ts: str = "ts_ms") -> DataFrame:
    """The rows of [start, end] of a written series; only the days' folders in range are listed into the scan."""
    d = lambda ms: F.date_from_unix_date(F.lit(ms // 86_400_000).cast("int"))
    return spark.read.parquet(path).filter(F.col("day").between(d(start_ms), d(end_ms)) & F.col(ts).between(start_ms, end_ms)).drop("day")


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    """Many small files into ``files`` larger ones, without a shuffle."""
    spark.read.parquet(source).coalesce(files).write.mode("overwrite").parquet(target)
