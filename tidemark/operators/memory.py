"""The record log as a memory: lifecycle of resources, session commits, summary refresh, rule-based entities, and a small facade.

A record is ``seq, key, scope, text, updated_at_ms, deleted``; later records of a key replace earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.retrieval import text_match

#: Entity type by the pattern that states it, case-insensitive; group 1 is the value (fixed values).
RULES = {
    "preference": r"(?i)\b(?:i prefer|use|keep) (?:the )?([a-z]+(?: [a-z]+)?)",
    "directive": r"(?i)\b(?:please|do not|always|never) ([a-z]+ (?:the )?[a-z]+)",
    "state": r"(?i)\b([a-z]+) is (?:now )?([a-z]+)",
}


def lifecycle(log: DataFrame, uri: str, content: str, seq: str, removed: str) -> DataFrame:
    """Per uri: its last record with ``version`` (changes of content so far), ``stale`` (the last record removed it) and ``records``."""
    h = F.xxhash64(F.coalesce(content, F.lit("")))
    rows = ordered.lagged(log.withColumn("_h", h), [uri], [seq], F.col("_h"), "_before")
    told = rows.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("_before") != F.col("_h")), 1).otherwise(0))
    return told.groupBy(uri).agg(F.sum("_new").alias("version"), F.max_by(removed, seq).alias("stale"), F.count(F.lit(1)).alias("records"), F.max(seq).alias(seq))


def due_sessions(events: DataFrame, session: str, at: str, now_ms: int, threshold: int, idle_ms: int) -> DataFrame:
    """Sessions to commit: ``session, pending, reason`` where the pending events reach the threshold or have been quiet for long."""
    g = events.filter(F.col(session).isNotNull()).groupBy(session).agg(F.count(F.lit(1)).alias("pending"), F.max(at).alias("_last"))
    reason = F.when(F.col("pending") >= threshold, "threshold").when(F.col("_last") < now_ms - idle_ms, "idle")
    return g.withColumn("reason", reason).filter("reason is not null").drop("_last")


def pending_embeddings(nodes: DataFrame, embedded: DataFrame, key: list[str], limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """All nodes without an embedding, or the next ``limit`` of them for one pass, in the order of ``order`` (the key if None)."""
    pending = nodes.join(embedded.select(*key).distinct(), key, "left_anti").orderBy(*(order or key))
    return pending if limit is None else pending.limit(limit)


def refresh_summaries(dirty: DataFrame, records: DataFrame, nodes: int, lines: int, words: int = 18) -> DataFrame:
    """Summaries of the ``nodes`` longest-dirty nodes of each tenant, from the newest ``lines`` records of each: ``tenant, node_hash, summary``."""
    oldest = W.partitionBy("tenant").orderBy("first_ms", "node_hash")
    todo = dirty.withColumn("_n", F.row_number().over(oldest)).filter(F.col("_n") <= nodes).select("tenant", "node_hash")
    newest = W.partitionBy("tenant", "node_hash").orderBy(F.col("ts_ms").desc(), F.col("delivery_id").desc())
    rows = records.join(todo, ["tenant", "node_hash"], "left_semi").withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= lines)
    short = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, words), " ")
    return rows.groupBy("tenant", "node_hash").agg(F.array_sort(F.collect_list(F.struct("_r", short.alias("s")))).alias("p")).select(
        "tenant", "node_hash", F.array_join(F.transform("p", lambda x: x["s"]), " | ").alias("summary"))


def entities(rows: DataFrame, text: str, keep: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """``keep..., entity_type, value`` for every match of every rule, lower-cased."""

    def typed(kind: str):  # a lambda with a default would be taken for one with an index
        return lambda v: F.struct(F.lit(kind).alias("entity_type"), F.lower(v).alias("value"))

    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), typed(k)) for k, p in (rules or RULES).items()]
    return rows.select(*keep, F.explode(F.concat(*found)).alias("e")).select(*keep, "e.entity_type", "e.value").distinct()


class Memory:
    """Add, update, delete, read and search over a record log; every change is appended, nothing is rewritten."""

    def __init__(self, log: DataFrame):
        self.log = log

    def _append(self, rows: DataFrame, deleted: bool) -> Memory:
        top = self.log.agg(F.max("seq")).first()[0] or 0
        add = rows.withColumn("deleted", F.lit(deleted)).withColumn("seq", F.lit(top).cast("bigint") + F.monotonically_increasing_id() + 1)
        return Memory(self.log.unionByName(add.select(*self.log.columns)))

    def add(self, rows: DataFrame) -> Memory:
        """``rows`` of key, scope, text, updated_at_ms; an existing key is updated."""
        return self._append(rows, False)

    def delete(self, keys: DataFrame) -> Memory:
        gone = self.get_all().join(keys.select("key").distinct(), "key", "left_semi")
        return self._append(gone.select("key", "scope", "text", "updated_at_ms"), True)

    def forget(self, scope: str) -> Memory:
        """Remove all of one scope; an empty scope is refused, since it would match everything."""
        if not scope:
            raise ValueError("a scope is needed to forget")
        gone = self.get_all().filter(F.col("scope") == scope)
        return self._append(gone.select("key", "scope", "text", "updated_at_ms"), True)

    def get_all(self) -> DataFrame:
        last = self.log.groupBy("key").agg(F.max_by(F.struct(*[c for c in self.log.columns if c != "key"]), "seq").alias("r"))
        return last.select("key", "r.*").filter("not deleted").select(*self.log.columns)

    def histories(self) -> DataFrame:
        """The log with ``event``: ``add``, ``update`` or ``delete``, by what each key was before."""
        before = F.lag("deleted").over(W.partitionBy("key").orderBy("seq"))
        return self.log.withColumn("event", F.when(F.col("deleted"), "delete").when(F.coalesce(before, F.lit(True)), "add").otherwise("update"))

    def history(self, key: str) -> DataFrame:
        return Memory(self.log.filter(F.col("key") == key)).histories()

    def search(self, terms: list[str], limit: int = 10) -> DataFrame:
        """The live records with the largest share of the terms, newest first among equals."""
        scored = self.get_all().withColumn("match", text_match(F.col("text"), terms)).filter("match > 0")
        return scored.orderBy(F.col("match").desc(), F.col("updated_at_ms").desc(), "key").limit(limit)
