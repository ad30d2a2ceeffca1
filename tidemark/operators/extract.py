"""From source texts to context records: nodes, events, summaries, postings, dirty marks and embeddings; entities by rule; ingest reports.

One source gives rows of several models. All of them are selections of one prepared table, so a batch of any size is one pass per model and nothing is looped over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing, text
from tidemark.operators import content, models

SOURCE = "tenant bigint, kind string, source_id string, title string, body string, ts_ms bigint"
#: Entities that a speaker's words state: role, type, pattern, case-insensitive; the whole match is the value (fixed values).
ROLE_RULES = [
    ("user", "current_plan", r"(?i)\bgoal\s*:\s*[^.;!?\n]{4,220}"),
    ("user", "current_plan", r"(?i)\b(?:please\s+)?(?:implement|fix|add|remove|replace|move)\s+[^.;!?\n]{4,180}"),
    ("user", "preference", r"(?i)\b(?:remember(?:\s+that)?|please\s+always|always|keep|use|prefer|make\s+sure(?:\s+to)?)\b[:\s]+[^.;!?\n]{4,180}"),
    ("user", "preference", r"(?i)\b(?:do\s+not|don't|never|avoid|stop)\s+[^.;!?\n]{4,180}"),
    ("user", "current_plan", r"(?i)\b(?:we\s+should|should|need\s+to|must|have\s+to|let's|lets|please)\s+[^.;!?\n]{4,180}"),
    ("assistant", "assistant_decision", r"(?i)\b(?:decided|agreed|implemented|fixed|changed|updated|verified)\s+[^.;!?\n]{4,180}"),
]
EVIDENCE_CHARS = 220


def node_id(tenant: Column, kind: Column, source_id: Column) -> Column:
    """A source's node, named by tenant, kind and id."""
    return hashing.fnv1a(F.concat_ws(":", models.unsigned(tenant).cast("string"), kind, source_id))


def prepared(sources: DataFrame) -> DataFrame:
    """``sources`` with ``node_hash, redacted, event_id_hash``; sources without tenant, id or words are refused."""
    ok = sources.filter((F.coalesce("tenant", F.lit(0)) != 0) & (F.coalesce("source_id", F.lit("")) != "") & (F.trim(F.coalesce("body", F.lit(""))) != ""))
    told = ok.withColumn("node_hash", node_id(F.col("tenant"), F.col("kind"), F.col("source_id"))).withColumn("redacted", text.redact_tokens(F.col("body")))
    return models.with_event_ids(told.withColumn("event_id_hash", F.lit(0).cast("bigint")).withColumn("text", F.col("redacted"))).drop("text")


def extract(sources: DataFrame, model: str = "local") -> dict[str, DataFrame]:
    """``nodes, events, summaries, postings, dirty, embeddings`` of the sources. Texts are stored with token-wise redaction; L0 is of every source, L1 of those that carry enough."""
    s = prepared(sources)
    title = F.coalesce("title", F.col("source_id"))
    l0, l1 = content.lead(F.col("redacted"), title=title), content.summary(F.col("redacted"), F.col("kind"), title)
    node = s.select("tenant", "node_hash", "kind", F.col("source_id").alias("canonical_name"), l0.alias("l0"), F.col("ts_ms").alias("last_event_time_ms"), F.col("ts_ms").alias("seq"))
    events = s.select("tenant", "node_hash", "event_id_hash", "ts_ms", F.col("redacted").alias("text"))
    levels = F.array(F.struct(F.lit(0).alias("level"), l0.alias("summary")), F.struct(F.lit(1).alias("level"), l1.alias("summary")))
    summaries = s.select("tenant", "node_hash", F.col("ts_ms").alias("valid_from_ms"), F.explode(levels).alias("l")).select("tenant", "node_hash", "valid_from_ms", "l.level", "l.summary").filter("summary is not null")
    refs = F.array(F.struct(F.lit("source").alias("index_name"), hashing.fnv1a("source_id").alias("value_hash")), F.struct(F.lit("source_kind").alias("index_name"), hashing.fnv1a("kind").alias("value_hash")))
    postings = s.select("tenant", "node_hash", "event_id_hash", F.col("ts_ms").alias("time_ms"), F.explode(refs).alias("p")).select("tenant", "p.index_name", "p.value_hash", "time_ms", "node_hash", "event_id_hash")
    dirty = s.select("tenant", "node_hash", F.col("ts_ms").alias("event_time_ms"), F.lit("extract").alias("reason"), F.lit(1).alias("propagate_depth"), F.col("ts_ms").alias("seq"))
    embeddings = s.select("tenant", F.col("node_hash").alias("ref_hash"), F.lit("node_l0").alias("level"), hashing.deterministic_embedding(l0, model).alias("vector"))
    return {"nodes": models.upsert(node, ["tenant", "node_hash"]), "events": events, "summaries": summaries, "postings": postings, "dirty": dirty, "embeddings": embeddings}


def sources_of(docs: DataFrame, tenant: str, uri: str, doc_id: str, body: str, ts: Column, kind: str = "resource") -> DataFrame:
    """The chunks of every document as sources, one after another in time: chunk n of a document is n milliseconds later."""
    parts = content.chunks(docs, doc_id, body).select(F.col("doc_id").alias("_d"), "chunk", "path", F.col("content").alias("body"))
    told = docs.select(F.col(doc_id).alias("_d"), F.col(tenant).alias("tenant"), F.coalesce(F.col(uri), F.col(doc_id).cast("string")).alias("_uri"), ts.cast("bigint").alias("_ts"))
    return parts.join(told, "_d").select(
        "tenant", F.lit(kind).alias("kind"), F.concat_ws("#", "_uri", F.col("chunk").cast("string")).alias("source_id"), F.when(F.col("path") != "", F.col("path")).alias("title"), "body", (F.col("_ts") + F.col("chunk")).alias("ts_ms"))


def entities(messages: DataFrame, role: str, said: str, keep: list[str]) -> DataFrame:
    """``keep..., entity_type, state``: what messages state by their speaker's role, and of tools the evidence, their text cut to 220 characters. Repeats of
    one message count once; null and blank messages state nothing."""
    speaker = F.lower(F.trim(F.col(role)))
    found = F.array().cast("array<struct<entity_type:string,state:string>>")
    for who, kind, pattern in ROLE_RULES:
        matches = F.transform(F.regexp_extract_all(said, F.lit(pattern), F.lit(0)), _typed(kind))
        found = F.concat(found, F.when(speaker == who, matches).otherwise(F.array().cast("array<struct<entity_type:string,state:string>>")))
    evidence = F.when((speaker == "tool") & (F.trim(F.col(said)) != ""), F.array(F.struct(F.lit("tool_evidence").alias("entity_type"), text.compact(F.col(said), EVIDENCE_CHARS).alias("state"))))
    found = F.concat(found, F.coalesce(evidence, F.array().cast("array<struct<entity_type:string,state:string>>")))
    return messages.filter(F.col(said).isNotNull()).select(*keep, F.explode(F.array_distinct(found)).alias("e")).select(*keep, "e.entity_type", F.trim(F.regexp_replace("e.state", r"\s+", " ")).alias("state")).filter(F.col("state").rlike("(?U)\\S")).distinct()


def _typed(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("state"))


def report(runs: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """``retention_at_k, token_reduction, p50_ms, p95_ms, p99_ms, queries`` of retrieval runs (``query_id, ref_hash, rank, tokens, full_tokens, latency_ms``) against
    the evidence that should be there (``query_id, ref_hash``): the share of evidence among the first ``k`` refs, and of tokens spared."""
    hits = gold.join(runs.filter(F.col("rank") <= k).select("query_id", "ref_hash").distinct().withColumn("_hit", F.lit(1)), ["query_id", "ref_hash"], "left")
    kept = hits.agg((F.count("_hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("retention_at_k"))
    per_query = runs.groupBy("query_id").agg(F.sum("tokens").alias("t"), F.max("full_tokens").alias("f"), F.max("latency_ms").alias("ms"))
    whole = per_query.agg((1 - F.sum("t") / F.greatest(F.sum("f"), F.lit(1))).alias("token_reduction"), *(F.expr(f"percentile(ms, {p / 100})").alias(f"p{p}_ms") for p in (50, 95, 99)), F.count(F.lit(1)).alias("queries"))
    one = kept.first()[0]  # one number
    return whole.withColumn("retention_at_k", F.lit(float(one)))
