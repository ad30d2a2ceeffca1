"""Context models: nodes, events, index postings, entities, edges, embeddings, summaries, compressions, dirty markers and audits.

Upserts are :func:`tidemark.operators.kv.latest` over the model's key; what follows are the reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import cut

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
SNIPPET, SUMMARY_MAX = 256, 16_384
BEAM, CANDIDATES, MAX_DEPTH = 8, 64, 16


def limited(limit: int | None) -> int:
    return min(max(DEFAULT_LIMIT if limit is None else limit, 1), MAX_LIMIT)


def normalised(events: DataFrame) -> DataFrame:
    """Events with missing arrival taken from the time of happening. Rows without tenant, node or any time are refused."""
    ts = F.coalesce(F.nullif("ts_ms", F.lit(0)), F.nullif("ingestion_time_ms", F.lit(0)))
    out = events.withColumn("ts_ms", ts).withColumn("ingestion_time_ms", F.coalesce(F.nullif("ingestion_time_ms", F.lit(0)), ts))
    return out.filter("tenant is not null and tenant <> 0 and node_hash is not null and node_hash <> 0 and ts_ms is not null")


def query_events(events: DataFrame, start_ms: int, end_ms: int, max_scan: int = DEFAULT_LIMIT, limit: int | None = None, kinds: list[int] = (), statuses: list[int] = (), min_confidence: float = 0.0, min_importance: float = 0.0, as_of_ms: int | None = None) -> DataFrame:
    """Per node, newest first: scan at most ``max_scan`` (1 to 1,000) events of [start, end], filter, then keep ``limit``.

    A null status, confidence or importance fails a filter on it; ``as_of_ms`` (0: the window's end) drops events that happened later and those whose
    validity has ended by then.
    """
    if end_ms <= start_ms:
        raise ValueError("a context window needs end > start")
    newest = W.partitionBy("tenant", "node_hash").orderBy(F.col("ts_ms").desc(), F.col("delivery_id").desc())
    out = events.filter(F.col("ts_ms").between(start_ms, end_ms)).withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limited(max_scan))
    if kinds:
        out = out.filter(F.col("event_type").isin(list(kinds)))
    if statuses:
        out = out.filter(F.col("status").isin(list(statuses)))
    if min_confidence > 0:
        out = out.filter(F.col("confidence") >= min_confidence)
    if min_importance > 0:
        out = out.filter(F.col("importance") >= min_importance)
    if as_of_ms is not None:
        at = as_of_ms or end_ms
        out = out.filter((F.col("ts_ms") <= at) & (F.coalesce(F.col("valid_until_ms"), F.lit(0)).isin(0) | (F.col("valid_until_ms") > at)))
    again = W.partitionBy("tenant", "node_hash").orderBy("_n")
    return out.withColumn("_m", F.row_number().over(again)).filter(F.col("_m") <= limited(limit)).drop("_n", "_m")


def extract_postings(events: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """Index postings of events: kind, status and time bucket families; empty values and times enter no index."""
    values = {"event_kind": F.col("event_type"), "status": F.col("status"), "event_time_bucket": F.col("ts_ms") - F.col("ts_ms") % bucket_ms}
    families = F.array(*(F.struct(F.lit(k).alias("index_name"), v.cast("bigint").alias("value_hash")) for k, v in values.items()))
    flat = events.select("tenant", "node_hash", F.col("ts_ms").alias("time_ms"), "event_id_hash", F.explode(families).alias("p"))
    return flat.select("tenant", "p.index_name", "p.value_hash", "time_ms", "node_hash", "event_id_hash").filter("value_hash is not null and value_hash <> 0 and time_ms is not null and time_ms <> 0")


def query_index(postings: DataFrame, index_name: str, value_hash: int, start_ms: int, end_ms: int, limit: int | None = None) -> DataFrame:
    """Postings of one value in [start, end], oldest first, per tenant."""
    w = W.partitionBy("tenant").orderBy("time_ms", "node_hash", "event_id_hash")
    rows = postings.filter((F.col("index_name") == index_name) & (F.col("value_hash") == value_hash) & F.col("time_ms").between(start_ms, end_ms))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limited(limit)).drop("_n")


def intersect_index(postings: DataFrame, predicates: list[tuple[str, int, int, int]], limit: int | None = None) -> DataFrame:
    """Identities (node, time, event) that satisfy every predicate (index, value, start, end): one pass that counts which
    predicates each identity meets, oldest first, at most ``limit`` per tenant."""
    met = F.array_compact(F.array(*(
        F.when((F.col("index_name") == name) & (F.col("value_hash") == value) & F.col("time_ms").between(a, b), i) for i, (name, value, a, b) in enumerate(predicates))))
    hits = postings.select("tenant", "time_ms", "event_id_hash", "node_hash", F.explode(met).alias("p")).distinct()
    both = hits.groupBy("tenant", "time_ms", "event_id_hash", "node_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(predicates)).drop("n")
    w = W.partitionBy("tenant").orderBy("time_ms", "event_id_hash", "node_hash")
    return both.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limited(limit)).drop("_n")


def coalesce_dirty(markers: DataFrame) -> DataFrame:
    """One marker per node out of ``tenant, node_hash, event_time_ms, reason, propagate_depth, seq``."""
    return markers.groupBy("tenant", "node_hash").agg(
        F.min("event_time_ms").alias("first_ms"), F.max("event_time_ms").alias("last_ms"), F.max_by("reason", "seq").alias("reason"), F.max("propagate_depth").alias("propagate_depth"), F.count(F.lit(1)).alias("marks"))


def overlapping(intervals: DataFrame, start_ms: int, end_ms: int, first: str = "first_ms", last: str = "last_ms") -> DataFrame:
    return intervals.filter((F.col(last) >= start_ms) & (F.col(first) <= end_ms))


def children(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """``tenant, parent_hash, child_hash`` by (time, child), at most ``limit`` per parent; top nodes have none above them."""
    w = W.partitionBy("tenant", "parent_hash").orderBy("last_event_time_ms", "node_hash")
    rows = nodes.filter("parent_hash <> 0").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limited(limit))
    return rows.select("tenant", "parent_hash", F.col("node_hash").alias("child_hash"), F.col("last_event_time_ms").alias("updated_at_ms"))


def in_request_order(requests: DataFrame, rows: DataFrame, key: str, limit: int | None = None, on: list[str] = ()) -> DataFrame:
    """``req_id, pos, ...``: the rows of each request's ``refs`` (ARRAY), repeats and zeros dropped, request order kept. ``on`` are further columns that request
    and row must share."""
    asked = requests.select("req_id", *on, F.posexplode("refs").alias("pos", key)).filter(F.col(key) != 0).groupBy("req_id", *on, key).agg(F.min("pos").alias("pos"))
    hit = asked.join(rows, [*on, key])
    return hit.withColumn("_n", F.row_number().over(W.partitionBy("req_id").orderBy("pos"))).filter(F.col("_n") <= limited(limit)).drop("_n")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in DOUBLE; 0 for empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = dot(a, a), dot(b, b)
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (na <= 0) | (nb <= 0), 0.0).otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def traverse(edges: DataFrame, vectors: DataFrame, start: DataFrame, query: list[float], max_depth: int = 6, top_k: int = BEAM, child_limit: int = MAX_LIMIT, candidates: int = CANDIDATES, leaf_only: bool = False) -> DataFrame:
    """Beam search down a tree: ``tenant, root, node, depth, score``. ``edges`` is ``tenant, parent, child, updated_at_ms``; ``vectors`` ``tenant, node, vector``;
    ``start`` ``tenant, root`` (many roots are searched at once). Per depth and root the ``top_k`` children of positive cosine go on; nodes are
    collected in order of (depth, score desc, node) up to ``candidates``. A level joins the beam (at most roots x top_k rows) to its edges, keeps the first ``child_limit`` children
    of a parent by (time, child), and only then fetches and scores their vectors; it is checkpointed so that the plan does not grow.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    beam = start.select("tenant", "root", F.col("root").alias("node"))
    first = W.partitionBy("tenant", "root", "parent").orderBy("updated_at_ms", "child")
    out = None
    for depth in range(1, min(max_depth, MAX_DEPTH) + 1):
        at = beam.select("tenant", "root", F.col("node").alias("parent"))
        below = at.join(edges, ["tenant", "parent"]).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= min(child_limit, MAX_LIMIT))
        scored = below.select("tenant", "root", F.col("child").alias("node")).join(vectors, ["tenant", "node"]).select("tenant", "root", "node", F.lit(depth).alias("depth"), cosine(F.col("vector"), q).alias("score"))
        w = W.partitionBy("tenant", "root").orderBy(F.col("score").desc(), "node")
        layer = cut(scored.filter("score > 0").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= min(max(top_k, 1), MAX_LIMIT)).drop("_n"))
        if layer.isEmpty():
            break
        out = layer if out is None else out.unionByName(layer)
        beam = layer.select("tenant", "root", "node")
    if out is None:
        return start.select("tenant", "root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(0.0).alias("score")).filter(F.lit(False))
    if leaf_only:
        out = out.join(edges.select("tenant", F.col("parent").alias("node")).distinct(), ["tenant", "node"], "left_anti")
    w = W.partitionBy("tenant", "root").orderBy("depth", F.col("score").desc(), "node")
    return out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= min(max(candidates, 1), MAX_LIMIT)).select("tenant", "root", "node", "depth", "score")


def as_of(rows: DataFrame, keys: list[str], valid_from: str, as_of_ms: int, pick: list[str]) -> DataFrame:
    """The latest version of each key that was valid at a time."""
    return rows.filter(F.col(valid_from) <= as_of_ms).groupBy(*keys).agg(F.max_by(F.struct(*pick), F.struct(valid_from, *pick)).alias("r")).select(*keys, *(F.col("r")[c].alias(c) for c in pick))


def compress_events(events: DataFrame, start_ms: int, end_ms: int, max_events: int = DEFAULT_LIMIT, min_confidence: float = 0.0, min_importance: float = 0.0) -> DataFrame:
    """One summary per node over a window: ``tenant, node_hash, n_sources, truncated, summary``.

    The oldest ``max_events`` that meet the thresholds are joined by a header and cut snippets; sources stay. At most ``max_events``
    rows per node are gathered."""
    ok = events.filter(F.col("ts_ms").between(start_ms, end_ms))
    if min_confidence > 0:
        ok = ok.filter(F.col("confidence") >= min_confidence)
    if min_importance > 0:
        ok = ok.filter(F.col("importance") >= min_importance)
    w = W.partitionBy("tenant", "node_hash").orderBy("ts_ms", "event_id_hash", "delivery_id")
    rows = ok.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_events + 1)
    kept = F.col("_n") <= max_events
    snippet = F.when(kept, F.struct("_n", F.substring("text", 1, SNIPPET).alias("s")))
    out = rows.groupBy("tenant", "node_hash").agg(
        F.count_if(kept).alias("n_sources"), F.max(F.col("_n") > max_events).alias("truncated"), F.array_sort(F.collect_list(snippet)).alias("parts"))
    head = F.lit(f"Window {start_ms}-{end_ms}: ")
    body = F.concat(head, F.array_join(F.transform("parts", lambda p: p["s"]), " "), F.when(F.col("truncated"), F.lit(" (more events follow)")).otherwise(F.lit("")))
    return out.select("tenant", "node_hash", "n_sources", "truncated", F.substring(body, 1, SUMMARY_MAX).alias("summary"))


def auto_compress(events: DataFrame, now_ms: int, max_raw: int = 64, max_age_ms: int = 2_592_000_000, keep: int = 32, batch: int = 32) -> DataFrame:
    """Events due for compression: nodes with more than ``max_raw`` events or any older than ``max_age_ms`` give their oldest ``batch``
    events beyond the newest ``keep``."""
    node = ["tenant", "node_hash"]
    sizes = events.groupBy(*node).agg(F.count(F.lit(1)).alias("_all"), F.min("ts_ms").alias("_old")).filter((F.col("_all") > max_raw) | (F.col("_old") < now_ms - max_age_ms))
    # counted from the oldest, so that at most ``batch`` rows of a node are ranked
    oldest = W.partitionBy(*node).orderBy("ts_ms", "delivery_id")
    first = events.withColumn("_r", F.row_number().over(oldest)).filter(F.col("_r") <= batch)
    return first.join(sizes, node).filter(F.col("_r") <= F.col("_all") - keep).select(*events.columns)


def node_context(nodes: DataFrame, summaries: DataFrame, compressions: DataFrame, as_of_ms: int, cold_start_ms: int, cold_end_ms: int, level: int = 1) -> DataFrame:
    """Nodes with their latest summary of a level as of a time and the number of compressions that overlap the cold window."""
    s = as_of(summaries.filter(F.col("level") == level), ["tenant", "node_hash"], "valid_from_ms", as_of_ms, ["summary"])
    c = overlapping(compressions, cold_start_ms, cold_end_ms, "source_start_ms", "source_end_ms").groupBy("tenant", "node_hash").agg(F.count(F.lit(1)).alias("n_cold"))
    return nodes.join(s, ["tenant", "node_hash"], "left").join(c, ["tenant", "node_hash"], "left").withColumn("n_cold", F.coalesce("n_cold", F.lit(0)))


def index_check(expected: DataFrame, postings: DataFrame) -> DataFrame:
    """Per index family: postings expected, found and missing."""
    key = ["tenant", "index_name", "value_hash", "time_ms", "node_hash", "event_id_hash"]
    there = postings.select(*key).distinct().withColumn("_f", F.lit(1))
    return expected.select(*key).distinct().join(there, key, "left").groupBy("index_name").agg(
        F.count(F.lit(1)).alias("checked"), F.count("_f").alias("found"), F.count_if(F.col("_f").isNull()).alias("missing"))


def query_audits(audits: DataFrame, start_ms: int, end_ms: int, limit: int | None = None) -> DataFrame:
    """Audits ``tenant, query_id, request_time_ms, ...`` of a window, oldest first, at most ``limit`` per tenant."""
    w = W.partitionBy("tenant").orderBy("request_time_ms", "query_id")
    return audits.filter(F.col("request_time_ms").between(start_ms, end_ms)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limited(limit)).drop("_n")


def query_compressions(rows: DataFrame, start_ms: int, end_ms: int, limit: int | None = None) -> DataFrame:
    """Compressions that overlap a window, per node the latest source first: (source end desc, compressed desc, id)."""
    w = W.partitionBy("tenant", "node_hash").orderBy(F.col("source_end_ms").desc(), F.col("compressed_time_ms").desc(), "id")
    return overlapping(rows, start_ms, end_ms, "source_start_ms", "source_end_ms").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limited(limit)).drop("_n")


def tree_first(edges: DataFrame, scores: DataFrame, start: DataFrame, max_depth: int = 6, per_parent: int = 3) -> DataFrame:
    """Top-down selection: under every selected node its ``per_parent`` best children: ``root, node, depth, score``. ``edges`` is
    ``parent, child``; ``scores`` ``node, score``; each level is one join, checkpointed."""
    scored = cut(edges.select("parent", "child").join(scores, F.col("child") == F.col("node")).select("parent", "child", "score"))
    w = W.partitionBy("parent").orderBy(F.col("score").desc(), "child")
    best = cut(scored.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_parent).drop("_n"))
    front, out = start.select("root", F.col("root").alias("at")), None
    for depth in range(1, min(max_depth, MAX_DEPTH) + 1):
        layer = cut(front.join(best, F.col("at") == F.col("parent")).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth"), "score"))
        if layer.isEmpty():
            break
        out = layer if out is None else out.unionByName(layer)
        front = layer.select("root", F.col("node").alias("at"))
    return out if out is not None else start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(0.0).alias("score")).filter(F.lit(False))
