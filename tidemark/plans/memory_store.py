"""Registered queries over the record log as a memory, audits and selection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import content, context, memory, retrieval
from tidemark.plans.context_store import E, END, START, _events, _refs, R
from tidemark.runtime import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(f"""WITH a AS (SELECT tenant, query_id, max(updated_at_ms) AS request_time_ms, count(*) AS refs, CAST(coalesce(sum(token_estimate), 0) AS BIGINT) AS tokens FROM ({R}) GROUP BY 1, 2)
  SELECT * FROM a WHERE request_time_ms BETWEEN {START} AND {END} QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY request_time_ms, query_id) <= 4""")
def context_pack_audits(spark, d):
    a = _refs(spark, d).groupBy("tenant", "query_id").agg(F.max("updated_at_ms").alias("request_time_ms"), F.count(F.lit(1)).alias("refs"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"))
    return context.query_audits(a, START, END, 4)


@query(f"""WITH c AS (SELECT tenant, node_hash, delivery_id AS id, ts_ms AS source_start_ms, ts_ms + event_type * 600000 AS source_end_ms, ingestion_time_ms AS compressed_time_ms FROM ({E}))
  SELECT * FROM c WHERE source_end_ms >= {START} AND source_start_ms <= {END} QUALIFY row_number() OVER (PARTITION BY tenant, node_hash ORDER BY source_end_ms DESC, compressed_time_ms DESC, id) <= 3""")
def context_query_compressions(spark, d):
    c = _events(spark, d).select("tenant", "node_hash", F.col("delivery_id").alias("id"), F.col("ts_ms").alias("source_start_ms"), (F.col("ts_ms") + F.col("event_type") * 600_000).alias("source_end_ms"), F.col("ingestion_time_ms").alias("compressed_time_ms"))
    return context.query_compressions(c, START, END, 3)


@query("""WITH RECURSIVE s AS (SELECT node_hash AS node, tenant, parent_hash AS parent, abs(node_hash % 1000) / 1000.0 AS score FROM context_node),
  b AS (SELECT * FROM s WHERE parent <> 0 QUALIFY row_number() OVER (PARTITION BY parent ORDER BY score DESC, node) <= 2),
  t AS (SELECT s.node AS root, b.node, 1 AS depth, b.score FROM s JOIN b ON b.parent = s.node WHERE s.parent = 0 UNION ALL SELECT t.root, b.node, t.depth + 1, b.score FROM t JOIN b ON b.parent = t.node WHERE t.depth < 6)
  SELECT root, node, depth, CAST(score AS DOUBLE) AS score FROM t""")
def context_tree_first(spark, d):
    n = table(spark, d, "context_node")
    edges = n.filter("parent_hash <> 0").select(F.col("parent_hash").alias("parent"), F.col("node_hash").alias("child"))
    scores = n.select(F.col("node_hash").alias("node"), (F.abs(F.col("node_hash") % 1000) / 1000.0).alias("score"))
    return context.tree_first(edges, scores, n.filter("parent_hash = 0").select(F.col("node_hash").alias("root")), 6, 2)


@query("""WITH l AS (SELECT node_hash AS uri, text, delivery_id AS seq, event_type = 5 AS removed, lag(text) OVER (PARTITION BY node_hash ORDER BY delivery_id) AS before, row_number() OVER (PARTITION BY node_hash ORDER BY delivery_id) AS n FROM context_event WHERE node_hash IS NOT NULL)
  SELECT uri, CAST(count(*) FILTER (n = 1 OR before <> text) AS BIGINT) AS version, arg_max(removed, seq) AS stale, count(*) AS records, max(seq) AS seq FROM l GROUP BY 1""")
def resource_lifecycle(spark, d):
    e = table(spark, d, "context_event").filter("node_hash is not null").select(F.col("node_hash").alias("uri"), "text", F.col("delivery_id").alias("seq"), (F.col("event_type") == 5).alias("removed"))
    return memory.lifecycle(e, "uri", "text", "seq", "removed")


@query(f"""SELECT session_id, count(*) AS pending, CASE WHEN count(*) >= 12 THEN 'threshold' ELSE 'idle' END AS reason FROM chat_message WHERE session_id IS NOT NULL GROUP BY 1
  HAVING count(*) >= 12 OR max(ts_ms) < {END} - 86400000""")
def session_commit(spark, d):
    return memory.due_sessions(table(spark, d, "chat_message"), "session_id", "ts_ms", END, 12, 86_400_000)


@query("SELECT tenant, node_hash FROM context_node WHERE node_hash NOT IN (SELECT node_hash FROM context_event WHERE node_hash IS NOT NULL) ORDER BY tenant, node_hash LIMIT 100")
def embedding_drain(spark, d):
    """The first pass of the drainer, 100 nodes; ``embedding_pending`` gives all of them."""
    done = table(spark, d, "context_event").select("node_hash")
    return memory.pending_embeddings(table(spark, d, "context_node").select("tenant", "node_hash"), done, ["node_hash"], 100, ["tenant", "node_hash"])


@query("SELECT tenant, node_hash FROM context_node WHERE node_hash NOT IN (SELECT node_hash FROM context_event WHERE node_hash IS NOT NULL)")
def embedding_pending(spark, d):
    done = table(spark, d, "context_event").select("node_hash")
    return memory.pending_embeddings(table(spark, d, "context_node").select("tenant", "node_hash"), done, ["node_hash"], order=["tenant", "node_hash"])


@query(rf"""WITH d AS (SELECT tenant, node_hash, min(ts_ms) AS first_ms FROM ({E}) GROUP BY ALL), t AS (SELECT tenant, node_hash FROM d QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY first_ms, node_hash) <= 10),
  r AS (SELECT *, row_number() OVER (PARTITION BY tenant, node_hash ORDER BY ts_ms DESC, delivery_id DESC) AS r FROM ({E}) SEMI JOIN t USING (tenant, node_hash))
  SELECT tenant, node_hash, string_agg(array_to_string(regexp_split_to_array(trim(text), '\s+')[1:18], ' '), ' | ' ORDER BY r) AS summary FROM r WHERE r <= 4 GROUP BY ALL""")
def summary_refresh(spark, d):
    e = _events(spark, d)
    return memory.refresh_summaries(e.groupBy("tenant", "node_hash").agg(F.min("ts_ms").alias("first_ms")), e, 10, 4)


@query("""SELECT DISTINCT doc_id, entity_type, lower(value) AS value FROM (
  SELECT doc_id, 'preference' AS entity_type, unnest(regexp_extract_all(text, '(?i)\\b(?:i prefer|use|keep) (?:the )?([a-z]+(?: [a-z]+)?)', 1)) AS value FROM documents
  UNION ALL SELECT doc_id, 'directive', unnest(regexp_extract_all(text, '(?i)\\b(?:please|do not|always|never) ([a-z]+ (?:the )?[a-z]+)', 1)) FROM documents
  UNION ALL SELECT doc_id, 'state', unnest(regexp_extract_all(text, '(?i)\\b([a-z]+) is (?:now )?([a-z]+)', 1)) FROM documents)""")
def entity_rules(spark, d):
    return memory.entities(table(spark, d, "documents"), "text", ["doc_id"])


@query(f"""SELECT query_id, ref_hash, round(CASE WHEN time_score IS NULL AND sparse_score IS NULL AND h THEN 0.58 ELSE least(1.0, 0.72 * coalesce(time_score, 0) + 0.28 * coalesce(sparse_score / (sparse_score + 5), 0) + CASE WHEN h THEN 0.08 ELSE 0 END) END, 6) AS s
  FROM (SELECT *, coalesce(recall_path = 'index', false) AS h FROM ({R}))""")
def retrieval_node_score(spark, d):
    h = F.coalesce(F.col("recall_path") == "index", F.lit(False))
    return _refs(spark, d).select("query_id", "ref_hash", retrieval.node_score(F.col("time_score"), F.col("sparse_score") / (F.col("sparse_score") + 5), h).alias("s"))


@query()
def retrieval_drop_similar(spark, d):
    """Events of a node in time order without those too like an earlier one."""
    e = _events(spark, d).select("node_hash", "delivery_id", F.split(F.lower("text"), r"\W+").alias("tokens"))
    return retrieval.drop_similar(e, "node_hash", "delivery_id", "tokens").select("node_hash", "delivery_id")


@query("""WITH s AS (SELECT tenant, node_hash, unnest(['kind:' || event_type, 'status:' || coalesce(status, -1)]) AS term FROM context_event WHERE node_hash IS NOT NULL),
  t AS (SELECT node_hash, list(DISTINCT term) AS terms FROM s GROUP BY 1)
  SELECT node_hash, list_has_any(terms, ['kind:2', 'status:1']) AS one_of, list_has_any(terms, ['kind:7']) OR list_has_any(terms, ['kind:8', 'status:-1']) AS any_of FROM t""")
def retrieval_index_groups(spark, d):
    e = table(spark, d, "context_event").filter("node_hash is not null")
    terms = F.array(F.concat(F.lit("kind:"), F.col("event_type").cast("string")), F.concat(F.lit("status:"), F.coalesce("status", F.lit(-1)).cast("string")))
    t = e.select("node_hash", F.explode(terms).alias("t")).groupBy("node_hash").agg(F.collect_set("t").alias("terms"))
    return t.select("node_hash", retrieval.index_filter(F.col("terms"), [["kind:2", "status:1"]]).alias("one_of"), retrieval.index_filter(F.col("terms"), [["kind:7"], ["kind:8", "status:-1"]]).alias("any_of"))


def _memory(spark, d):
    """Node names as memories: all added, those ending in 4 written again, those ending in 7 deleted, one scope forgotten."""
    n = table(spark, d, "context_node").select(F.col("node_hash").cast("string").alias("key"), F.col("kind").cast("string").alias("scope"), F.coalesce("l0", "canonical_name").alias("text"), F.col("last_event_time_ms").alias("updated_at_ms"))
    log = n.withColumn("seq", F.lit(1).cast("bigint")).withColumn("deleted", F.lit(False))
    m = memory.Memory(log.select("seq", "key", "scope", "text", "updated_at_ms", "deleted"))
    return m.add(n.filter("key like '%4'").withColumn("text", F.concat(F.lit("again "), "text"))).delete(n.filter("key like '%7'")).forget("3")


KEPT = """SELECT CAST(node_hash AS VARCHAR) AS key, CAST(kind AS VARCHAR) AS scope, CASE WHEN CAST(node_hash AS VARCHAR) LIKE '%4' THEN 'again ' ELSE '' END || coalesce(l0, canonical_name) AS text, last_event_time_ms AS updated_at_ms
  FROM context_node WHERE CAST(node_hash AS VARCHAR) NOT LIKE '%7' AND coalesce(kind <> 3, true)"""


@query(KEPT)
def memory_get_all(spark, d):
    return _memory(spark, d).get_all().select("key", "scope", "text", "updated_at_ms")


@query(f"""SELECT key, text, match FROM (SELECT *, round((CAST(contains(lower(text), 'again') AS INT) + CAST(contains(lower(text), 'team') AS INT)) / 2.0, 6) AS match FROM ({KEPT})) WHERE match > 0
  ORDER BY match DESC, updated_at_ms DESC NULLS LAST, key LIMIT 10""")
def memory_search(spark, d):
    return _memory(spark, d).search(["again", "team"], 10).select("key", "text", F.round("match", 6).alias("match"))


@query("""WITH n AS (SELECT CAST(node_hash AS VARCHAR) AS key, kind FROM context_node), k AS (SELECT key, CASE WHEN key LIKE '%4' THEN 2 ELSE 1 END + CASE WHEN key LIKE '%7' OR coalesce(kind = 3, false) THEN 1 ELSE 0 END AS changes,
    CASE WHEN key LIKE '%7' OR coalesce(kind = 3, false) THEN 'delete' WHEN key LIKE '%4' THEN 'update' ELSE 'add' END AS last FROM n) SELECT key, changes, last FROM k""")
def memory_histories(spark, d):
    """Of every key the number of its changes and the last one."""
    h = _memory(spark, d).histories()
    return h.groupBy("key").agg(F.count(F.lit(1)).alias("changes"), F.max_by("event", "seq").alias("last"))


@query(r"""WITH u AS (SELECT session_id AS conv_id, row_id, ts_ms, coalesce(content, '') AS text, regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') AS said FROM chat_message WHERE session_id IS NOT NULL AND lower(trim(role)) = 'user'),
  b AS (SELECT *, array_to_string(list(said) OVER (PARTITION BY conv_id ORDER BY ts_ms NULLS FIRST, row_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' ') AS before FROM u WHERE said <> '')
  SELECT conv_id, row_id, CASE WHEN coalesce(before, '') <> '' AND (
      regexp_matches(text, '(?i)\b(that|it|this|those|these|they|them|its|their|there|the ones?|the two|the same|the fix|the change|the issue|the above|the whole)\b')
      OR regexp_matches(text, '(?i)^\s*(summariz|recap|tl;?dr|continue|elaborat|expand|go on|tell me more|more on|and\b)')
      OR (len(regexp_split_to_array(said, '\s+')) <= 14 AND regexp_matches(text, '(?i)^\s*(and|so|then|also|but|plus|why|what about|whats?\s+about|ok|okay)\b')))
    THEN left(regexp_replace(concat(before, ' ', text), '^\s+|\s+$', '', 'g'), 600) ELSE text END AS rewritten FROM b
  UNION ALL SELECT conv_id, row_id, text FROM u WHERE said = ''""")
def follow_up_rewrite(spark, d):
    c = table(spark, d, "chat_message").filter("session_id is not null").select(F.col("session_id").alias("conv_id"), F.struct("ts_ms", "row_id").alias("turn"), F.lower(F.trim("role")).alias("role"), F.coalesce("content", F.lit("")).alias("text"))
    return retrieval.rewrite_follow_up(c).select("conv_id", "turn.row_id", "rewritten")


@query("""SELECT node_hash, CASE WHEN contains(l0, 'the') THEN regexp_replace(l0, 'the', 'a certain') END AS patched FROM context_node WHERE contains(coalesce(l0, 'the'), 'the')""")
def entity_patch(spark, d):
    """Node summaries that hold a phrase, with its first place replaced; near spans are held against a plain program in the tests."""
    n = table(spark, d, "context_node").select("node_hash", "l0").filter("coalesce(l0, 'the') like '%the%'")
    return content.patched(n, "l0", "the", "a certain").select("node_hash", "patched")


@query()
def entity_patch_near(spark, d):
    """Every node summary with the span nearest to a phrase replaced."""
    return content.patched(table(spark, d, "context_node").select("node_hash", "l0"), "l0", "shared state", "common state").select("node_hash", "patched")
