"""Registered queries over the record log's tombstones, segments, lanes, budgets and expiring selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import tables
from tidemark.operators import content, counters, decisions, memory_log, pipeline
from tidemark.operators import joins
from tidemark.plans.context_store import END
from tidemark.plans.temporal import DAY
from tidemark.plans.temporal import START as FIRST
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


def _log(spark, d):
    """Events as records; every seventh is derived from its predecessors."""
    i = F.col("delivery_id")
    sources = F.when(i % 7 == 0, F.array((i - 1).cast("string"))).when(i % 7 == 1, F.array((i - 1).cast("string"), (i - 2).cast("string")))
    return table(spark, d, "context_event").select(i.alias("seq"), i.cast("string").alias("record_id"), "tenant", (F.col("batch_id") % 9).cast("string").alias("user_id"), sources.alias("sources"), "ts_ms")


def _tombstones(spark, d):
    i = F.col("delivery_id")
    e = table(spark, d, "context_event")
    gone = e.filter(i % 10 == 3).select((i + 4).alias("seq"), F.lit("delete").alias("kind"), i.cast("string").alias("target_id"), "tenant", F.lit(None).cast("string").alias("user_id"))
    left = e.filter(i % 5_000 == 17).select(i.alias("seq"), F.lit("forget").alias("kind"), F.lit(None).cast("string").alias("target_id"), "tenant", (F.col("batch_id") % 9).cast("string").alias("user_id"))
    anew = e.filter(i % 9_000 == 23).select(i.alias("seq"), F.lit("reset").alias("kind"), F.lit(None).cast("string").alias("target_id"), "tenant", F.lit(None).cast("string").alias("user_id"))
    return gone.unionByName(left).unionByName(anew)


LOG = """SELECT delivery_id AS seq, CAST(delivery_id AS VARCHAR) AS record_id, tenant, CAST(batch_id % 9 AS VARCHAR) AS user_id, CASE WHEN delivery_id % 7 = 0 THEN CAST(delivery_id - 1 AS VARCHAR) END AS only, ts_ms FROM context_event"""
GONE = """SELECT delivery_id + 4 AS seq, 'delete' AS kind, CAST(delivery_id AS VARCHAR) AS target_id, tenant, NULL AS user_id FROM context_event WHERE delivery_id % 10 = 3
  UNION ALL SELECT delivery_id, 'forget', NULL, tenant, CAST(batch_id % 9 AS VARCHAR) FROM context_event WHERE delivery_id % 5000 = 17 UNION ALL SELECT delivery_id, 'reset', NULL, tenant, NULL FROM context_event WHERE delivery_id % 9000 = 23"""
ALIVE = f"""SELECT * FROM ({LOG}) r WHERE NOT EXISTS (SELECT 1 FROM ({GONE}) t WHERE t.kind = 'delete' AND t.target_id = r.record_id AND t.seq >= r.seq) AND NOT EXISTS (SELECT 1 FROM ({GONE}) t WHERE t.kind = 'delete' AND t.target_id = r.only AND t.seq >= r.seq)
  AND NOT EXISTS (SELECT 1 FROM ({GONE}) t WHERE t.kind = 'forget' AND t.tenant = r.tenant AND t.user_id = r.user_id AND t.seq >= r.seq) AND NOT EXISTS (SELECT 1 FROM ({GONE}) t WHERE t.kind = 'reset' AND t.tenant = r.tenant AND t.seq >= r.seq)"""


@query(f"SELECT seq FROM ({ALIVE})")
def memory_surviving(spark, d):
    return memory_log.surviving(_log(spark, d), _tombstones(spark, d)).select("seq")


@query(f"""SELECT session_id, least(count(*), 30) AS pending, CASE WHEN count(*) >= 25 THEN 'threshold' ELSE 'idle' END AS reason FROM (SELECT CAST(CAST(record_id AS BIGINT) % 400 AS VARCHAR) AS session_id, ts_ms FROM ({ALIVE})) GROUP BY 1
  HAVING count(*) >= 25 OR max(ts_ms) < {END} - 900000""")
def memory_committable(spark, d):
    """Sessions with enough surviving events, or quiet for long."""
    log = _log(spark, d)
    pending = log.select((F.col("seq") % 400).cast("string").alias("session_id"), "record_id", "ts_ms")
    return memory_log.committable(pending, log, _tombstones(spark, d), END, 25, most=30)


@query("SELECT delivery_id AS seq FROM context_event WHERE NOT coalesce(tenant = (SELECT min(tenant) FROM context_event) AND CAST(batch_id % 9 AS VARCHAR) = '4', false)")
def memory_forget_scope(spark, d):
    log = _log(spark, d)
    return memory_log.forget(log, {"tenant": log.agg(F.min("tenant")).first()[0], "user_id": "4"})[0].select("seq")


_TOPIC = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(low, {w!r})' for w in words.split('|'))} THEN '{name}'" for name, words in [
    ("recursion", "recursion|recursive|base case|merge sort|call stack"), ("game_algorithm", "game|minimax|alpha beta|pathfinding|npc"), ("preference", "prefer|favorite|likes|loves"), ("location", "moved|moving|located|location|live|lives|staying"),
    ("approval_budget", "approved|approval|budget|cost|purchase"), ("incident_runbook", "incident|runbook|alert|outage|rollback|postmortem"), ("task_decision", "decision|decided|owner|owns|deadline|checklist|reviewer|require|requires|required"),
    ("metric_sla", "metric|latency|p95|p99|qps|sla|error rate"), ("plan_status", "plan|current|status|going to|will"), ("correction", "correction|instead|wrong|changed|updated")]) + " ELSE coalesce(nullif(regexp_extract(low, '([a-z0-9_]{5,})', 1), ''), 'general') END"
_SALIENT = r"""CASE WHEN plain IN ('hi', 'hello', 'hey', 'thanks', 'thank you', 'ok', 'okay', 'cool', 'great', 'sounds good') OR length(plain) < 8 THEN 0.0 ELSE round(least(1.0, 0.2
    + CASE WHEN regexp_matches(low, '\b(recursion|base case|merge sort|algorithm|complexity|efficiency|dynamic programming|graph|game)\b') THEN 0.55 ELSE 0 END
    + CASE WHEN regexp_matches(low, '\b(prefer|favorite|approved|budget|plan|correction|instead|current|remember|important|moved|moving|located|location|live|lives)\b') THEN 0.45 ELSE 0 END
    + CASE WHEN regexp_matches(low, '\b(is|means|because|therefore|warning|avoid|must|should|cannot|can|require|requires|required|blocked|blocker)\b') THEN 0.2 ELSE 0 END
    + CASE WHEN regexp_matches(low, '\b(\d{2,}|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december)\b') THEN 0.1 ELSE 0 END
    + CASE WHEN len(regexp_extract_all(low, '[a-z0-9_]+')) >= 8 THEN 0.15 ELSE 0 END), 6) END"""


@query(rf"""WITH m AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms NULLS FIRST, row_id) AS idx, lower(trim(coalesce(content, ''))) AS low FROM chat_message WHERE session_id IS NOT NULL),
  p AS (SELECT *, trim(regexp_replace(low, '[^a-z0-9 ]+', '', 'g')) AS plain FROM m), s AS (SELECT session_id, idx, CAST({_SALIENT} AS DOUBLE) AS s, {_TOPIC} AS topic FROM p), k AS (SELECT * FROM s WHERE s >= 0.5),
  g AS (SELECT *, idx - row_number() OVER (PARTITION BY session_id, topic ORDER BY idx) AS run FROM k), r AS (SELECT session_id, topic, min(idx) AS a, max(idx) AS b, count(*) AS n, sum(s) AS t FROM g GROUP BY session_id, topic, run),
  w AS (SELECT session_id, topic, string_agg(a || '-' || b, ',' ORDER BY a) AS ranges, CAST(sum(n) AS BIGINT) AS n, round(sum(t) / sum(n), 6) AS saliency FROM r GROUP BY 1, 2)
  SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY saliency DESC, topic) <= 12""")
def content_topic_segments(spark, d):
    from pyspark.sql import Window as W

    c = table(spark, d, "chat_message").filter("session_id is not null").withColumn("idx", F.row_number().over(W.partitionBy("session_id").orderBy(F.col("ts_ms").asc_nulls_first(), "row_id")))
    return content.topic_segments(c, "session_id", "idx", "content")


@query()
def content_token_chunks(spark, d):
    """Held against a plain program in the tests."""
    return content.token_chunks(table(spark, d, "documents")).select("doc_id", "chunk", "first_token", "n_tokens")


@query("""WITH t AS (SELECT DISTINCT tenant, ref_hash, term FROM (SELECT tenant, ref_hash, unnest(['type:' || ref_type, 'path:' || coalesce(recall_path, ''), 'node:' || coalesce(node_hash, 0) % 5, 'query:' || query_id % 11]) AS term FROM context_ref)),
  p AS (SELECT *, CASE WHEN term LIKE 'node:%' THEN 0 WHEN term LIKE 'type:%' THEN 1 ELSE 2 END AS pr, CASE WHEN term LIKE 'type:%' THEN 0 WHEN term LIKE 'path:%' THEN 1 WHEN term LIKE 'node:%' THEN 2 ELSE 3 END AS "at" FROM t),
  o AS (SELECT *, row_number() OVER (PARTITION BY tenant, ref_hash ORDER BY pr, "at", term) AS r FROM p), f AS (SELECT *, CASE WHEN r <= 2 THEN row_number() OVER (PARTITION BY tenant, r <= 2 ORDER BY ref_hash, r) END AS o FROM o)
  SELECT tenant, ref_hash, term, "at", coalesce(o <= 100, false) AS kept FROM f""")
def index_budget(spark, d):
    """Index terms of every ref under the caps of record and operation."""
    r = table(spark, d, "context_ref")
    terms = F.array(F.concat(F.lit("type:"), "ref_type"), F.concat(F.lit("path:"), F.coalesce("recall_path", F.lit(""))), F.concat(F.lit("node:"), F.coalesce("node_hash", F.lit(0)) % 5), F.concat(F.lit("query:"), F.col("query_id") % 11))
    flat = r.select("tenant", "ref_hash", F.posexplode(terms).alias("at", "term"))
    return content.budgeted_terms(flat, "ref_hash", "tenant", "term", "at", ["node:", "type:"], 2, 100)


ASK = "Which runbook did the planner review?"
_SHARE = "({}) / 4.0".format(" + ".join(f"CAST(contains({{0}}, '{t}') AS INT)" for t in ("runbook", "did", "planner", "review")))


def _scanned(spark, d):
    e = table(spark, d, "context_event")
    return e.select(F.col("delivery_id").alias("seq"), "node_hash", "text", F.array(F.lit("team"), F.concat(F.lit("node"), F.col("event_type"))).alias("path"), F.array(F.lit("source_type:message"), F.concat(F.lit("event_type:"), F.col("event_type"))).alias("terms"),
                    F.when(F.col("event_type") == 2, "review").otherwise("note").alias("kind"), F.col("confidence").cast("double").alias("dense"))


@query(f"""WITH r AS (SELECT delivery_id AS seq, text, confidence, event_type, lower(coalesce(text, '')) AS low FROM context_event QUALIFY row_number() OVER (PARTITION BY node_hash ORDER BY delivery_id DESC) <= 40),
  g AS (SELECT *, lower('team node' || event_type || ' event_type:' || event_type || ' source_type:message ' || CASE WHEN event_type = 2 THEN 'review' ELSE 'note' END || coalesce(' ' || text, '')) AS all_of,
    CAST(len(list_intersect(list_distinct(list_filter(regexp_split_to_array(low, '[^0-9a-z]+'), lambda w: length(w) >= 3)), ['runbook', 'did', 'planner', 'review'])) AS INT) AS keyword_score FROM r),
  l AS (SELECT seq, keyword_score, round(0.55e0 * least(1e0, greatest(0e0, coalesce(CAST(confidence AS DOUBLE), 0))) + 0.35e0 * {_SHARE.format('low')} + 0.10e0 * 0.5e0, 6) AS origin_score, 'primary_hybrid' AS recall_path FROM g
    UNION ALL SELECT seq, keyword_score, round({_SHARE.format('all_of')}, 6), 'auxiliary_keyword_graph' FROM g) SELECT * FROM l WHERE origin_score > 0""")
def retrieval_scan_lanes(spark, d):
    return pipeline.scan_lanes(_scanned(spark, d), ASK, dense=F.col("dense"), node=F.lit(0.5), per_node=40).select("seq", "keyword_score", "origin_score", "recall_path")


# -- counters --------------------------------------------------------------------------------------------------------
def _buckets(spark, d):
    e = table(spark, d, "events")
    inc = e.select(F.lit("h").alias("family"), F.col("user_id").cast("string").alias("key"), schemas.epoch_ms("ts").alias("ts_ms"), F.floor("value").cast("bigint").alias("amount"), F.col("event_id").alias("seq"))
    return counters.buckets(inc, 86_400_000)


B = "SELECT 'h' AS family, CAST(user_id AS VARCHAR) AS key, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 86400000 AS bucket_ms, CAST(sum(floor(value)) AS BIGINT) AS amount FROM events GROUP BY ALL"
AT = [FIRST, FIRST + DAY]


@query(f"SELECT * FROM ({B}) WHERE bucket_ms IN ({AT[0]}, {AT[1]})")
def control_manager_values(spark, d):
    return counters.manager(_buckets(spark, d), "2", at=AT)


@query(f"SELECT family, key, count(*) AS fields FROM ({B}) WHERE bucket_ms BETWEEN {AT[0]} AND {AT[1]} GROUP BY 1, 2")
def control_manager_count(spark, d):
    return counters.manager(_buckets(spark, d), "6", AT[0], AT[1])


@query(f"SELECT * FROM ({B})")
def control_manager_all(spark, d):
    return counters.manager(_buckets(spark, d), "7")


@query(f"""WITH w AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, (epoch_us(ts) // 1000) AS made, CASE WHEN event_id % 4 = 0 THEN 864000000 ELSE 0 END AS ttl, event_id FROM events),
  u AS (SELECT key, arg_max(made + ttl, event_id) FILTER (ttl > 0) AS until FROM w GROUP BY 1)
  SELECT key, arg_max(value, made) AS value, max(made) AS occur_time_ms FROM w WHERE key NOT IN (SELECT key FROM u WHERE until <= {FIRST + DAY * 30}) GROUP BY 1""")
def control_selection_expiring(spark, d):
    """Last values of keys whose time to live has not run out; half the writes name no time of their own."""
    at = schemas.epoch_ms("ts")
    w = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.when(F.col("event_id") % 2 == 0, 0).otherwise(at).alias("occur_time_ms"), at.alias("made_ms"), F.when(F.col("event_id") % 4 == 0, 864_000_000).otherwise(0).alias("ttl_ms"), F.col("event_id").alias("seq"))
    return counters.selection_at(w, "last", FIRST + DAY * 30)


@query("""WITH r AS (SELECT user_id, event_id % 5 AS id, CAST(floor(value) AS BIGINT) AS v1, event_id % 2 AS slot FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 10),
  g AS (SELECT user_id, CAST(id AS VARCHAR) AS id, CAST(sum(v1) AS BIGINT) AS total FROM r WHERE slot = 1 GROUP BY 1, 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY total DESC, id) <= 2""")
def instance_top_by_slot(spark, d):
    """Top features of one slot over the last ten views."""
    i = F.col("event_id")
    feature = F.array(F.struct((i % 5).cast("string").alias("id"), F.floor("value").cast("bigint").alias("v1"), (i % 2).cast("int").alias("slot")))
    e = table(spark, d, "events").select("user_id", "event_type", schemas.epoch_ms("ts").alias("ts_ms"), feature.alias("features"))
    return decisions.last_instances(e, "user_id", 10, 2, "features", where=F.col("event_type") == "view", slot=1)


@query(f"""SELECT CAST(node_hash AS VARCHAR) AS scope, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(ts_ms) AS marks, CASE WHEN max(ts_ms) <= {END} - 3600000 THEN 'quiet' ELSE 'waited' END AS reason FROM context_event
  WHERE node_hash IS NOT NULL AND ts_ms BETWEEN {END - 86_400_000 * 30} AND {END} GROUP BY 1 HAVING max(ts_ms) <= {END} - 3600000 OR min(ts_ms) <= {END} - 86400000""")
def memory_due_flushes(spark, d):
    e = table(spark, d, "context_event").filter(F.col("ts_ms").between(END - 86_400_000 * 30, END)).select(F.col("node_hash").cast("string").alias("scope"), "ts_ms")
    return memory_log.due_flushes(e, END, 3_600_000, 86_400_000)


# -- joins on time, grouping sets, table functions -------------------------------------------------------------------
def _visits(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", F.col("event_id").alias("point"), schemas.epoch_ms("ts").alias("at"))


V = "SELECT user_id, event_id AS point, (epoch_us(ts) // 1000) AS at FROM events"


@query(f"""WITH r AS (SELECT user_id, point AS rng, "at" AS s, "at" + (point % 5) * 43200000 AS e FROM ({V}) WHERE point % 11 = 0) SELECT p.user_id, point, rng FROM ({V}) p JOIN r ON r.user_id = p.user_id AND p."at" BETWEEN s AND e""")
def join_range(spark, d):
    v = _visits(spark, d)
    ranges = v.filter("point % 11 = 0").select("user_id", F.col("point").alias("rng"), F.col("at").alias("s"), (F.col("at") + (F.col("point") % 5) * 43_200_000).alias("e"))
    return joins.range_join(v, ranges, ["user_id"], "at", "s", "e", DAY).select("user_id", "point", "rng")


@query(f"""WITH i AS (SELECT user_id, point, "at" AS s, "at" + (point % 4) * 86400000 AS e FROM ({V})) SELECT a.user_id, a.point AS a, b.point AS b FROM i a JOIN i b ON a.user_id = b.user_id AND a.point % 13 = 0 AND b.point % 7 = 0 AND a.s <= b.e AND b.s <= a.e""")
def join_overlap(spark, d):
    i = _visits(spark, d)
    a = i.filter("point % 13 = 0").select("user_id", F.col("point").alias("a"), F.col("at").alias("s"), (F.col("at") + (F.col("point") % 4) * DAY).alias("e"))
    b = i.filter("point % 7 = 0").select("user_id", F.col("point").alias("b"), F.col("at").alias("s2"), (F.col("at") + (F.col("point") % 4) * DAY).alias("e2"))
    return joins.overlap_join(a, b, ["user_id"], "s", "e", "s2", "e2", DAY).select("user_id", "a", "b")


@query(f"""WITH f AS (SELECT user_id, "at", max(point) AS fact FROM ({V}) WHERE point % 3 = 0 GROUP BY 1, 2) SELECT p.user_id, p.point, f.fact FROM ({V}) p ASOF LEFT JOIN f ON f.user_id = p.user_id AND p."at" >= f."at" """)
def join_as_of(spark, d):
    v = _visits(spark, d)
    facts = v.filter("point % 3 = 0").select("user_id", F.col("at").alias("told"), F.col("point").alias("fact"))
    return joins.as_of_join(v, facts, ["user_id"], "at", "told", ["fact"]).select("user_id", "point", "fact")


@query("""SELECT user_id, event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS amount, CAST(grouping(user_id, event_type) AS BIGINT) AS level FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id), (event_type), ())""")
def rollup_grouping_sets(spark, d):
    """Counts and sums at four levels in one pass."""
    e = table(spark, d, "events")
    sets = [[F.col("user_id"), F.col("event_type")], [F.col("user_id")], [F.col("event_type")], []]
    return e.groupingSets(sets, "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).cast("bigint").alias("amount"), F.grouping_id().cast("bigint").alias("level"))


@query()
def content_chunks_in_sql(spark, d):
    """The chunker as a table function; held against ``content_chunks`` in the tests."""
    tables.register(spark)
    return table(spark, d, "documents").lateralJoin(tables.TextChunks(F.col("text").outer())).select("doc_id", "chunk", "path", "level", "start", "stop")
