"""Registered queries of query understanding, candidate scan, scoring, packing and injection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pipeline, understanding
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


@query(r"""WITH t AS (SELECT row_id, content, list_filter(regexp_split_to_array(lower(content), '[^0-9a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'what', 'when', 'where', 'which',
    'who', 'why', 'how', 'about', 'would', 'likely', 'still', 'considered', 'consider', 'more', 'benchmark', 'context', 'memory', 'conversation', 'dialogue', 'question')) AS w FROM chat_message)
  SELECT row_id, array_to_string(w, ' ') AS terms, CASE WHEN content IS NULL THEN NULL WHEN len(w) = 0 THEN 'match_all'
    WHEN list_has_any(w, ['correction', 'corrected', 'correct', 'changed', 'updated', 'now', 'avoid', 'latest', 'recent', 'current', 'currently', 'update', 'status', 'switch', 'switched', 'switching', 'change', 'moved', 'move', 'became',
      'instead', 'cancel', 'cancelled', 'canceled']) THEN 'current_state'
    WHEN list_has_any(w, ['before', 'after', 'during', 'timeline', 'temporal', 'history', 'date', 'time', 'schedule', 'scheduled', 'reschedule', 'rescheduled', 'appointment', 'meeting', 'deadline', 'calendar', 'tomorrow', 'tonight'])
      THEN 'temporal_reasoning'
    WHEN list_has_any(w, ['many', 'count', 'number', 'quantity', 'total', 'amount', 'score', 'percent', 'percentage']) THEN 'quantity'
    WHEN list_has_any(w, ['friend', 'coworker', 'colleague', 'teammate', 'recommend', 'recommended', 'suggest', 'suggested', 'introduced', 'referred', 'because']) THEN 'relationship'
    WHEN list_has_any(w, ['roommate', 'housemate', 'manager', 'supervisor', 'lead', 'owner', 'name', 'named', 'called', 'pet', 'dog', 'cat']) THEN 'identity_or_alias'
    WHEN list_has_any(w, ['cause', 'root']) THEN 'causal_reasoning' ELSE 'semantic_recall' END AS question_type FROM t""")
def query_question_types(spark, d):
    """What every chat message asks for, and its terms."""
    c = F.col("content")
    return table(spark, d, "chat_message").select("row_id", F.array_join(understanding.terms_of(c), " ").alias("terms"), understanding.question_types(c).alias("question_type"))


@query(r"""WITH k AS (SELECT row_id, content, CASE WHEN content IS NULL THEN NULL
    WHEN regexp_matches(lower(content), '\b(benchmark|workload|latency|p50|p90|p95|p99|throughput|qps|ops/s|req/s|hit[- ]?rate|read[- ]?hit|quality|recall|precision|locomo|longmemeval|memory[- ]?quality)\b') THEN 'benchmark_quality'
    WHEN regexp_matches(lower(content), '\b(both|together|across|between|compare|combine|sessions|multi-hop|multi session|multi-session|cross session|cross-session|previous sessions|other sessions)\b') THEN 'multi_hop'
    WHEN regexp_matches(lower(content), '\b(when|what date|which date|day|month|year|yesterday|tomorrow|last week|next week|before|after|as of|valid as of)\b') THEN 'date'
    WHEN regexp_matches(lower(content), '\b(current|currently|latest|now|still|today|valid|status|preference|prefer|likes|where does|where is|goal|task|requirement)\b') THEN 'current_state'
    WHEN regexp_matches(lower(content), '\b(why|reason|because|feel|felt|emotion|happy|sad|angry|worried|excited)\b') THEN 'why_emotion'
    WHEN regexp_matches(lower(content), '\b(overview|summarize|summary|explore|broad|what is in|what do we know|topics|map|inventory)\b') THEN 'broad_exploration'
    WHEN regexp_matches(lower(content), '\b(evidence|quote|exactly|what did .* say|conversation|dialogue|message)\b') THEN 'evidence'
    WHEN regexp_matches(lower(content), '\b(procedure|steps?|how to|troubleshoot|debug|rollback|runbook|playbook|checklist|fix|remediate|mitigate)\b') THEN 'procedure' ELSE 'fact' END AS kind FROM chat_message)
  SELECT row_id, kind, CASE WHEN content IS NULL THEN NULL WHEN kind = 'current_state' OR regexp_matches(lower(content), '\b(current|currently|latest|now|still|today|valid)\b') THEN 'latest'
    WHEN regexp_matches(lower(content), '\b(before|prior to|earlier than)\b') THEN 'before' WHEN regexp_matches(lower(content), '\b(after|since|later than)\b') THEN 'after'
    WHEN regexp_matches(lower(content), '\b(as of|valid as of|on)\b') THEN 'valid_as_of'
    WHEN regexp_matches(lower(content), '\b(yesterday|tomorrow|last week|next week|last month|next month|last year|next year)\b') THEN 'relative' ELSE 'unbounded' END AS time_mode FROM k""")
def query_kinds(spark, d):
    """Serving kind and time window of every chat message."""
    c = F.col("content")
    return table(spark, d, "chat_message").select("row_id", understanding.kinds_of_questions(c).alias("kind"), understanding.time_modes(c).alias("time_mode"))


ASK = "When was the latest deadline moved after the session, and how many notes changed?"
#: The groups of that query, written out for its SQL.
GROUPS = [
    ["was"], ["latest", "status", "update", "updated"], ["calendar", "date", "deadline", "schedule", "time"], ["changed", "moved", "relocated", "switched"], ["after", "sequence", "temporal", "timeline"],
    ["conversation", "dialogue", "session", "visit"], ["amount", "many", "total"], ["not", "notes"], ["changed", "switched", "update", "updated"],
]
PHRASES = ["was latest", "latest deadline", "deadline moved", "moved after", "after session", "session many", "many notes", "notes changed"]
MARKS = [
    ("latest|recent|current|updated|changed|replaced", 75), ("timeline|temporal|history|sequence|before|after|during", 50), ("after|later|latest|new|current|update|moved to", 65), ("before|earlier|old", -25),
    ("correction|corrected|no longer|instead|replaced|now", 90), ("switched|switch|moved|became|instead|no longer|changed from", 85), ("rescheduled|scheduled|moved to|appointment|deadline|calendar|at |on ", 80),
    ("[0-9]|count|total|number|score|amount|quantity", 80),
]


def _has(term: str) -> str:
    flat = term.strip()
    return f"(contains(low, '{term}') OR contains(flat, '{flat}'))" if " " in term else f"contains(low, '{term}')"


def _relevance_sql() -> str:
    best = [f"greatest({', '.join(f'CASE WHEN {_has(t)} THEN {len(t)} ELSE 0 END' for t in g)}, 0)" for g in GROUPS]
    score = " + ".join(best) + f" + CASE WHEN hits = {len(GROUPS)} THEN 100 WHEN hits > 1 THEN hits * 12 ELSE 0 END" + "".join(f" + CASE WHEN {_has(p)} THEN 50 ELSE 0 END" for p in PHRASES)
    sql = f"SELECT doc_id, low, flat, {score} AS s0 FROM (SELECT *, {' + '.join(f'CAST({b} > 0 AS INT)' for b in best)} AS hits FROM (SELECT doc_id, lower(text) AS low, regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g') AS flat FROM documents))"
    for k, (marks, worth) in enumerate(MARKS):
        seen = " OR ".join("regexp_matches(low, '[0-9]')" if m == "[0-9]" else _has(m) for m in marks.split("|"))
        sql = f"SELECT doc_id, low, flat, CASE WHEN {seen} THEN greatest(s{k} + {worth}, 0) ELSE s{k} END AS s{k + 1} FROM ({sql})"
    return f"SELECT doc_id, CAST(s{len(MARKS)} AS INT) AS score FROM ({sql})"


@query(_relevance_sql())
def retrieval_relevance(spark, d):
    """How well every document answers one query."""
    return table(spark, d, "documents").select("doc_id", understanding.relevance(F.col("text"), understanding.plan(ASK)).alias("score"))


@query(f"SELECT doc_id, {' OR '.join(_has(t) for t in ['checkout', 'billing', 'payment', 'purchase', 'risk', 'fraud', 'safety', 'score', 'topic 7'])} AS matches FROM (SELECT doc_id, lower(text) AS low, regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g') AS flat FROM documents)")
def retrieval_prefilter(spark, d):
    p = understanding.plan("payment risk")
    p.topic = "topic 7"
    return table(spark, d, "documents").select("doc_id", understanding.matches(F.col("text"), p).alias("matches"))


def _records(spark, d):
    """Events, documents and node summaries as records."""
    null = lambda t: F.lit(None).cast(t)
    e = table(spark, d, "context_event").select(
        F.col("delivery_id").alias("ref_hash"), F.lit("context_event").alias("record_type"), "tenant", F.concat(F.lit("s"), F.col("batch_id") % 50).alias("session_id"), "node_hash", F.col("batch_id"), "text",
        F.length("text").cast("bigint").alias("tokens"), "ts_ms", F.col("event_type").cast("string").alias("event_type"), null("string").alias("entity_type"), null("string").alias("resource_type"))
    r = table(spark, d, "documents").select(
        F.col("doc_id").alias("ref_hash"), F.lit("resource_chunk").alias("record_type"), "tenant", null("string").alias("session_id"), "node_hash", null("bigint").alias("batch_id"), "text", F.col("n_chars").alias("tokens"),
        null("bigint").alias("ts_ms"), null("string").alias("event_type"), null("string").alias("entity_type"), "resource_type")
    n = table(spark, d, "context_node").select(
        F.col("node_hash").alias("ref_hash"), F.lit("context_summary").alias("record_type"), "tenant", null("string").alias("session_id"), "node_hash", null("bigint").alias("batch_id"), F.col("l0").alias("text"),
        F.length("l0").cast("bigint").alias("tokens"), F.col("last_event_time_ms").alias("ts_ms"), null("string").alias("event_type"), null("string").alias("entity_type"), null("string").alias("resource_type"))
    return e.unionByName(r).unionByName(n)


RECORDS = """SELECT delivery_id AS ref_hash, 'context_event' AS record_type, tenant, 's' || batch_id % 50 AS session_id, node_hash, batch_id, text, length(text) AS tokens, CAST(event_type AS VARCHAR) AS event_type, NULL AS resource_type FROM context_event
  UNION ALL SELECT doc_id, 'resource_chunk', tenant, NULL, node_hash, NULL, text, n_chars, NULL, resource_type FROM documents
  UNION ALL SELECT node_hash, 'context_summary', tenant, NULL, node_hash, NULL, l0, length(l0), NULL, NULL FROM context_node"""


def _postings(spark, d):
    """Statuses as terms of a node, importance as terms of a ref."""
    e = table(spark, d, "context_event")
    null = F.lit(None).cast("bigint")
    by_node = e.filter("status is not null").select(F.concat(F.lit("status:"), F.col("status")).alias("index_name"), null.alias("batch_id"), "node_hash", null.alias("ref_hash"))
    by_ref = e.filter("importance > 0.9").select(F.lit("importance:high").alias("index_name"), "batch_id", "node_hash", F.col("delivery_id").alias("ref_hash"))
    return by_node.unionByName(by_ref)


WANTED = [["event_type:2", "event_type:5"], ["status:3", "importance:high"], ["resource_type:runbook"]]
TYPES = ["context_event", "resource_chunk"]


@query(f"""WITH n AS (SELECT node_hash, true AS any_term, bool_or(status = 3) AS hit FROM context_event WHERE status IS NOT NULL AND node_hash IS NOT NULL GROUP BY 1),
  b AS (SELECT DISTINCT batch_id FROM context_event WHERE importance > 0.9 AND batch_id IS NOT NULL), f AS (SELECT DISTINCT delivery_id FROM context_event WHERE importance > 0.9),
  r AS (SELECT r.*, coalesce(n.hit, false) OR b.batch_id IS NOT NULL OR f.delivery_id IS NOT NULL OR coalesce(event_type IN ('2', '5'), false) OR coalesce(resource_type = 'runbook', false) AS hit,
      coalesce(n.any_term, false) OR b.batch_id IS NOT NULL OR f.delivery_id IS NOT NULL OR record_type <> 'context_summary' AS any_term
    FROM ({RECORDS}) r LEFT JOIN n ON n.node_hash = r.node_hash LEFT JOIN b ON b.batch_id = r.batch_id LEFT JOIN f ON f.delivery_id = r.ref_hash)
  SELECT ref_hash, record_type, CASE WHEN record_type = 'context_summary' THEN 'type' WHEN tenant <> (SELECT min(tenant) FROM context_node) THEN 'scope' WHEN any_term AND NOT hit THEN 'index' END AS dropped FROM r""")
def retrieval_scan(spark, d):
    """Every record with the first check it fails."""
    tenant = table(spark, d, "context_node").agg(F.min("tenant")).first()[0]
    return pipeline.scan(_records(spark, d), _postings(spark, d), TYPES, {"tenant": tenant}, None, WANTED).select("ref_hash", "record_type", "dropped")


@query("SELECT CASE WHEN record_type = 'context_summary' THEN 'type' END AS dropped, count(*) AS n FROM (" + RECORDS + ") GROUP BY 1")
def retrieval_scan_counters(spark, d):
    return pipeline.scan_counters(pipeline.scan(_records(spark, d), None, TYPES))


SCORE = "Which runbook did the team review before the planner moved?"
SCORE_TERMS = ["runbook", "did", "team", "review", "before", "planner", "moved"]


@query(f"""SELECT ref_hash, record_type, continuity, round(({' + '.join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in SCORE_TERMS)}) / {len(SCORE_TERMS)}.0
    + CASE continuity WHEN 'same_session' THEN CASE record_type WHEN 'context_event' THEN 0.16 WHEN 'context_summary' THEN 0.12 ELSE 0.08 END WHEN 'cross_session' THEN CASE record_type WHEN 'context_event' THEN 0.06 ELSE 0.0 END ELSE 0.0 END
    + CASE WHEN continuity = 'cross_session' AND record_type = 'context_summary' THEN 0.02 ELSE 0.0 END + CASE record_type WHEN 'resource_chunk' THEN 0.12 WHEN 'context_event' THEN 0.10 ELSE 0.0 END, 6) AS score
  FROM (SELECT *, CASE WHEN session_id = 's7' THEN 'same_session' WHEN coalesce(session_id, '') <> '' THEN 'cross_session' ELSE 'unscoped' END AS continuity FROM ({RECORDS}) WHERE coalesce(text, '') <> '')""")
def retrieval_native_score(spark, d):
    """Every record's score for one query asked from one session."""
    return pipeline.native_score(_records(spark, d), SCORE, "s7").select("ref_hash", "record_type", "continuity", "score")


@query("""WITH r AS (SELECT seq, node_hash, node_path FROM context_record), p AS (SELECT DISTINCT node_path AS path, len(node_path) >= 3 AS leaf FROM context_record WHERE seq % 20 = 0 AND len(node_path) > 0),
    n AS (SELECT node_hash FROM context_record WHERE seq % 50 = 1)
  SELECT seq FROM r WHERE node_hash IN (SELECT node_hash FROM n WHERE node_hash IS NOT NULL) OR (len(node_path) > 0 AND EXISTS (SELECT 1 FROM p WHERE path = node_path
    OR (leaf AND (node_path[:len(path)] = path OR path[:len(node_path)] = node_path))))""")
def retrieval_tree_selector(spark, d):
    """Records under, above or on the selected paths, or of selected nodes."""
    r = table(spark, d, "context_record")
    paths = r.filter("seq % 20 = 0").select(F.col("node_path").alias("path"), (F.size("node_path") >= 3).alias("leaf")).distinct()
    return pipeline.selected_by_tree(r.select("seq", "node_hash", F.col("node_path").alias("path")), paths, r.filter("seq % 50 = 1").select("node_hash")).select("seq")


def _candidates(spark, d):
    """Refs of all queries as candidates of the packer."""
    r = table(spark, d, "context_ref").dropDuplicates(["query_id", "ref_hash"])
    h = F.pmod("ref_hash", F.lit(100))
    kind = F.when(h < 50, "event").when(h < 70, "entity").when(h < 90, "summary").otherwise("other")
    return r.select(
        "query_id", "ref_hash", F.nanvl("score", F.lit(None).cast("double")).alias("score"), F.col("token_estimate").alias("tokens"), kind.alias("class"), F.when(h % 3 == 0, "cross_session").otherwise("same_session").alias("continuity"),
        F.concat(F.lit("s"), (h % 7).cast("string")).alias("session_id"), F.pmod("ref_hash", F.lit(997)).cast("string").alias("signature"), F.when(h % 2 == 0, "user").otherwise("tool").alias("role"), F.lit("batch").alias("phase"), (h == 13).alias("stale"))


BUDGETS = pipeline.Budgets(4_000, 20, {"tool": 1_200})
CROSS = pipeline.CrossSession(True, 900, 2, 5, 0.1, 0.3, 1)


@query("""WITH RECURSIVE c AS (SELECT DISTINCT query_id, ref_hash, CASE WHEN isnan(score) THEN NULL ELSE score END AS s, greatest(coalesce(token_estimate, 1), 1) AS t, ((ref_hash % 100) + 100) % 100 AS h,
      CAST(((ref_hash % 997) + 997) % 997 AS VARCHAR) AS sig FROM context_ref),
  r AS (SELECT *, coalesce(s, -1) AS score, CASE WHEN h < 50 THEN 'event' WHEN h < 70 THEN 'entity' WHEN h < 90 THEN 'summary' ELSE 'other' END AS kind, h % 3 = 0 AS crosses, 's' || h % 7 AS session, h % 2 = 1 AS tool,
      bool_or(h < 50) OVER (PARTITION BY query_id) AS events, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, ref_hash) AS k FROM c),
  z AS (SELECT query_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS ref_hash, '' AS reason, CAST(0 AS BIGINT) AS used, 0 AS n, CAST(0 AS BIGINT) AS xused, 0 AS xn, 0 AS bridges, CAST(0 AS BIGINT) AS tools,
      CAST([] AS VARCHAR[]) AS sessions, CAST([] AS VARCHAR[]) AS sigs FROM (SELECT DISTINCT query_id FROM c)
    UNION ALL SELECT query_id, k, ref_hash, reason, used + CASE WHEN ok THEN t ELSE 0 END, n + CAST(ok AS INT), xused + CASE WHEN ok AND crosses THEN t ELSE 0 END, xn + CAST(ok AND crosses AS INT),
      bridges + CAST(ok AND crosses AND kind = 'entity' AS INT), tools + CASE WHEN ok AND tool THEN t ELSE 0 END, CASE WHEN ok AND crosses THEN list_distinct(list_append(sessions, session)) ELSE sessions END,
      CASE WHEN ok THEN list_append(sigs, sig) ELSE sigs END
    FROM (SELECT *, reason = 'selected' AS ok FROM (SELECT z.used, z.n, z.xused, z.xn, z.bridges, z.tools, z.sessions, z.sigs, r.*, CASE WHEN z.n >= 20 THEN 'max_selected_refs' WHEN h = 13 THEN 'stale' WHEN z.used + t > 4000 THEN 'over_budget'
        WHEN kind = 'other' THEN 'class_policy' WHEN kind = 'summary' AND events THEN 'summary_policy'
        WHEN crosses AND (score < 0.1 OR (kind = 'event' AND score < 0.3)) THEN 'cross_session_low_score' WHEN crosses AND z.xn >= 5 THEN 'cross_session_candidates'
        WHEN crosses AND NOT list_contains(z.sessions, session) AND len(z.sessions) >= 2 THEN 'cross_session_sessions' WHEN crosses AND z.xused + t > 900 AND NOT (kind = 'entity' AND z.bridges < 1) THEN 'cross_session_budget'
        WHEN tool AND z.tools + t > 1200 THEN 'source_role_budget' WHEN list_contains(z.sigs, sig) THEN 'duplicate' ELSE 'selected' END AS reason
      FROM z JOIN r ON r.query_id = z.query_id AND r.k = z.k + 1)))
  SELECT query_id, ref_hash, reason FROM z WHERE k > 0""")
def retrieval_pack_reasons(spark, d):
    """Every candidate of every query with why it was taken or left."""
    return pipeline.pack(_candidates(spark, d), "query_id", BUDGETS, CROSS).select("query_id", "ref_hash", "reason")


@query("""WITH RECURSIVE r AS (SELECT query_id, ref_hash, greatest(coalesce(token_estimate, 1), 1) AS t, row_number() OVER (PARTITION BY query_id ORDER BY ref_hash) AS k FROM (SELECT DISTINCT query_id, ref_hash, token_estimate FROM context_ref)),
  z AS (SELECT query_id, ref_hash, k, true AS kept, t AS used FROM r WHERE k = 1
    UNION ALL SELECT r.query_id, r.ref_hash, r.k, z.used + r.t <= 1400, CASE WHEN z.used + r.t <= 1400 THEN z.used + r.t ELSE z.used END FROM z JOIN r ON r.query_id = z.query_id AND r.k = z.k + 1)
  SELECT query_id, ref_hash, kept FROM z""")
def retrieval_clamp(spark, d):
    refs = table(spark, d, "context_ref").select("query_id", "ref_hash", "token_estimate").distinct()
    return pipeline.clamp(refs, "query_id", "ref_hash", "token_estimate", 1_500, 100).select("query_id", "ref_hash", "kept")


@query("""WITH u AS (SELECT DISTINCT query_id, ref_hash, CASE WHEN recall_path = 'keyword' OR ref_hash % 3 = 0 THEN 'auxiliary' ELSE 'primary' END AS lane, CASE WHEN isnan(score) THEN NULL ELSE score END AS s FROM context_ref),
  l AS (SELECT query_id, ref_hash, 'primary' AS lane, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, ref_hash) AS rank FROM u WHERE ref_hash % 2 = 0 OR lane = 'primary'
    UNION ALL SELECT query_id, ref_hash, 'auxiliary', row_number() OVER (PARTITION BY query_id ORDER BY ref_hash) FROM u WHERE lane = 'auxiliary'),
  a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM l WHERE lane = 'primary'),
  x AS (SELECT query_id, ref_hash, 0 AS turn, rank FROM a WHERE p <= 8 UNION ALL SELECT query_id, ref_hash, 1, rank FROM l WHERE lane = 'auxiliary' UNION ALL SELECT query_id, ref_hash, 2, rank FROM a WHERE p > 8),
  o AS (SELECT query_id, ref_hash, row_number() OVER (PARTITION BY query_id, ref_hash ORDER BY turn, rank) AS m, turn, rank FROM x)
  SELECT query_id, ref_hash, place FROM (SELECT query_id, ref_hash, row_number() OVER (PARTITION BY query_id ORDER BY turn, rank, ref_hash) AS place FROM o WHERE m = 1) WHERE place <= 12""")
def retrieval_merge_lanes(spark, d):
    from pyspark.sql import Window as W

    r = table(spark, d, "context_ref")
    lane = F.when((F.col("recall_path") == "keyword") | (F.col("ref_hash") % 3 == 0), "auxiliary").otherwise("primary")
    u = r.select("query_id", "ref_hash", lane.alias("lane"), F.nanvl("score", F.lit(None).cast("double")).alias("s")).distinct()
    first = u.filter((F.col("ref_hash") % 2 == 0) | (F.col("lane") == "primary")).select("query_id", "ref_hash", F.lit("primary").alias("lane"), F.row_number().over(W.partitionBy("query_id").orderBy(F.col("s").desc_nulls_last(), "ref_hash")).alias("rank"))
    second = u.filter("lane = 'auxiliary'").select("query_id", "ref_hash", "lane", F.row_number().over(W.partitionBy("query_id").orderBy("ref_hash")).alias("rank"))
    return pipeline.merge_lanes(first.unionByName(second), "query_id", ["ref_hash"], "lane", "rank", 12, 4)


@query()
def retrieval_context(spark, d):
    """The packed context of one query over all records; held against a plain program in the tests."""
    return pipeline.retrieve(_records(spark, d), _postings(spark, d), SCORE, {}, "s7", 6_000)


@query(r"""WITH RECURSIVE b AS (SELECT query_id, ref_hash, row_number() OVER (PARTITION BY query_id ORDER BY ref_hash) AS k, len(list_filter(regexp_split_to_array(ref_type || ' ' || coalesce(recall_path, 'no path') || ' of ' || ref_hash, '\s+'), lambda w: w <> '')) AS n
    FROM (SELECT DISTINCT query_id, ref_hash, ref_type, recall_path FROM context_ref QUALIFY row_number() OVER (PARTITION BY query_id, ref_hash ORDER BY ref_type, recall_path) = 1)),
  z AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS k, CAST(30 - 3 AS BIGINT) AS room, 0 AS taken FROM b
    UNION ALL SELECT z.query_id, b.k, CASE WHEN b.n <= z.room THEN z.room - b.n ELSE z.room END, z.taken + CAST(b.n <= z.room AS INT) FROM z JOIN b ON b.query_id = z.query_id AND b.k = z.k + 1)
  SELECT query_id, CAST(27 - min(room) AS INT) AS selected_tokens, max(taken) AS n_selected, CAST(max(k) - max(taken) AS INT) AS n_blocked FROM z GROUP BY 1""")
def retrieval_inject(spark, d):
    """Prompts of three words with the blocks that fit into thirty."""
    r = table(spark, d, "context_ref").select("query_id", "ref_hash", F.concat_ws(" ", "ref_type", F.coalesce("recall_path", F.lit("no path")), F.lit("of"), F.col("ref_hash").cast("string")).alias("text"))
    r = r.groupBy("query_id", "ref_hash").agg(F.min("text").alias("text"))
    prompts = r.select("query_id", F.lit("what was decided").alias("prompt")).distinct()
    return pipeline.inject(r, "query_id", prompts, "ref_hash", "text", 30).drop("prompt")
