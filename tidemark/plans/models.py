"""Registered queries over context models, skills, extraction, expiry and ingestion checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import hashing
from tidemark.operators import context, counters, extract, models, series, skills
from tidemark.plans.context_store import E, END, START, _events
from tidemark.plans.temporal import DAY
from tidemark.plans.temporal import START as FIRST
from tidemark.runtime import table
from tidemark.streaming import ingest

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _fnv_sql(text: str) -> str:
    """A text's hash as a signed number, byte by byte."""
    codes = f"list_transform(range(1, strlen({text}) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i - 1 AS BIGINT), 2) AS UBIGINT))"
    h = f"list_reduce({codes}, lambda h, b: CAST(CAST(xor(h, b) AS UHUGEINT) * {hashing.FNV_PRIME} % 18446744073709551616 AS UBIGINT), CAST({hashing.FNV_OFFSET} AS UBIGINT))"
    return f"CAST(CASE WHEN {h} >= 9223372036854775808 THEN CAST({h} AS HUGEINT) - 18446744073709551616 ELSE CAST({h} AS HUGEINT) END AS BIGINT)"


def _unsigned_sql(h: str) -> str:
    return f"(CASE WHEN {h} < 0 THEN CAST({h} AS HUGEINT) + 18446744073709551616 ELSE CAST({h} AS HUGEINT) END)"


@query(f"""SELECT delivery_id, CASE WHEN coalesce(event_id_hash, 0) = 0 THEN {_fnv_sql('named')} ELSE event_id_hash END AS event_id_hash
  FROM (SELECT *, CASE WHEN coalesce(event_id_hash, 0) = 0 THEN 'context_event:' || {_unsigned_sql('node_hash')} || ':' || ts_ms || ':' || coalesce(text, '') ELSE 'x' END AS named FROM ({E}))""")
def context_event_ids(spark, d):
    return models.with_event_ids(_events(spark, d)).select("delivery_id", "event_id_hash")


def _writes(spark, d):
    """Events as writes of a named fact per node."""
    e = table(spark, d, "context_event")
    return e.select("tenant", "node_hash", (F.col("event_id_hash") - F.pmod("event_id_hash", F.lit(2**60))).alias("entity_hash"), F.col("text").alias("value"), F.col("delivery_id").alias("seq"))


ENTITIES = """SELECT tenant, node_hash, entity_hash, arg_max(value, seq) AS value, max(seq) AS seq FROM (
    SELECT tenant, node_hash, CAST(CAST(event_id_hash AS HUGEINT) - ((event_id_hash % 1152921504606846976) + 1152921504606846976) % 1152921504606846976 AS BIGINT) AS entity_hash, text AS value, delivery_id AS seq FROM context_event)
  WHERE tenant <> 0 AND node_hash <> 0 AND entity_hash <> 0 GROUP BY 1, 2, 3"""


@query(ENTITIES)
def context_upsert_entities(spark, d):
    return models.upsert(_writes(spark, d), ["tenant", "node_hash", "entity_hash"])


@query(f"SELECT * FROM ({ENTITIES}) QUALIFY row_number() OVER (PARTITION BY tenant, node_hash ORDER BY {_unsigned_sql('entity_hash')}) <= 3")
def context_query_entities(spark, d):
    return models.entities_of(models.upsert(_writes(spark, d), ["tenant", "node_hash", "entity_hash"]), 3)


@query(f"""WITH t AS ({ENTITIES}), a AS (SELECT node_hash AS req_id, unnest([0, 1152921504606846976, 2305843009213693952, 1152921504606846976]) AS entity_hash, unnest([0, 1, 2, 3]) AS pos FROM (SELECT DISTINCT node_hash FROM t)),
  o AS (SELECT req_id, entity_hash, min(pos) AS pos FROM a WHERE entity_hash <> 0 GROUP BY 1, 2) SELECT o.req_id, o.entity_hash, o.pos, t.value FROM o JOIN t ON t.node_hash = o.req_id AND t.entity_hash = o.entity_hash""")
def context_entities_by_hash(spark, d):
    """Requested entities of every node, in the order asked for."""
    t = models.upsert(_writes(spark, d), ["tenant", "node_hash", "entity_hash"])
    asked = t.select(F.col("node_hash").alias("req_id"), "node_hash").distinct().withColumn("refs", F.array(*(F.lit(x).cast("bigint") for x in (0, 2**60, 2**61, 2**60))))
    return context.in_request_order(asked, t, "entity_hash", None, ["node_hash"]).select("req_id", "entity_hash", "pos", "value")


@query("SELECT tenant, node_hash, arg_max(text, doc_id) AS text, max(doc_id) AS seq FROM (SELECT tenant, node_hash, doc_id, coalesce(text, '') AS text FROM documents) WHERE tenant <> 0 AND node_hash <> 0 GROUP BY 1, 2")
def context_upsert_nodes(spark, d):
    rows = table(spark, d, "documents").select("tenant", "node_hash", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("seq"))
    return models.upsert(rows, ["tenant", "node_hash"])


@query("""WITH e AS (SELECT tenant, node_hash AS parent_hash, event_type AS child_hash, delivery_id AS seq FROM context_event WHERE node_hash IS NOT NULL)
  SELECT seq, row_number() OVER (PARTITION BY tenant, parent_hash, child_hash ORDER BY seq) = 1 AS created FROM e""")
def context_insert_edges(spark, d):
    e = table(spark, d, "context_event").filter("node_hash is not null").select("tenant", F.col("node_hash").alias("parent_hash"), F.col("event_type").alias("child_hash"), F.col("delivery_id").alias("seq"))
    return models.insert_edges(e).select("seq", "created")


@query("""WITH a AS (SELECT label AS req_id, vec_id * 2 AS ref, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings)
  SELECT req_id, ref, pos, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM a JOIN embeddings ON vec_id = ref WHERE ref <> 0 QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY pos) <= 100""")
def context_embeddings_by_ref(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.groupBy(F.col("label").alias("req_id")).agg(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: v * 2).alias("refs"))
    got = context.in_request_order(asked, e.select(F.col("vec_id").alias("ref"), "embedding"), "ref")
    return got.select("req_id", "ref", "pos", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query(f"""WITH v AS (SELECT tenant, node_hash, event_type % 2 AS level, ts_ms - ts_ms % 3600000 AS valid_from_ms, arg_max(text, delivery_id) AS summary, max(delivery_id) AS seq FROM ({E}) WHERE ts_ms - ts_ms % 3600000 <= {END} GROUP BY ALL)
  SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY tenant, node_hash, level ORDER BY valid_from_ms) <= 3""")
def context_summary_versions(spark, d):
    v = _events(spark, d).select("tenant", "node_hash", (F.col("event_type") % 2).alias("level"), (F.col("ts_ms") - F.col("ts_ms") % 3_600_000).alias("valid_from_ms"), F.col("text").alias("summary"), F.col("delivery_id").alias("seq"))
    return models.summary_versions(v, END, 3)


@query(f"""WITH a AS (SELECT tenant, query_id % 25 AS session_id, query_id, max(updated_at_ms) AS request_time_ms FROM context_ref GROUP BY ALL)
  SELECT * FROM a WHERE request_time_ms BETWEEN {START} AND {END} QUALIFY row_number() OVER (PARTITION BY tenant, session_id ORDER BY request_time_ms, query_id) <= 2""")
def context_session_audits(spark, d):
    a = table(spark, d, "context_ref").groupBy("tenant", (F.col("query_id") % 25).alias("session_id"), "query_id").agg(F.max("updated_at_ms").alias("request_time_ms"))
    return models.session_audits(a, START, END, 2)


def _extracted(spark, d):
    """Events with a source, two entities and the scope of their tenant."""
    e = _events(spark, d)
    return e.withColumn("source_hash", F.col("batch_id") % 5).withColumn("entity_hashes", F.array(F.col("event_type").cast("bigint") + 100, F.col("delivery_id") % 3))


X = f"SELECT *, batch_id % 5 AS source_hash, [event_type + 100, delivery_id % 3] AS entity_hashes, ts_ms - ts_ms % 3600000 AS bucket FROM ({E})"
POSTED = " UNION ALL ".join(
    f"SELECT tenant, '{n}' AS index_name, CAST({v} AS BIGINT) AS value_hash, tenant % 7 AS scope_hash, {t} AS time_ms, node_hash, ts_ms AS event_time_ms, event_id_hash FROM ({X}) WHERE {v} <> 0 AND {t} <> 0"
    for n, v, t in (("event_kind", "event_type", "ts_ms"), ("source", "source_hash", "ts_ms"), ("event_time_bucket", "bucket", "bucket"), ("entity", "entity_hashes[1]", "ts_ms"), ("entity", "entity_hashes[2]", "ts_ms")))


def _posted(spark, d):
    return models.postings(_extracted(spark, d), F.col("tenant") % 7, ("status",))


@query(POSTED)
def context_all_postings(spark, d):
    """Four of the five index families, status switched off."""
    return _posted(spark, d)


@query(f"""SELECT * FROM ({POSTED}) WHERE index_name = 'entity' AND value_hash = 102 AND scope_hash = 3 AND time_ms BETWEEN {START} AND {END} QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY time_ms, node_hash, event_id_hash) <= 1""")
def context_scoped_lookup(spark, d):
    return models.lookup(_posted(spark, d), "entity", 102, 3, START, END, 1)


@query(f"""WITH h AS (SELECT tenant, time_ms, event_id_hash, node_hash, CASE WHEN index_name = 'entity' AND value_hash = 2 THEN 0 WHEN index_name = 'source' AND value_hash = 1 THEN 1 END AS predicate, count(*) AS n FROM ({POSTED})
    WHERE time_ms BETWEEN {START} AND {END} GROUP BY ALL) SELECT tenant, predicate, CAST(sum(n) AS BIGINT) AS scanned, CAST(sum(n - 1) AS BIGINT) AS repeated FROM h WHERE predicate IS NOT NULL GROUP BY 1, 2""")
def context_intersection_counters(spark, d):
    return models.intersection_counters(_posted(spark, d), [("entity", 2, START, END), ("source", 1, START, END)])


def _marks(spark, d):
    return _events(spark, d).select("tenant", "node_hash", F.col("ts_ms").alias("event_time_ms"), F.concat(F.lit("kind-"), F.col("event_type")).alias("reason"), F.coalesce("status", F.lit(0)).alias("propagate_depth"), F.col("delivery_id").alias("seq"))


MARKED = f"""SELECT m.tenant, m.node_hash, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, arg_max('kind-' || event_type, delivery_id) AS reason, max(coalesce(status, 0)) AS propagate_depth, count(*) AS marks FROM ({E}) m
  LEFT JOIN (SELECT tenant, node_hash, max(delivery_id) AS c FROM ({E}) WHERE event_type = 5 GROUP BY 1, 2) x ON x.tenant = m.tenant AND x.node_hash = m.node_hash WHERE c IS NULL OR delivery_id > c GROUP BY 1, 2"""


@query(MARKED)
def context_dirty_after_clears(spark, d):
    """Dirty nodes where events of kind 5 have cleared what was marked before."""
    m = _marks(spark, d)
    return models.marked_dirty(m, m.filter("reason = 'kind-5'"))


@query(f"""SELECT * FROM ({MARKED}) WHERE last_ms >= {START} AND first_ms <= {END} ORDER BY {_unsigned_sql('tenant')}, {_unsigned_sql('node_hash')} LIMIT 100""")
def context_dirty_sweep(spark, d):
    m = _marks(spark, d)
    return models.sweep_dirty(models.marked_dirty(m, m.filter("reason = 'kind-5'")), 0, START, END)


@query(f"""WITH c AS (SELECT tenant, node_hash, delivery_id AS id, ts_ms AS source_start_ms, ts_ms + 3600000 AS source_end_ms, ingestion_time_ms AS compressed_time_ms FROM ({E}))
  SELECT * FROM c WHERE EXISTS (SELECT 1 FROM context_node n WHERE n.tenant = c.tenant AND n.node_hash = c.node_hash) AND source_end_ms >= {START} AND source_start_ms <= {END}
  QUALIFY row_number() OVER (PARTITION BY tenant, node_hash ORDER BY source_end_ms DESC, compressed_time_ms DESC, id) <= 2""")
def context_cold_windows(spark, d):
    c = _events(spark, d).select("tenant", "node_hash", F.col("delivery_id").alias("id"), F.col("ts_ms").alias("source_start_ms"), (F.col("ts_ms") + 3_600_000).alias("source_end_ms"), F.col("ingestion_time_ms").alias("compressed_time_ms"))
    return models.cold_windows(table(spark, d, "context_node"), c, START, END, 2)


# -- skills ----------------------------------------------------------------------------------------------------------
def _cards(spark, d):
    """Documents as skill cards with front matter."""
    i = F.col("doc_id")
    head = F.concat(
        F.lit("---\nname: skill-"), (i % 200).cast("string"), F.lit("\nversion: "), (i % 3).cast("string"), F.when(i % 5 == 0, F.lit("\nenabled: no")).otherwise(F.lit("")), F.when(i % 4 == 0, F.lit("\npriority: high")).otherwise(F.lit("")),
        F.lit("\ntriggers: [deploy, runbook "), (i % 7).cast("string"), F.lit("]\ntools:\n  - shell\n  - editor\n---\n"))
    return table(spark, d, "documents").select("doc_id", "raw_uri", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


CARDS = """SELECT doc_id, coalesce(raw_uri, '') AS source_ref, 'skill-' || doc_id % 200 AS skill_name, CAST(doc_id % 3 AS VARCHAR) AS version, doc_id % 5 <> 0 AS enabled, CASE WHEN doc_id % 4 = 0 THEN 200 ELSE 100 END AS precedence,
  ['deploy', 'runbook ' || doc_id % 7] AS triggers FROM documents"""


@query(f"SELECT source_ref, skill_name, version, enabled, CAST(precedence AS INT) AS precedence, array_to_string(triggers, '|') AS triggers, 'shell|editor' AS tools FROM ({CARDS})")
def skill_parse(spark, d):
    p = skills.parse(_cards(spark, d), "raw_uri", "text")
    return p.select(F.coalesce("source_ref", F.lit("")).alias("source_ref"), "skill_name", "version", "enabled", "precedence", F.array_join("triggers", "|").alias("triggers"), F.array_join("allowed_tools", "|").alias("tools"))


def _registry(spark, d):
    i = F.col("doc_id")
    log = table(spark, d, "documents").select(
        F.concat(F.lit("skill-"), i % 200).alias("skill_name"), i.alias("seq"), F.when(i % 2 == 0, (i % 3).cast("string")).alias("version"), F.when(i % 3 == 0, i % 5 != 0).alias("enabled"), F.when(i % 4 == 0, F.lit(200)).alias("precedence"),
        F.array(F.lit("deploy"), F.concat(F.lit("runbook "), i % 7)).alias("triggers"), F.array(F.lit("shell")).alias("allowed_tools"), F.array(F.lit("ops")).alias("tags"), F.lit("how to deploy").alias("description"))
    return skills.registry(log)


REGISTERED = """WITH l AS (SELECT 'skill-' || doc_id % 200 AS skill_name, doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 3 AS VARCHAR) END AS version, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 <> 0 END AS enabled,
    CASE WHEN doc_id % 4 = 0 THEN 200 END AS precedence, doc_id % 7 AS t FROM documents),
  b AS (SELECT *, lag(version IGNORE NULLS) OVER (PARTITION BY skill_name ORDER BY seq) AS before FROM l)
  SELECT skill_name, arg_max(version, seq) FILTER (version IS NOT NULL) AS version, arg_max(enabled, seq) FILTER (enabled IS NOT NULL) AS enabled, arg_max(precedence, seq) FILTER (precedence IS NOT NULL) AS precedence,
    arg_max(t, seq) AS t, CAST(coalesce(sum(CAST(version IS NOT NULL AND before IS NOT NULL AND version <> before AS INT)), 0) AS BIGINT) AS version_changes FROM b GROUP BY 1"""


@query(f"SELECT skill_name, version, enabled, precedence, 'deploy|runbook ' || t AS triggers, version_changes FROM ({REGISTERED})")
def skill_registry(spark, d):
    return _registry(spark, d).select("skill_name", "version", "enabled", "precedence", F.array_join("triggers", "|").alias("triggers"), "version_changes")


@query(f"""SELECT skill_name, CAST(coalesce(precedence, 100) + 60 - 10 + 50 + 5 * 1 + 1 AS INT) AS score FROM ({REGISTERED}) WHERE coalesce(enabled, true)
  ORDER BY score DESC, coalesce(precedence, 100) DESC, skill_name LIMIT 40""")
def skill_select(spark, d):
    """The best skills for one query and tool."""
    return skills.select(_registry(spark, d), "Deploy by runbook 3", F.lit(10), "Shell", 40).select("skill_name", "score")


# -- extraction ------------------------------------------------------------------------------------------------------
def _sources(spark, d):
    return table(spark, d, "context_node").select("tenant", F.lit("node").alias("kind"), F.col("canonical_name").alias("source_id"), F.lit(None).cast("string").alias("title"), F.col("l0").alias("body"), F.coalesce("last_event_time_ms", F.lit(0)).alias("ts_ms"))


SOURCES = "SELECT tenant, canonical_name AS source_id, l0 AS body, coalesce(last_event_time_ms, 0) AS ts_ms FROM context_node WHERE tenant <> 0 AND coalesce(canonical_name, '') <> '' AND trim(coalesce(l0, '')) <> ''"


@query(f"SELECT DISTINCT tenant, {_fnv_sql('named')} AS node_hash, source_id AS canonical_name FROM (SELECT *, {_unsigned_sql('tenant')} || ':node:' || source_id AS named FROM ({SOURCES}))")
def extract_nodes(spark, d):
    return extract.extract(_sources(spark, d))["nodes"].select("tenant", "node_hash", "canonical_name")


@query(f"SELECT tenant, 'source' AS index_name, count(*) AS n FROM ({SOURCES}) GROUP BY 1 UNION ALL SELECT tenant, 'source_kind', count(*) FROM ({SOURCES}) GROUP BY 1")
def extract_postings(spark, d):
    return extract.extract(_sources(spark, d))["postings"].groupBy("tenant", "index_name").agg(F.count(F.lit(1)).alias("n"))


@query()
def extract_resources(spark, d):
    """Every document's chunks as extracted events, counted per tenant; held against a plain program in the tests."""
    s = extract.sources_of(table(spark, d, "documents"), "tenant", "raw_uri", "doc_id", "text", F.lit(START))
    out = extract.extract(s)
    return out["events"].groupBy("tenant").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("node_hash").alias("nodes"), F.max("ts_ms").alias("last_ms"))


def _rules_sql() -> str:
    parts = [
        ("user", "current_plan", r"(?i)\bgoal\s*:\s*[^.;!?\n]{4,220}"), ("user", "current_plan", r"(?i)\b(?:please\s+)?(?:implement|fix|add|remove|replace|move)\s+[^.;!?\n]{4,180}"),
        ("user", "preference", r"(?i)\b(?:remember(?:\s+that)?|please\s+always|always|keep|use|prefer|make\s+sure(?:\s+to)?)\b[:\s]+[^.;!?\n]{4,180}"), ("user", "preference", r"(?i)\b(?:do\s+not|don''t|never|avoid|stop)\s+[^.;!?\n]{4,180}"),
        ("user", "current_plan", r"(?i)\b(?:we\s+should|should|need\s+to|must|have\s+to|let''s|lets|please)\s+[^.;!?\n]{4,180}"), ("assistant", "assistant_decision", r"(?i)\b(?:decided|agreed|implemented|fixed|changed|updated|verified)\s+[^.;!?\n]{4,180}"),
    ]
    found = " UNION ALL ".join(f"SELECT row_id, '{t}' AS entity_type, unnest(regexp_extract_all(content, '{p}')) AS state FROM chat_message WHERE lower(trim(role)) = '{r}'" for r, t, p in parts)
    tool = r"SELECT row_id, 'tool_evidence', CASE WHEN length(c) > 220 THEN rtrim(left(c, 219)) || '…' ELSE c END FROM (SELECT row_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS c FROM chat_message WHERE lower(trim(role)) = 'tool' AND trim(content) <> '')"
    return rf"SELECT DISTINCT row_id, entity_type, trim(regexp_replace(state, '\s+', ' ', 'g')) AS state FROM ({found} UNION ALL {tool}) WHERE regexp_matches(state, '[^\s\x{{00A0}}]')"


@query(_rules_sql())
def extract_entities(spark, d):
    """What chat messages state by their speaker's role."""
    return extract.entities(table(spark, d, "chat_message"), "role", "content", ["row_id"])


@query("""WITH r AS (SELECT query_id, ref_hash, row_number() OVER (PARTITION BY query_id ORDER BY ref_hash) AS rank, coalesce(token_estimate, 1) AS tokens FROM (SELECT query_id, ref_hash, max(token_estimate) AS token_estimate FROM context_ref GROUP BY 1, 2)),
  q AS (SELECT query_id, sum(tokens) FILTER (rank <= 10) AS t, sum(tokens) AS f, CAST(count(*) AS DOUBLE) AS ms FROM r GROUP BY 1)
  SELECT (SELECT count(*) FILTER (rank <= 5) / CAST(count(*) AS DOUBLE) FROM r WHERE ref_hash % 3 = 0) AS retention_at_k, 1 - sum(t) / CAST(sum(f) AS DOUBLE) AS token_reduction, quantile_cont(ms, 0.5) AS p50_ms, quantile_cont(ms, 0.95) AS p95_ms,
    quantile_cont(ms, 0.99) AS p99_ms, count(*) AS queries FROM q""")
def pipeline_report(spark, d):
    """Evidence kept among the first five refs, tokens spared by keeping ten, and latencies (here: the number of candidates)."""
    from pyspark.sql import Window as W

    r = table(spark, d, "context_ref").groupBy("query_id", "ref_hash").agg(F.coalesce(F.max("token_estimate"), F.lit(1)).alias("tokens"))
    q = W.partitionBy("query_id")
    runs = r.withColumn("rank", F.row_number().over(q.orderBy("ref_hash"))).withColumn("full_tokens", F.sum("tokens").over(q)).withColumn("latency_ms", F.count(F.lit(1)).over(q).cast("double"))
    return extract.report(runs.filter("rank <= 10"), runs.filter("ref_hash % 3 = 0"), 5)


# -- counters, series, ingestion -------------------------------------------------------------------------------------
def _increments(spark, d):
    e = table(spark, d, "events")
    ttl = F.when(F.col("event_id") % 3 == 0, F.lit(86_400_000 * 5)).cast("bigint")
    return e.select(F.lit("h").alias("family"), F.col("user_id").cast("string").alias("key"), schemas.epoch_ms("ts").alias("ts_ms"), F.floor("value").cast("bigint").alias("amount"), F.col("event_id").alias("seq"), ttl.alias("ttl_ms"))


I = "SELECT 'h' AS family, CAST(user_id AS VARCHAR) AS key, (epoch_us(ts) // 1000) AS ts_ms, CAST(floor(value) AS BIGINT) AS amount, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 432000000 END AS ttl_ms FROM events"
NOW = FIRST + DAY * 24


@query(f"""WITH u AS (SELECT key, arg_max(ts_ms + ttl_ms, seq) FILTER (ttl_ms IS NOT NULL) AS until FROM ({I}) GROUP BY 1)
  SELECT family, key, ts_ms - ts_ms % 86400000 AS bucket_ms, CAST(sum(amount) AS BIGINT) AS amount FROM ({I}) WHERE key NOT IN (SELECT key FROM u WHERE until <= {NOW}) GROUP BY ALL""")
def control_alive(spark, d):
    """Counters whose last time to live has not run out."""
    inc = _increments(spark, d)
    return counters.alive(counters.buckets(inc, 86_400_000), inc, NOW)


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(DISTINCT json_extract_string(props, '$.k')) AS value, false AS sketched FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def control_distinct_exact(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), schemas.epoch_ms("ts").alias("ts_ms"), F.get_json_object("props", "$.k").alias("value"))
    return counters.distinct_mixed(e, 0, 2**60, 86_400_000)


@query("SELECT DISTINCT event_type AS key, true AS sketched, true AS within_five_percent FROM events")
def control_distinct_promoted(spark, d):
    """Sets above the bound become sketches, whose estimates lie within five percent."""
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), schemas.epoch_ms("ts").alias("ts_ms"), F.col("event_id").alias("value"))
    exact = e.groupBy("key").agg(F.count_distinct("value").alias("n"))
    out = counters.distinct_mixed(e, 0, 2**60, 86_400_000 * 3650, 100).join(exact, "key")
    return out.select("key", "sketched", (F.abs(F.col("value") - F.col("n")) <= 0.05 * F.col("n")).alias("within_five_percent"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(DISTINCT (epoch_us(ts) // 1000)) AS points FROM events GROUP BY 1 HAVING points > 60")
def feature_refused(spark, d):
    p = schemas.points(table(spark, d, "events"))
    return series.refused(p.filter("seq % 2 = 0"), p, 60)


def _stream_records(spark, d):
    e = table(spark, d, "context_event")
    return e.select(F.concat(F.lit("t"), F.coalesce("tenant", F.lit(0)) % 3).alias("source"), F.when(F.col("batch_id") % 4 > 0, (F.col("batch_id") % 4).cast("string")).alias("part"), F.floor(F.col("delivery_id") / 3).alias("position"), "delivery_id")


RECORDS = "SELECT 't' || coalesce(tenant, 0) % 3 AS source, CASE WHEN batch_id % 4 > 0 THEN CAST(batch_id % 4 AS VARCHAR) END AS part, delivery_id // 3 AS position, delivery_id FROM context_event"


@query(f"""WITH r AS ({RECORDS}), m AS (SELECT CAST(avg(position) AS BIGINT) AS mid FROM r), l AS (SELECT source, part, max(position) AS committed FROM r, m WHERE position <= mid GROUP BY 1, 2),
  t AS (SELECT r.source, r.part, r.position, coalesce(l.committed, -1) AS committed FROM r LEFT JOIN l ON l.source = r.source AND l.part IS NOT DISTINCT FROM r.part),
  n AS (SELECT *, row_number() OVER (PARTITION BY source, part, position) AS k FROM t)
  SELECT source, part, CASE WHEN source IS NULL OR position IS NULL THEN 'missing_position' WHEN position <= committed THEN 'committed' WHEN k > 1 THEN 'duplicate' WHEN position > committed + 400 THEN 'backpressure' END AS reason, count(*) AS n FROM n GROUP BY ALL""")
def ingest_validate(spark, d):
    """Why records of a batch are applied or go to the dead letters, half of them being committed before."""
    r = _stream_records(spark, d)
    mid = r.agg(F.floor(F.avg("position") + 0.5)).first()[0]
    ledger = ingest.advance(spark.createDataFrame([], ingest.LEDGER), r.filter(F.col("position") <= mid))
    return ingest.validate(r, ledger, 400).groupBy("source", "part", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS ({RECORDS}), m AS (SELECT CAST(avg(position) AS BIGINT) AS mid FROM r), l AS (SELECT source, part, max(position) AS committed FROM r, m WHERE position <= mid GROUP BY 1, 2),
  h AS (SELECT source, part, max(position) AS head FROM r GROUP BY 1, 2) SELECT h.source, max(head - coalesce(committed, -1)) AS lag FROM h LEFT JOIN l ON l.source = h.source AND l.part IS NOT DISTINCT FROM h.part GROUP BY 1""")
def ingest_lag(spark, d):
    r = _stream_records(spark, d)
    mid = r.agg(F.floor(F.avg("position") + 0.5)).first()[0]
    ledger = ingest.advance(spark.createDataFrame([], ingest.LEDGER), r.filter(F.col("position") <= mid))
    return ingest.lag(ledger, r.groupBy("source", "part").agg(F.max("position").alias("head")))
