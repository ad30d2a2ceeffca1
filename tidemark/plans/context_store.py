"""Registered queries over the context models, retrieval and content, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import hashing, text
from tidemark.operators import content, context, kv, retrieval
from tidemark.runtime import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# 2022-01-03 to 2022-01-10, in epoch milliseconds
START, END = 1_641_168_000_000, 1_641_772_800_000
MID = (START + END) // 2


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _events(spark, d):
    return context.normalised(table(spark, d, "context_event"))


E = """SELECT * REPLACE (coalesce(nullif(ts_ms, 0), nullif(ingestion_time_ms, 0)) AS ts_ms, coalesce(nullif(ingestion_time_ms, 0), nullif(ts_ms, 0)) AS ingestion_time_ms)
  FROM context_event WHERE tenant <> 0 AND node_hash <> 0 AND coalesce(nullif(ts_ms, 0), nullif(ingestion_time_ms, 0)) IS NOT NULL"""


@query(f"""SELECT delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant, node_hash ORDER BY n) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY tenant, node_hash ORDER BY ts_ms DESC, delivery_id DESC) AS n FROM ({E}) WHERE ts_ms BETWEEN {START} AND {END})
  WHERE n <= 20 AND event_type IN (1, 2) AND status IN (0, 1, 2) AND confidence >= CAST(0.5 AS FLOAT) AND ts_ms <= {MID} AND (coalesce(valid_until_ms, 0) = 0 OR valid_until_ms > {MID})) WHERE m <= 5""")
def context_query_events(spark, d):
    return context.query_events(_events(spark, d), START, END, 20, 5, [1, 2], [0, 1, 2], 0.5, as_of_ms=MID).select("delivery_id")


@query(f"SELECT delivery_id FROM ({E}) QUALIFY event_id_hash IS NULL OR event_id_hash = 0 OR row_number() OVER (PARTITION BY tenant, node_hash, event_id_hash ORDER BY delivery_id) = 1")
def context_write_event_first(spark, d):
    e = _events(spark, d)
    named = F.coalesce(F.col("event_id_hash"), F.lit(0)) != 0
    first = kv.if_absent(e.filter(named).select("tenant", "node_hash", "event_id_hash", "delivery_id"), ["tenant", "node_hash", "event_id_hash"], "delivery_id")
    return first.select("delivery_id").unionByName(e.filter(~named).select("delivery_id"))


PO = " UNION ALL ".join(
    f"SELECT tenant, '{n}' AS index_name, CAST({v} AS BIGINT) AS value_hash, ts_ms AS time_ms, node_hash, event_id_hash FROM ({E}) WHERE {v} IS NOT NULL AND {v} <> 0"
    for n, v in (("event_kind", "event_type"), ("status", "status"), ("event_time_bucket", "(ts_ms - ts_ms % 3600000)")))


@query(PO)
def context_postings(spark, d):
    return context.extract_postings(_events(spark, d))


@query(f"SELECT * FROM ({PO}) WHERE index_name = 'event_kind' AND value_hash = 3 AND time_ms BETWEEN {START} AND {END} QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY time_ms, node_hash, event_id_hash) <= 1")
def context_query_index(spark, d):
    return context.query_index(context.extract_postings(_events(spark, d)), "event_kind", 3, START, END, 1)


@query(f"""WITH p AS ({PO}) SELECT * FROM (
    SELECT tenant, time_ms, event_id_hash, node_hash FROM p WHERE index_name = 'event_kind' AND value_hash = 2 AND time_ms BETWEEN {START} AND {END}
    INTERSECT SELECT tenant, time_ms, event_id_hash, node_hash FROM p WHERE index_name = 'status' AND value_hash = 1 AND time_ms BETWEEN {START} AND {END})
  QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY time_ms, event_id_hash, node_hash) <= 50""")
def context_index_intersection(spark, d):
    return context.intersect_index(context.extract_postings(_events(spark, d)), [("event_kind", 2, START, END), ("status", 1, START, END)], 50)


@query(f"""WITH e AS (SELECT DISTINCT tenant, index_name, value_hash, time_ms, node_hash, event_id_hash FROM ({PO})),
  f AS (SELECT DISTINCT tenant, index_name, value_hash, time_ms, node_hash, event_id_hash FROM ({PO}) WHERE time_ms % 7 <> 0)
  SELECT index_name, count(*) AS checked, count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE f.tenant = e.tenant AND f.index_name = e.index_name AND f.value_hash = e.value_hash AND f.time_ms = e.time_ms
    AND f.node_hash = e.node_hash AND f.event_id_hash IS NOT NULL AND f.event_id_hash = e.event_id_hash)) AS found,
  checked - found AS missing FROM e GROUP BY 1""")
def context_index_check(spark, d):
    p = context.extract_postings(_events(spark, d))
    return context.index_check(p, p.filter("time_ms % 7 <> 0"))


@query(f"""SELECT tenant, node_hash, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, arg_max('kind-' || event_type, delivery_id) AS reason, max(coalesce(status, 0)) AS propagate_depth, count(*) AS marks
  FROM ({E}) GROUP BY ALL HAVING last_ms >= {START} AND first_ms <= {END}""")
def context_dirty_markers(spark, d):
    e = _events(spark, d)
    m = e.select("tenant", "node_hash", F.col("ts_ms").alias("event_time_ms"), F.concat(F.lit("kind-"), F.col("event_type").cast("string")).alias("reason"), F.coalesce("status", F.lit(0)).alias("propagate_depth"), F.col("delivery_id").alias("seq"))
    return context.overlapping(context.coalesce_dirty(m), START, END)


@query("""SELECT tenant, parent_hash, node_hash AS child_hash, last_event_time_ms AS updated_at_ms FROM context_node WHERE parent_hash <> 0
  QUALIFY row_number() OVER (PARTITION BY tenant, parent_hash ORDER BY last_event_time_ms NULLS FIRST, node_hash) <= 10""")
def context_children(spark, d):
    return context.children(table(spark, d, "context_node"), 10)


@query("""WITH asked AS (SELECT node_hash AS req_id, unnest([parent_hash, node_hash, node_hash, 0]) AS node_hash, unnest([0, 1, 2, 3]) AS pos FROM context_node),
  a AS (SELECT req_id, node_hash, min(pos) AS pos FROM asked WHERE node_hash <> 0 GROUP BY 1, 2) SELECT req_id, node_hash, pos, kind FROM a JOIN (SELECT node_hash, kind FROM context_node) USING (node_hash)""")
def context_get_nodes(spark, d):
    n = table(spark, d, "context_node")
    asked = n.select(F.col("node_hash").alias("req_id"), F.array("parent_hash", "node_hash", "node_hash", F.lit(0).cast("bigint")).alias("refs"))
    return context.in_request_order(asked, n.select("node_hash", "kind"), "node_hash").select("req_id", "node_hash", "pos", "kind")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cos
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return e.select(F.col("vec_id").alias("a"), "embedding").join(b, "a").select("a", "b", F.round(context.cosine(F.col("embedding"), F.col("vb")), 6).alias("cos"))


_LAYER = """SELECT tenant, root, node, {depth} AS depth, score FROM (
    SELECT b.tenant, b.root, e.child AS node, x.score FROM {beam} b JOIN (SELECT *, row_number() OVER (PARTITION BY tenant, parent ORDER BY updated_at_ms, child) AS n FROM e) e ON e.tenant = b.tenant AND e.parent = b.node AND e.n <= 1000
    JOIN x ON x.node = e.child WHERE x.score > 0) QUALIFY row_number() OVER (PARTITION BY tenant, root ORDER BY score DESC, node) <= 5"""


@query(f"""WITH q AS (SELECT embedding AS v0 FROM embeddings ORDER BY vec_id LIMIT 1),
  x AS (SELECT vec_id AS node, list_dot_product(embedding::DOUBLE[], v0::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v0::DOUBLE[], v0::DOUBLE[]))) AS score FROM embeddings, q),
  e AS (SELECT label % 2 AS tenant, -1 - label AS parent, vec_id AS child, vec_id AS updated_at_ms FROM embeddings UNION ALL SELECT t, vec_id % 97, vec_id, vec_id FROM embeddings, (VALUES (0), (1)) v(t) WHERE vec_id > 97),
  r AS (SELECT DISTINCT label % 2 AS tenant, -1 - label AS root, -1 - label AS node FROM embeddings),
  l1 AS ({_LAYER.format(depth=1, beam='r')}), l2 AS ({_LAYER.format(depth=2, beam='l1')}), l3 AS ({_LAYER.format(depth=3, beam='l2')})
  SELECT tenant, root, node, depth, round(score, 6) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
  QUALIFY row_number() OVER (PARTITION BY tenant, root ORDER BY depth, score DESC, node) <= 64""")
def context_traverse_tree(spark, d):
    """From every label's node down three levels of vectors, labels belonging to two tenants."""
    e = table(spark, d, "embeddings")
    label = F.col("label").cast("bigint")
    first = e.select((label % 2).alias("tenant"), (-1 - label).alias("parent"), F.col("vec_id").alias("child"), F.col("vec_id").alias("updated_at_ms"))
    tenants = F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("tenant")
    nxt = e.filter("vec_id > 97").select(tenants, (F.col("vec_id") % 97).alias("parent"), F.col("vec_id").alias("child"), F.col("vec_id").alias("updated_at_ms"))
    vectors = e.select(tenants, F.col("vec_id").alias("node"), F.col("embedding").alias("vector"))
    roots = e.select((label % 2).alias("tenant"), (-1 - label).alias("root")).distinct()
    q = e.orderBy("vec_id").select("embedding").first()[0]  # the query vector
    return context.traverse(first.unionByName(nxt), vectors, roots, q, 3, 5).withColumn("score", F.round("score", 6))


@query(f"""SELECT tenant, node_hash, arg_max(text, (ts_ms, text)) AS text FROM ({E}) WHERE ts_ms <= {END} GROUP BY ALL""")
def context_summary_as_of(spark, d):
    return context.as_of(_events(spark, d), ["tenant", "node_hash"], "ts_ms", END, ["text"])


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY tenant, node_hash ORDER BY ts_ms, event_id_hash NULLS FIRST, delivery_id) AS n FROM ({E}) WHERE ts_ms BETWEEN {START} AND {END} AND importance >= CAST(0.3 AS FLOAT))
  SELECT tenant, node_hash, count(*) FILTER (n <= 5) AS n_sources, max(n) > 5 AS truncated,
    left('Window {START}-{END}: ' || string_agg(left(text, 256), ' ' ORDER BY n) FILTER (n <= 5) || CASE WHEN max(n) > 5 THEN ' (more events follow)' ELSE '' END, 16384) AS summary FROM r GROUP BY ALL""")
def context_compress_events(spark, d):
    return context.compress_events(_events(spark, d), START, END, 5, min_importance=0.3)


@query(f"""SELECT delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant, node_hash ORDER BY ts_ms DESC, delivery_id DESC) AS r, count(*) OVER (PARTITION BY tenant, node_hash) AS a,
    min(ts_ms) OVER (PARTITION BY tenant, node_hash) AS o FROM ({E})) WHERE (a > 20 OR o < {START} - 2592000000) AND r > 8 AND r > a - 6""")
def context_auto_compress(spark, d):
    return context.auto_compress(_events(spark, d), START, 20, keep=8, batch=6).select("delivery_id")


@query(f"""WITH s AS (SELECT tenant, node_hash, 1 AS level, ts_ms AS valid_from_ms, text AS summary FROM ({E}) WHERE event_type = 1),
  a AS (SELECT tenant, node_hash, arg_max(summary, (valid_from_ms, summary)) AS summary FROM s WHERE valid_from_ms <= {END} GROUP BY ALL),
  c AS (SELECT tenant, node_hash, count(*) AS n FROM (SELECT tenant, node_hash FROM ({E}) WHERE ts_ms + 3600000 >= {START} AND ts_ms <= {END}) GROUP BY ALL)
  SELECT n.tenant, n.node_hash, a.summary, coalesce(c.n, 0) AS n_cold FROM context_node n LEFT JOIN a USING (tenant, node_hash) LEFT JOIN c USING (tenant, node_hash)""")
def context_node_context(spark, d):
    e = _events(spark, d)
    s = e.filter("event_type = 1").select("tenant", "node_hash", F.lit(1).alias("level"), F.col("ts_ms").alias("valid_from_ms"), F.col("text").alias("summary"))
    c = e.select("tenant", "node_hash", F.col("ts_ms").alias("source_start_ms"), (F.col("ts_ms") + 3_600_000).alias("source_end_ms"))
    return context.node_context(table(spark, d, "context_node"), s, c, END, START, END).select("tenant", "node_hash", "summary", "n_cold")


# -- retrieval ------------------------------------------------------------------------------------------------------
R = "SELECT DISTINCT query_id, tenant, node_hash, ref_hash, ref_type, recall_path, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, time_score, sparse_score, token_estimate, updated_at_ms FROM context_ref"


def _refs(spark, d):
    r = table(spark, d, "context_ref").select("query_id", "tenant", "node_hash", "ref_hash", "ref_type", "recall_path", "score", "time_score", "sparse_score", "token_estimate", "updated_at_ms")
    return r.withColumn("score", F.nanvl("score", F.lit(None).cast("double"))).distinct()


@query(f"""SELECT query_id, ref_hash, round(CASE WHEN age <= 86400000 THEN 1.0 ELSE exp(-sqrt((age - 86400000) / 604800000.0)) END, 6) AS decay FROM (SELECT *, {END} - updated_at_ms AS age FROM ({R}))""")
def retrieval_time_decay(spark, d):
    return _refs(spark, d).select("query_id", "ref_hash", F.round(retrieval.time_decay(F.lit(END).cast("bigint"), F.col("updated_at_ms")), 6).alias("decay"))


def _unit(x: str) -> str:
    return f"least(1e0, greatest(0e0, coalesce(CAST({x} AS DOUBLE), 0e0)))"


@query(f"""SELECT query_id, ref_hash, round({_unit(f"(1e0 - 0.18e0 - 0.22e0) * (0.55e0 * {_unit('score')} + 0.35e0 * {_unit('sparse_score / (sparse_score + 5)')} + 0.10e0 * 0.5e0) + 0.18e0 * {_unit('time_score')} + 0.22e0 * 0.3e0")}, 6) AS final FROM ({R})""")
def retrieval_hybrid_score(spark, d):
    s = F.col("sparse_score") / (F.col("sparse_score") + 5)
    return _refs(spark, d).select("query_id", "ref_hash", retrieval.hybrid(F.col("score"), s, F.lit(0.5), F.col("time_score"), F.lit(0.3)).alias("final"))


@query(f"SELECT * FROM ({R}) QUALIFY row_number() OVER (PARTITION BY query_id, node_hash ORDER BY updated_at_ms DESC, ref_hash) <= 1")
def retrieval_fan_out(spark, d):
    return retrieval.fan_out(_refs(spark, d), ["query_id", "node_hash"], [F.col("updated_at_ms").desc(), "ref_hash"], 1)


RANKED = f"SELECT query_id, ref_hash, node_hash, coalesce(recall_path, 'none') AS path, row_number() OVER (PARTITION BY query_id, coalesce(recall_path, 'none') ORDER BY score DESC NULLS LAST, ref_hash) AS rank FROM ({R})"


def _ranked(spark, d):
    r = _refs(spark, d).withColumn("path", F.coalesce("recall_path", F.lit("none")))
    return r.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "path").orderBy(F.col("score").desc_nulls_last(), "ref_hash"))).select("query_id", "ref_hash", "node_hash", "path", "rank")


@query(f"SELECT query_id, ref_hash, path, rank FROM ({RANKED}) WHERE rank <= CASE path WHEN 'embedding' THEN 4 WHEN 'sparse' THEN 2 WHEN 'keyword' THEN 1 ELSE 0 END")
def retrieval_merge_paths(spark, d):
    return retrieval.merge_paths(_ranked(spark, d), "query_id", "ref_hash", "path", "rank", {"embedding": 4, "sparse": 2, "keyword": 1})


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, ref_hash) AS rk FROM ({R})),
  b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, node_hash ORDER BY rk) = 1 THEN 0 ELSE 1 END AS t FROM a)
  SELECT query_id, ref_hash, row_number() OVER (PARTITION BY query_id ORDER BY t, rk) AS place FROM b""")
def retrieval_diversify(spark, d):
    r = _refs(spark, d).withColumn("rk", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "ref_hash")))
    return retrieval.diversify(r, "query_id", "node_hash", "rk").select("query_id", "ref_hash", "place")


@query(f"""WITH RECURSIVE c AS (SELECT query_id, ref_hash, greatest(1, coalesce(token_estimate, 1)) AS t, coalesce(score, -1) AS s, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, -1) DESC, ref_hash) AS n FROM ({R})),
  f AS (SELECT query_id, ref_hash, n, s >= 0.2 AND t <= 300 AS selected, CASE WHEN s >= 0.2 AND t <= 300 THEN t ELSE 0 END AS used FROM c WHERE n = 1
    UNION ALL SELECT c.query_id, c.ref_hash, c.n, c.s >= 0.2 AND f.used + c.t <= 300, f.used + CASE WHEN c.s >= 0.2 AND f.used + c.t <= 300 THEN c.t ELSE 0 END FROM f JOIN c ON c.query_id = f.query_id AND c.n = f.n + 1)
  SELECT query_id, ref_hash, selected FROM f""")
def retrieval_pack(spark, d):
    return retrieval.pack(_refs(spark, d), "query_id", "score", "ref_hash", "token_estimate", 300, 10_000, 0.2).select("query_id", "ref_hash", "selected")


@query(f"""SELECT ref_type, count(*) AS count, CAST(sum(token_estimate) AS BIGINT) AS sum, round(avg(token_estimate), 6) AS avg, max(token_estimate) AS max,
  arg_max(token_estimate, (updated_at_ms, query_id, ref_hash)) FILTER (token_estimate IS NOT NULL) AS latest FROM ({R}) GROUP BY 1""")
def retrieval_statistics(spark, d):
    r = _refs(spark, d).withColumn("at", F.when(F.col("token_estimate").isNotNull(), F.struct("updated_at_ms", "query_id", "ref_hash")))
    return retrieval.statistics(r, ["ref_type"], "token_estimate", "at").select("ref_type", "count", "sum", F.round("avg", 6).alias("avg"), "max", "latest")


@query("SELECT node_hash, coalesce(kind = 1, true) AND coalesce(tenant = 6703009289952758402, true) AS pass FROM context_node")
def retrieval_scope(spark, d):
    n = table(spark, d, "context_node")
    return n.select("node_hash", retrieval.in_scope({"kind": F.col("kind"), "tenant": F.col("tenant")}, {"kind": 1, "tenant": 6703009289952758402}).alias("pass"))


@query(f"""SELECT delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant, node_hash ORDER BY ingestion_time_ms DESC NULLS LAST, delivery_id DESC) AS n,
    bool_or(event_type = 4) OVER (PARTITION BY tenant, node_hash) AS c FROM ({E})) WHERE NOT c OR n <= 3""")
def retrieval_admit_raw(spark, d):
    e = _events(spark, d)
    return retrieval.admit_raw(e, e.filter("event_type = 4"), 3).select("delivery_id")


@query("""SELECT seq, min(seq) OVER (PARTITION BY event_id_hash) AS first_seq FROM context_record WHERE event_id_hash IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id_hash ORDER BY updated_at_ms DESC NULLS LAST, seq DESC) = 1 UNION ALL SELECT seq, seq FROM context_record WHERE event_id_hash IS NULL""")
def record_latest_values(spark, d):
    r = table(spark, d, "context_record").select("seq", "event_id_hash", "updated_at_ms")
    return retrieval.compact_latest(r, F.col("event_id_hash"), "updated_at_ms", "seq").select("seq", "first_seq")


@query("""WITH t AS (SELECT delivery_id, node_hash AS k, status AS rank, delivery_id AS seq FROM context_event WHERE node_hash IS NOT NULL AND status IS NOT NULL),
  a AS (SELECT *, coalesce(rank >= max(rank) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM t)
  SELECT delivery_id, accepted, seq = max(CASE WHEN accepted THEN seq END) OVER (PARTITION BY k) AS current FROM a""")
def record_keyed_truth(spark, d):
    e = table(spark, d, "context_event").filter("node_hash is not null and status is not null").select("delivery_id", F.col("node_hash").alias("k"), F.col("status").alias("rank"), F.col("delivery_id").alias("seq"))
    return retrieval.keyed_truth(e, "k", "rank", "seq").select("delivery_id", "accepted", "current")


@query("""SELECT delivery_id FROM context_event e LEFT JOIN (SELECT node_hash, max(delivery_id) AS t FROM context_event WHERE event_type = 5 GROUP BY 1) x ON x.node_hash = e.node_hash WHERE t IS NULL OR delivery_id > t""")
def record_tombstones(spark, d):
    e = table(spark, d, "context_event")
    return retrieval.without_forgotten(e, e.filter("event_type = 5").select("node_hash", "delivery_id"), "node_hash", "delivery_id").select("delivery_id")


@query(f"""SELECT delivery_id FROM context_event e LEFT JOIN (SELECT tenant, max(ts_ms) - 86400000 AS c FROM context_event WHERE ts_ms < 2000000000000 GROUP BY 1) x ON x.tenant = e.tenant
  WHERE (valid_until_ms IS NULL OR valid_until_ms > {END + 2_000_000_000}) AND (c IS NULL OR created_at_ms >= c)""")
def record_visible(spark, d):
    e = table(spark, d, "context_event")
    cut = e.filter("ts_ms < 2000000000000").groupBy("tenant").agg((F.max("ts_ms") - 86_400_000).alias("cutoff_ms"))
    rows = e.select("delivery_id", "tenant", F.col("valid_until_ms").alias("expires_at_ms"), F.col("created_at_ms").alias("occurred_ms"))
    return retrieval.visible(rows, cut, END + 2_000_000_000, ["tenant"]).select("delivery_id")


# -- content --------------------------------------------------------------------------------------------------------
@query()
def content_chunks(spark, d):
    return content.chunks(table(spark, d, "documents")).select("doc_id", "chunk", "path", "level", "start", "end")


@query(r"""SELECT doc_id, term, n FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents) WHERE length(term) >= 4 GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) <= 12""")
def content_keywords(spark, d):
    return content.keywords(table(spark, d, "documents"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''), lambda t: CASE WHEN t LIKE '%@%' AND t LIKE '%.%' THEN '[redacted-email]'
  WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) >= 8 THEN '[redacted-id]' ELSE t END), ' ') AS text FROM documents""")
def content_redact_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", text.redact_tokens(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, CAST(greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''))) AS INT) AS spaced, CAST(greatest(1, ceil(strlen(text) / 4.0)) AS INT) AS bytes,
  CAST(len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS INT) AS words FROM documents""")
def content_token_estimates(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.whitespace_tokens(t).alias("spaced"), text.byte_tokens(t).alias("bytes"), text.word_tokens(t).alias("words"))


W18 = "array_to_string(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')[:{1}], ' ')"
SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[.\n!?]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
MARKERS = "['now', 'changed', 'updated', 'corrected', 'correction', 'instead', 'no longer', 'moved', 'switched', 'rescheduled', 'deadline', 'because', 'after', 'before']"


@query(f"""WITH d AS (SELECT doc_id, lang, resource_type, text, {SENT} AS said FROM documents),
  f AS (SELECT doc_id, said, unnest(said[2:]) AS s, generate_subscripts(said[2:], 1) AS pos FROM d),
  k AS (SELECT doc_id, s, pos, CASE WHEN regexp_matches(s, '[0-9]') THEN 3 ELSE 0 END + len(list_filter(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')[2:], lambda w: regexp_matches(w, '^[A-Z]')))
      + 2 * len(list_filter({MARKERS}, lambda m: contains(lower(s), m))) AS worth FROM f),
  t AS (SELECT doc_id, string_agg({W18.format('s', 32)}, ' | ' ORDER BY worth DESC, pos) AS facts FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY worth DESC, pos) <= 7) GROUP BY 1)
  SELECT doc_id, {W18.format("coalesce(resource_type, 'none') || ': ' || coalesce(said[1], trim(text))", 18)} AS l0,
    CASE WHEN len(said) >= 3 OR len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 180 THEN 'kind=' || coalesce(lang, '') || '; title=' || coalesce(resource_type, 'none') || '; key_facts='
      || {W18.format('said[1]', 32)} || coalesce(' | ' || facts, '') END AS l1 FROM d LEFT JOIN t USING (doc_id)""")
def content_summaries(spark, d):
    """L0 and L1 of every document."""
    t, title = F.col("text"), F.coalesce("resource_type", F.lit("none"))
    return table(spark, d, "documents").select("doc_id", content.lead(t, title=title).alias("l0"), content.summary(t, F.coalesce("lang", F.lit("")), title).alias("l1"))


@query()
def content_embedding(spark, d):
    """Held against a plain program in the tests."""
    return table(spark, d, "documents").select("doc_id", hashing.deterministic_embedding("text").alias("vector"))


C = "SELECT session_id, ts_ms, row_id, lower(trim(role)) AS role, tool_name FROM chat_message WHERE session_id IS NOT NULL AND ts_ms IS NOT NULL"


@query(f"""WITH e AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, row_id ROWS UNBOUNDED PRECEDING) AS episode FROM ({C})),
  s AS (SELECT *, lag(tool_name) OVER (PARTITION BY session_id, episode ORDER BY ts_ms, row_id) AS before FROM e WHERE tool_name IS NOT NULL AND episode > 0)
  SELECT session_id, CAST(episode AS BIGINT) AS episode, string_agg(tool_name, '>' ORDER BY ts_ms, row_id) FILTER (before IS NULL OR before <> tool_name) AS signature FROM s GROUP BY 1, 2""")
def content_episodes(spark, d):
    c = table(spark, d, "chat_message").filter("session_id is not null and ts_ms is not null").withColumn("role", F.lower(F.trim("role")))
    return content.episodes(c, "session_id", "ts_ms", "role", "tool_name", ["row_id"])


@query(f"""WITH e AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, row_id ROWS UNBOUNDED PRECEDING) AS episode FROM ({C})),
  s AS (SELECT *, lag(tool_name) OVER (PARTITION BY session_id, episode ORDER BY ts_ms, row_id) AS before FROM e WHERE tool_name IS NOT NULL AND episode > 0),
  g AS (SELECT session_id, episode, string_agg(tool_name, '>' ORDER BY ts_ms, row_id) FILTER (before IS NULL OR before <> tool_name) AS signature FROM s GROUP BY 1, 2)
  SELECT signature, count(*) AS support, count(DISTINCT session_id) AS sessions FROM g GROUP BY 1 HAVING count(*) >= 2 AND len(string_split(signature, '>')) >= 1 ORDER BY support DESC, signature LIMIT 64""")
def content_skills(spark, d):
    c = table(spark, d, "chat_message").filter("session_id is not null and ts_ms is not null").withColumn("role", F.lower(F.trim("role")))
    return content.skills(content.episodes(c, "session_id", "ts_ms", "role", "tool_name", ["row_id"]), "session_id", 2, 1)


@query(f"""WITH g AS (SELECT session_id, role, pos, pos - row_number() OVER (PARTITION BY session_id, role ORDER BY pos) AS g FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, row_id) AS pos FROM ({C})))
  SELECT session_id, role, min(pos) AS first, max(pos) AS last, count(*) AS n FROM g GROUP BY session_id, role, g""")
def content_segments(spark, d):
    c = table(spark, d, "chat_message").filter("session_id is not null and ts_ms is not null").withColumn("role", F.lower(F.trim("role")))
    c = c.withColumn("pos", F.row_number().over(W.partitionBy("session_id").orderBy("ts_ms", "row_id"))).withColumn("w", F.lit(1.0))
    return content.segments(c, "session_id", "pos", "role", "w").select("session_id", "role", "first", "last", "n")


@query("""WITH r AS (SELECT DISTINCT tenant, ref_type, updated_at_ms - updated_at_ms % 86400000 AS bucket_ms, ref_hash FROM context_ref),
  p AS (SELECT *, CAST((row_number() OVER (PARTITION BY tenant, ref_type, bucket_ms ORDER BY ref_hash) - 1) // 4 AS INT) AS part FROM r)
  SELECT tenant, ref_type, bucket_ms, part, array_to_string(list_sort(list(ref_hash)), ',') AS refs FROM p GROUP BY ALL""")
def content_compact_postings(spark, d):
    out = content.compact_postings(table(spark, d, "context_ref"), ["tenant", "ref_type"], "updated_at_ms", "ref_hash", 86_400_000, 4)
    return out.withColumn("refs", F.array_join(F.col("refs").cast("array<string>"), ","))
