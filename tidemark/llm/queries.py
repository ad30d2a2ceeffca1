"""Registered queries of the training-data problems, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversations, leakage, mixing, pii, ranking, reading, topn
from tidemark.runtime import table

_SCORES = ["time_score", "embedding_score", "sparse_score", "keyword_score"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of ``chat_message`` to be left out."""
    return conversations.sessions(table(spark, sf_dir, "chat_message")).filter("broken").select("session_id")


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered messages of all sessions that are whole."""
    return conversations.turns(table(spark, sf_dir, "chat_message")).select("session_id", "position", "row_id", "role")


_TEXTS = {"chat_message": ("row_id", "content"), "context_event": ("delivery_id", "text"), "documents": ("doc_id", "text")}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in the three tables with free text."""
    parts = [pii.find_items(table(spark, sf_dir, src), row, text).withColumn("src", F.lit(src)) for src, (row, text) in _TEXTS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("src", "row_id", "kind", "surface")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with typed placeholders."""
    parts = [
        pii.redact(table(spark, sf_dir, src).select(F.lit(src).alias("src"), F.col(row).alias("row_id"), F.col(text).alias("text")), "text") for src, (row, text) in _TEXTS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best refs of every node."""
    refs = table(spark, sf_dir, "context_ref")
    return topn.top_n(refs, ["node_hash"], "ref_hash", [("score", "descending"), ("token_estimate", "ascending")], 5).select("node_hash", "ref_hash")


def _p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_walk(table(spark, sf_dir, "context_ref"), "query_id", "ref_hash", _SCORES)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs that come first in their query whatever the weights of the scores."""
    return ranking.always_first(_p7(spark, sf_dir), _SCORES).select("query_id", "ref_hash")


def p7_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole order of every query's candidates; weights in ten-millionths, rounded where no short fraction lies on the edge."""
    return _p7(spark, sf_dir).select("query_id", "ref_hash", "place", F.floor(F.col("weight") * 1e7 + 0.381966).alias("weight_e7"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a passage of an evaluation item."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each leaked item stands."""
    return leakage.report(p8_found(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mix that reaches the target shares, with how often each is used."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of that mix."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target"))[1]


#: How far the larger mix goes beyond the largest one with exact shares.
BEYOND = 1.25


def p9_mix_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix a quarter larger than ``p9_mix``: the scarcest sources are held at their caps and the others make up for them."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target"), stretch=BEYOND)[0]


def p9_shares_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of that larger mix."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target"), stretch=BEYOND)[1]


def _p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_label"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are demanding to read: level 4 or 5."""
    return _p10(spark, sf_dir).filter("level >= 3.5").select("doc_id").distinct()


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents stand at each level."""
    return _p10(spark, sf_dir).groupBy(F.round("level").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_turns, p3_found, p3_redacted, p4_found, p7_found, p7_ranked, p8_found, p8_report, p9_mix, p9_shares, p9_mix_beyond, p9_shares_beyond, p10_found, p10_profile)}

_ALIASES = "CASE " + " ".join(
    f"WHEN r IN ({', '.join(repr(x) for x in names)}) THEN '{role}'" for role, names in conversations.ROLE_ALIASES.items()) + " END"
_MESSAGES = rf"""
  SELECT session_id, ts_ms, min(row_id) AS row_id, any_value({_ALIASES}) AS role, c FROM (
    SELECT *, lower(trim(role, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) AS r, coalesce(content, '') AS c FROM chat_message WHERE session_id IS NOT NULL)
  GROUP BY session_id, ts_ms, coalesce({_ALIASES}, r), c, content IS NULL
"""
_FLAGGED = rf"""
  SELECT session_id, row_id, ts_ms, role, c, trim(translate(c, chr(8203) || chr(160) || chr(9) || chr(10) || chr(13), '     ')) = '' AS blank,
    lead(role) OVER (PARTITION BY session_id, role IN ('user', 'assistant') ORDER BY ts_ms NULLS FIRST, row_id) AS next_role,
    row_number() OVER (PARTITION BY session_id, role IN ('user', 'assistant') ORDER BY ts_ms NULLS FIRST, row_id) AS turn
  FROM ({_MESSAGES})
"""
_BROKEN = f"""
  SELECT session_id FROM ({_FLAGGED}) GROUP BY session_id HAVING
    bool_or(ts_ms IS NULL) OR bool_or(role IS NULL) OR bool_or(coalesce(role IN ('user', 'assistant') AND blank, false)) OR NOT bool_or(coalesce(role = 'user', false))
    OR bool_or(coalesce(role = 'assistant' AND turn = 1, false)) OR bool_or(coalesce(role = 'user', false) AND coalesce(next_role, 'user') <> 'assistant')
"""
_HIGHER = ", ".join(f"rank() OVER (PARTITION BY query_id ORDER BY {s} DESC) - 1 AS h{k}" for k, s in enumerate(_SCORES))
_FLOW = " + ".join(
    f"coalesce(sum(CASE WHEN h{k} > 0 THEN pi / h{k} ELSE 0.0 END) OVER (PARTITION BY query_id ORDER BY h{k} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) + CASE WHEN h{k} = 0 THEN pi ELSE 0.0 END"
    for k in range(4))
#: The walk as a power iteration, one step a recursion.
_WALK = f"""WITH RECURSIVE u AS (SELECT DISTINCT query_id, ref_hash, {', '.join(f'coalesce(CAST({s} AS DOUBLE), -1e300) AS {s}' for s in _SCORES)} FROM context_ref),
  r AS (SELECT query_id, ref_hash, count(*) OVER (PARTITION BY query_id) AS n, {_HIGHER} FROM u),
  w AS (SELECT *, CAST(1.0 AS DOUBLE) / n AS pi, 0 AS step FROM r
    UNION ALL SELECT query_id, ref_hash, n, h0, h1, h2, h3, {ranking.DAMPING} * ({_FLOW}) / 4 + {1 - ranking.DAMPING} / n, step + 1 FROM w WHERE step < {ranking.STEPS})
  SELECT query_id, ref_hash, row_number() OVER (PARTITION BY query_id ORDER BY round(pi * n, {ranking.DECIMALS}) DESC, ref_hash) AS place, CAST(floor(pi * 1e7 + 0.381966) AS BIGINT) AS weight_e7 FROM w WHERE step = {ranking.STEPS}"""
def _spans(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + {leakage.SPAN - 1}], ' ') AS span FROM (
      SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}), unnest(range(1, len(w) - {leakage.SPAN} + 2)) AS r(i)"""


_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM ({_spans('documents', 'doc_id')}) JOIN ({_spans('eval_item', 'item_id')}) USING (span)"
ORACLE = {
    "p8_found": _LEAKS,
    "p8_report": f"SELECT item_id, count(*) AS n_docs FROM ({_LEAKS}) GROUP BY item_id",
    "p1_found": _BROKEN,
    "p7_ranked": _WALK,
    "p1_turns": f"""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, row_id) - 1 AS position, row_id, role
      FROM ({_MESSAGES}) WHERE session_id NOT IN ({_BROKEN})""",
    "p4_found": """SELECT node_hash, ref_hash FROM (
        SELECT node_hash, ref_hash, row_number() OVER (PARTITION BY node_hash ORDER BY score DESC, token_estimate ASC NULLS LAST, ref_hash) AS k
        FROM (SELECT DISTINCT node_hash, ref_hash, score, token_estimate FROM context_ref WHERE score IS NOT NULL AND NOT isnan(score))) WHERE k <= 5""",
    "p7_found": """WITH u AS (
        SELECT DISTINCT query_id, ref_hash, coalesce(time_score, -1e300) AS a, coalesce(embedding_score, -1e300) AS b, coalesce(sparse_score, -1e300) AS c,
          coalesce(CAST(keyword_score AS DOUBLE), -1e300) AS d FROM context_ref),
      r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY a DESC) AS ra, count(*) OVER (PARTITION BY query_id, a) AS ka,
          rank() OVER (PARTITION BY query_id ORDER BY b DESC) AS rb, count(*) OVER (PARTITION BY query_id, b) AS kb,
          rank() OVER (PARTITION BY query_id ORDER BY c DESC) AS rc, count(*) OVER (PARTITION BY query_id, c) AS kc,
          rank() OVER (PARTITION BY query_id ORDER BY d DESC) AS rd, count(*) OVER (PARTITION BY query_id, d) AS kd FROM u)
      SELECT query_id, ref_hash FROM r WHERE ra <= 2 AND rb <= 2 AND rc <= 2 AND rd <= 2
        AND CAST(ra = 1 AND ka = 1 AND a > -1e300 AS INT) + CAST(rb = 1 AND kb = 1 AND b > -1e300 AS INT) + CAST(rc = 1 AND kc = 1 AND c > -1e300 AS INT)
          + CAST(rd = 1 AND kd = 1 AND d > -1e300 AS INT) >= 3""",
}
