"""Registered queries over series, sequences, counters and running decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import counters, decisions, sequences, series
from tidemark.runtime import table

# 2024-01-10 to 2024-01-20, in epoch milliseconds
START, END = 1_704_844_800_000, 1_705_708_800_000
HOUR, DAY = 3_600_000, 86_400_000

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, d: str, bounded: bool = False) -> DataFrame:
    events = table(spark, d, "events")
    return schemas.within(events, START, END) if bounded else events


def _points(spark: SparkSession, d: str, bounded: bool = False) -> DataFrame:
    return schemas.points(_events(spark, d, bounded))


def _rows(spark: SparkSession, d: str, bounded: bool = False) -> DataFrame:
    return schemas.sequence_rows(_events(spark, d, bounded))


P = "SELECT CAST(user_id AS VARCHAR) AS key, (epoch_us(ts) // 1000) AS ts_ms, CAST(floor(value) AS BIGINT) AS v, event_id AS seq, event_type, user_id, ts FROM events"
S = """SELECT CAST(user_id AS VARCHAR) AS key, (epoch_us(ts) // 1000) AS ts_ms, event_id AS gid,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'error' THEN 5 ELSE 0 END AS action_type,
  CAST(floor(value) AS BIGINT) AS duration, CAST(json_extract_string(props, '$.k') AS BIGINT) AS author_id FROM events"""
IN = f"ts_ms BETWEEN {START} AND {END}"


@query(f"""SELECT key, CAST(sum(v) AS BIGINT) AS sum, CAST(sum(v) // count(v) AS BIGINT) AS avg, min(v) AS min, max(v) AS max, arg_min(v, ts_ms) AS first,
  arg_max(v, ts_ms) AS last, count(*) AS count FROM ({P}) WHERE {IN} GROUP BY key""")
def feature_agg_all(spark, d):
    return series.aggregates(_points(spark, d, True), START, END)


@query(f"""SELECT key, CAST(sum(v) AS BIGINT) AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms) AS n FROM ({P}) WHERE {IN}) WHERE n <= 5 GROUP BY key""")
def feature_agg_first_five(spark, d):
    return series.aggregate(_points(spark, d, True), START, END, "sum", 5)


@query(f"SELECT key, ts_ms, CAST(v AS VARCHAR) AS value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms) AS n FROM ({P}) WHERE {IN}) WHERE n <= 10")
def feature_query(spark, d):
    return series.window(_points(spark, d, True), START, END, 10)


@query(f"SELECT key, ts_ms, CAST(v AS VARCHAR) AS value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms) AS n FROM ({P}) WHERE {IN}) WHERE n <= 20 AND v > 100")
def feature_query_filtered(spark, d):
    return series.window_filtered(_points(spark, d, True), START, END, 20, series.numeric(F.col("value")) > 100)


def _hourly(spark, d):
    """Points whose times are cut to the hour, so that writes collide."""
    return _points(spark, d).withColumn("ts_ms", F.col("ts_ms") - F.col("ts_ms") % DAY)


H = f"SELECT key, ts_ms - ts_ms % {DAY} AS ts_ms, CAST(v AS VARCHAR) AS value, seq FROM ({P})"


@query(f"SELECT key, ts_ms, arg_max(value, seq) AS value, max(seq) AS seq FROM ({H}) GROUP BY key, ts_ms")
def feature_append(spark, d):
    return series.append(None, _hourly(spark, d), max_points=None)


@query(f"""WITH h AS ({H}), old AS (SELECT key, ts_ms, arg_max(value, seq) AS value, max(seq) AS seq FROM h WHERE seq % 3 = 0 GROUP BY ALL),
  new AS (SELECT key, ts_ms, arg_min(value, seq) AS value, min(seq) AS seq FROM h WHERE seq % 3 <> 0 GROUP BY ALL)
  SELECT key, ts_ms, CASE WHEN old.seq IS NOT NULL THEN old.value ELSE new.value END AS value, coalesce(old.seq, new.seq) AS seq FROM old FULL JOIN new USING (key, ts_ms)""")
def feature_append_first(spark, d):
    """Points that exist stay; of new ones the first write counts."""
    rows = _hourly(spark, d)
    return series.append(series.append(None, rows.filter("seq % 3 = 0"), max_points=None), rows.filter("seq % 3 <> 0"), "first", None)


@query(f"""WITH h AS ({H}), old AS (SELECT key, ts_ms, arg_max(value, seq) AS value, max(seq) AS seq FROM h WHERE seq % 3 = 0 GROUP BY ALL),
  new AS (SELECT key, ts_ms, arg_max(value, seq) AS value, max(seq) AS seq FROM h WHERE seq % 3 <> 0 GROUP BY ALL)
  SELECT old.key, old.ts_ms, coalesce(new.value, old.value) AS value, coalesce(new.seq, old.seq) AS seq FROM old LEFT JOIN new USING (key, ts_ms)""")
def feature_append_update(spark, d):
    rows = _hourly(spark, d)
    return series.append(series.append(None, rows.filter("seq % 3 = 0"), max_points=None), rows.filter("seq % 3 <> 0"), "update", None)


@query(f"SELECT key, ts_ms, CAST(v AS VARCHAR) AS value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC) AS n FROM ({P})) WHERE n <= 25")
def feature_trim(spark, d):
    return series.trim(_points(spark, d), 25)


@query(f"""WITH p AS (SELECT key, ts_ms, CAST(v AS VARCHAR) AS value, seq FROM ({P})), n AS (SELECT DISTINCT key FROM p WHERE seq % 7 = 0)
  SELECT key, ts_ms, value, CAST(-1 AS BIGINT) AS seq FROM p WHERE NOT (key IN (SELECT key FROM n) AND ts_ms BETWEEN {START} AND {END})
  UNION ALL SELECT key, CAST({END} + 1 AS BIGINT), '0', CAST(0 AS BIGINT) FROM n""")
def feature_replace(spark, d):
    p = _points(spark, d)
    new = p.filter("seq % 7 = 0").select("key").distinct().select("key", F.lit(END + 1).cast("bigint").alias("ts_ms"), F.lit("0").alias("value"), F.lit(0).cast("bigint").alias("seq"))
    return series.replace(p, START, END, new)


@query(f"SELECT key, ts_ms, CAST(v AS VARCHAR) AS value, seq FROM ({P}) WHERE key NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE value > 150)")
def feature_delete(spark, d):
    gone = table(spark, d, "events").filter("value > 150").select(F.col("user_id").cast("string").alias("key"))
    return series.delete(_points(spark, d), gone)


@query(f"SELECT * FROM ({S}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_ms, gid) <= 1000000 AND {IN}")
def sequence_add(spark, d):
    return sequences.query(_rows(spark, d, True), START, END, 1_000_000)


@query(f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms, gid) AS n FROM ({S}) WHERE {IN}) WHERE n <= 15 AND action_type = 2 AND duration > 30")
def sequence_query(spark, d):
    return sequences.query(_rows(spark, d, True), START, END, 15, sequences.parse_filters(["action_type = 1", "duration > 30", "action_type = 2"]))


@query(f"""WITH specs AS (SELECT c_custkey AS spec_id, CAST(c_custkey AS VARCHAR) AS key, {START} + (c_custkey % 5) * {DAY} AS s, {START} + (c_custkey % 5 + 4) * {DAY} AS e FROM customer)
  SELECT spec_id, key, ts_ms, gid, action_type, duration, author_id FROM (
    SELECT spec_id, r.*, row_number() OVER (PARTITION BY spec_id ORDER BY ts_ms, gid) AS n FROM specs JOIN ({S}) r USING (key) WHERE ts_ms BETWEEN s AND e) WHERE n <= 8 AND duration >= 20""")
def sequence_batch_query(spark, d):
    k = F.col("c_custkey")
    specs = table(spark, d, "customer").select(
        k.alias("spec_id"), k.cast("string").alias("key"), (START + (k % 5) * DAY).alias("start_ms"), (START + (k % 5 + 4) * DAY).alias("end_ms"), F.lit(8).alias("count"), F.lit(20).alias("min_duration"))
    return sequences.batch_query(_rows(spark, d), specs)


def _increments(spark, d, bounded=False):
    e = _events(spark, d, bounded)
    return e.select(F.lit("h").alias("family"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), schemas.epoch_ms("ts").alias("ts_ms"), F.floor("value").cast("bigint").alias("amount"), F.col("event_id").alias("seq"))


C = "SELECT 'h' AS family, user_id || ':' || event_type AS key, (epoch_us(ts) // 1000) AS ts_ms, CAST(floor(value) AS BIGINT) AS amount, event_id AS seq FROM events"
B = f"SELECT family, key, ts_ms - ts_ms % {HOUR} AS bucket_ms, CAST(sum(amount) AS BIGINT) AS amount FROM ({C}) GROUP BY ALL"
BIN = f"bucket_ms BETWEEN {START} AND {END}"


@query(f"SELECT family, key, ts_ms AS bucket_ms, CAST(sum(amount) AS BIGINT) AS amount FROM ({C}) GROUP BY ALL")
def control_increment(spark, d):
    return counters.buckets(_increments(spark, d))


@query(B)
def control_increment_precision(spark, d):
    return counters.buckets(_increments(spark, d), HOUR)


@query(f"SELECT family, key, CAST(sum(amount) AS BIGINT) AS value FROM ({C}) WHERE {IN} GROUP BY ALL")
def control_count(spark, d):
    return counters.read(counters.buckets(_increments(spark, d, True)), START, END)


@query(f"""SELECT family, key, count(*) AS events, CAST(sum(amount) AS BIGINT) AS sum, min(amount) AS min, max(amount) AS max, arg_min(amount, bucket_ms) AS first, arg_max(amount, bucket_ms) AS last FROM ({B}) WHERE {BIN} GROUP BY ALL""")
def control_query(spark, d):
    return counters.read_many(counters.buckets(_increments(spark, d), HOUR), START, END, ["events", "sum", "min", "max", "first", "last"])


@query(f"SELECT family, key, bucket_ms, CAST(amount AS VARCHAR) AS amount FROM ({B}) WHERE {BIN} QUALIFY row_number() OVER (PARTITION BY family, key ORDER BY bucket_ms) <= 3")
def control_detail(spark, d):
    return counters.detail(counters.buckets(_increments(spark, d), HOUR), START, END, 3)


def _changes(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), schemas.epoch_ms("ts").alias("ts_ms"), F.get_json_object("props", "$.k").alias("value"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS key, count(DISTINCT json_extract_string(props, '$.k')) AS value FROM events WHERE (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {HOUR} BETWEEN {START} AND {END} GROUP BY ALL")
def control_change_distinct(spark, d):
    return counters.distinct_values(_changes(spark, d), START, END, HOUR)


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, true AS within_five_percent FROM events")
def control_change_sketch(spark, d):
    """Estimates from daily sketches over everything, held against the exact numbers."""
    c = _changes(spark, d)
    exact = c.groupBy("key").agg(F.count_distinct("value").alias("n"))
    out = counters.distinct_estimate(counters.distinct_sketches(c, DAY), 0, 2**60).join(exact, "key")
    return out.select("key", (F.abs(F.col("value") - F.col("n")) <= 0.05 * F.col("n")).alias("within_five_percent"))


@query(f"""SELECT *, CAST(sum(amount) OVER (PARTITION BY family, key ORDER BY ts_ms RANGE BETWEEN {DAY} PRECEDING AND 0 PRECEDING) AS BIGINT) AS value FROM ({C})""")
def control_set_and_get(spark, d):
    return counters.set_and_get(_increments(spark, d), DAY)


@query(f"""WITH r AS (SELECT *, key || '-' || (amount % 3) AS uuid FROM ({C})),
  m AS (SELECT *, ts_ms - ts_ms % {HOUR} AS b, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY family, key, uuid ORDER BY ts_ms, seq) <= 300000 THEN 0 ELSE amount END AS a FROM r)
  SELECT family, key, ts_ms, amount, seq, uuid, CAST(coalesce(sum(a) OVER (PARTITION BY family, key ORDER BY b RANGE BETWEEN {DAY} PRECEDING AND 1 PRECEDING), 0)
    + sum(a) OVER (PARTITION BY family, key, b ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM m""")
def control_set_and_get_options(spark, d):
    inc = _increments(spark, d).withColumn("uuid", F.concat_ws("-", "key", (F.col("amount") % 3).cast("string")))
    return counters.set_and_get(inc, DAY, HOUR, "uuid")


def _selections(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), schemas.epoch_ms("ts").alias("occur_time_ms"), F.col("event_id").alias("seq"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_min(event_type, ts) AS value, (epoch_us(min(ts)) // 1000) AS occur_time_ms FROM events GROUP BY ALL")
def control_selection_first(spark, d):
    return counters.select_first_last(_selections(spark, d), "first")


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, ts) AS value, (epoch_us(max(ts)) // 1000) AS occur_time_ms FROM events GROUP BY ALL")
def control_selection_last(spark, d):
    return counters.select_first_last(_selections(spark, d), "last")


@query(f"SELECT family, key, string_agg(CAST(bucket_ms AS VARCHAR), ',' ORDER BY bucket_ms) AS fields FROM ({B}) WHERE {BIN} GROUP BY ALL")
def control_manager_fields(spark, d):
    return counters.manager(counters.buckets(_increments(spark, d), HOUR), "5", START, END)


@query(f"SELECT key, count(DISTINCT family) AS families, count(*) AS buckets, CAST(sum(amount) AS BIGINT) AS total FROM ({B}) GROUP BY ALL")
def control_manager_summary(spark, d):
    return counters.manager(counters.buckets(_increments(spark, d), HOUR), "summary")


@query(f"""SELECT family, key, count(*) AS events, CAST(sum(amount) AS BIGINT) AS sum, count(*) FILTER ({BIN}) AS window_events, CAST(coalesce(sum(amount) FILTER ({BIN}), 0) AS BIGINT) AS window_sum,
  min(bucket_ms) FILTER ({BIN}) AS first_ms, max(bucket_ms) FILTER ({BIN}) AS last_ms FROM ({B}) GROUP BY ALL""")
def control_debug(spark, d):
    return counters.debug(counters.buckets(_increments(spark, d), HOUR), START, END)


@query(" UNION ALL ".join(f"SELECT family, key, CAST({ms} AS BIGINT) AS level_ms, ts_ms - ts_ms % {ms} AS bucket_ms, CAST(sum(amount) AS BIGINT) AS amount FROM ({C}) GROUP BY ALL" for ms in counters.LADDER))
def rollup_ladder(spark, d):
    return counters.ladder(_increments(spark, d))


@query(f"SELECT family, key, CAST(sum(amount) AS BIGINT) AS value FROM ({C}) WHERE ts_ms BETWEEN {START + 12345} AND {END + 67890} GROUP BY ALL")
def rollup_window_sum(spark, d):
    cells = counters.cells_of(_increments(spark, d), START + 12_345, END + 67_890)
    return cells.groupBy("family", "key").agg(F.sum("amount").alias("value"))


@query(f"SELECT family, key, CAST(sum(amount) AS BIGINT) AS value FROM ({C}) WHERE ts_ms BETWEEN {START + 54321} AND {END + 98765} GROUP BY ALL")
def rollup_stored_window_sum(spark, d):
    """The same from a ladder that has been built before: coarse cells inside, raw rows at the edges."""
    inc = _increments(spark, d)
    return counters.window_sum(counters.ladder(inc), inc, START + 54_321, END + 98_765)


@query(f"""WITH b AS (SELECT family, key, CAST(sum(amount) AS BIGINT) AS amount FROM ({C}) WHERE ts_ms >= {START} AND ts_ms < {END} GROUP BY family, key, ts_ms - ts_ms % {DAY}),
  u AS (SELECT family, key, amount, amount AS n FROM b UNION ALL SELECT family, key, amount, 1 FROM ({C}) WHERE ts_ms BETWEEN {END} AND {END + HOUR})
  SELECT family, key, CAST(sum(n) AS BIGINT) AS count, CAST(sum(amount) AS BIGINT) AS sum, min(amount) AS min, max(amount) AS max, CAST(floor(CAST(sum(amount) AS DOUBLE) / nullif(sum(n), 0)) AS BIGINT) AS avg FROM u GROUP BY ALL""")
def rollup_long_window(spark, d):
    return counters.long_window(_increments(spark, d), START, END + HOUR, DAY)


def _attempts(spark, d):
    return table(spark, d, "events").select("user_id", "event_type", schemas.epoch_ms("ts").alias("ts_ms"), F.col("event_id").alias("seq"), F.floor("value").cast("bigint").alias("amount"))


A = "SELECT user_id, event_type, (epoch_us(ts) // 1000) AS ts_ms, event_id AS seq, CAST(floor(value) AS BIGINT) AS amount FROM events"
DAYOF = f"ts_ms - ts_ms % {DAY}"


@query(f"SELECT *, count(*) OVER (PARTITION BY user_id, event_type, {DAYOF} ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS used, used <= 2 AS allowed FROM ({A})")
def decision_running_cap(spark, d):
    return decisions.running_cap(_attempts(spark, d), ["user_id", "event_type"], 2)


@query(f"SELECT *, row_number() OVER (PARTITION BY user_id, {DAYOF} ORDER BY ts_ms, seq) <= 2 AS allowed FROM ({A})")
def decision_accepted_cap(spark, d):
    return decisions.accepted_cap(_attempts(spark, d), ["user_id"], 2)


@query(f"SELECT *, CAST(sum(amount) OVER (PARTITION BY user_id, {DAYOF} ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used, used <= 300 AS allowed FROM ({A})")
def decision_weighted_quota(spark, d):
    return decisions.running_cap(_attempts(spark, d), ["user_id"], 300, amount=F.col("amount"))


@query(f"SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS recent, recent >= 4 AS suppressed FROM ({A})")
def decision_rolling_suppression(spark, d):
    return decisions.suppressed(_attempts(spark, d), ["user_id"], DAY, 4)


@query(f"SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW) AS recent, recent <= 1 AS allowed FROM ({A})")
def decision_rate_limit(spark, d):
    return decisions.rate_limited(_attempts(spark, d), ["user_id"], HOUR, 1)


@query(f"SELECT *, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, seq) > {HOUR}, true) AS allowed FROM ({A})")
def decision_debounce(spark, d):
    return decisions.debounced(_attempts(spark, d), ["user_id"], HOUR)


@query(f"SELECT *, count(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS uniques FROM ({A})")
def decision_trailing_distinct(spark, d):
    return decisions.trailing_distinct(_attempts(spark, d), ["user_id"], "event_type", DAY)


@query(f"SELECT *, row_number() OVER (PARTITION BY user_id, amount ORDER BY ts_ms, seq) = 1 AS counts FROM ({A})")
def decision_event_dedup(spark, d):
    return decisions.once(_attempts(spark, d), ["user_id"], "amount", "ts_ms", "seq")


@query("""SELECT day, round(CASE WHEN r < 0.95 THEN least(2.0, 1 + (1 - r)) WHEN r > 1.05 THEN greatest(0.0, 1 - (r - 1)) ELSE 1.0 END, 3) AS factor FROM (
  SELECT CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 300.0 AS r FROM lineitem GROUP BY ALL)""")
def decision_pacing(spark, d):
    spend = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("s"))
    return spend.select("day", decisions.pacing(F.col("s").cast("double"), F.lit(300.0)).alias("factor"))


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id, amount ORDER BY ts_ms, seq) = 1 OR amount IS NULL AS counts FROM ({A}))
  SELECT *, CAST(sum(CAST(counts AS INT)) OVER (PARTITION BY user_id, {DAYOF} ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used, used <= 2 AS allowed FROM o""")
def decision_counted_impressions(spark, d):
    """Dedup and cap together: an id counts once."""
    return decisions.counted_impressions(_attempts(spark, d), ["user_id"], "amount", 2)


STEPS = f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, seq) AS n FROM ({A})"


@query(f"""WITH RECURSIVE r AS ({STEPS}), z AS (SELECT *, coalesce(amount, 0) <= 1000 AS allowed, CASE WHEN coalesce(amount, 0) <= 1000 THEN CAST(coalesce(amount, 0) AS DOUBLE) ELSE 0.0 END AS level FROM r WHERE n = 1
    UNION ALL SELECT r.*, z.level + coalesce(r.amount, 0) <= 1000, CASE WHEN z.level + coalesce(r.amount, 0) <= 1000 THEN z.level + coalesce(r.amount, 0) ELSE z.level END FROM z JOIN r ON r.user_id = z.user_id AND r.n = z.n + 1)
  SELECT * EXCLUDE (n) FROM z""")
def decision_budget_gate(spark, d):
    return decisions.budget_gate(_attempts(spark, d), ["user_id"], 1000.0, "amount")


@query(f"""WITH RECURSIVE r AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS delta FROM ({STEPS})), z AS (SELECT *, true AS allowed, CAST(greatest(delta, 0) AS DOUBLE) AS level FROM r WHERE n = 1
    UNION ALL SELECT r.*, r.delta < 0 OR z.level + 1 <= 3, CASE WHEN r.delta < 0 THEN greatest(z.level - 1, 0) WHEN z.level + 1 <= 3 THEN z.level + 1 ELSE z.level END FROM z JOIN r ON r.user_id = z.user_id AND r.n = z.n + 1)
  SELECT * EXCLUDE (n) FROM z""")
def decision_slots(spark, d):
    delta = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    return decisions.slots(_attempts(spark, d).withColumn("delta", delta), ["user_id"], 3, "delta")


@query(f"SELECT *, count(*) OVER (PARTITION BY user_id, {DAYOF} ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS used, greatest(0, 5 - used) AS remaining FROM ({A})")
def decision_quota_remaining(spark, d):
    return decisions.running_cap(_attempts(spark, d), ["user_id"], 5).drop("allowed").withColumn("remaining", decisions.remaining(5, F.col("used")))


@query(f"""WITH r AS (SELECT * FROM ({A}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC) <= 10),
  g AS (SELECT user_id, event_type AS id, CAST(sum(amount) AS BIGINT) AS total FROM r GROUP BY ALL)
  SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY total DESC, id) <= 2""")
def instance_top_features(spark, d):
    rows = _attempts(spark, d).withColumn("features", F.array(F.struct(F.col("event_type").alias("id"), F.col("amount").alias("v1"))))
    return decisions.last_instances(rows, "user_id", 10, 2, "features")
