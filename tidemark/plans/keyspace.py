"""Registered queries over key-value, hash and set state, with their SQL. Orders are read as a command log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import hashing, text
from tidemark.operators import kv
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
    """Orders as writes to a key per customer; status F deletes; every fifth write carries a time to live."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").cast("string").alias("key"), k.alias("seq"), k.alias("now_ms"), F.col("o_orderpriority").alias("value"), (F.col("o_orderstatus") == "F").alias("deleted"),
        F.when(k % 5 == 0, F.floor(k / 2)).alias("ttl_ms"))


def _state(spark, d):
    return kv.strings(_log(spark, d))


NOW = 10_000
L = "SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS seq, o_orderkey AS now_ms, o_orderpriority AS value, o_orderstatus = 'F' AS deleted, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey // 2 END AS ttl_ms FROM orders"
# a write without a time to live keeps what is left of the last one set since the last delete
LAST = f"""SELECT *, max(CASE WHEN deleted THEN seq ELSE -1 END) OVER w AS cut, max(CASE WHEN NOT deleted AND ttl_ms IS NOT NULL THEN seq ELSE -1 END) OVER w AS marked,
    row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back
  FROM ({L}) WINDOW w AS (PARTITION BY key ORDER BY seq)"""
STATE = f"""SELECT key, seq, value, CASE WHEN marked > cut AND (ttl_ms IS NOT NULL OR marked + marked // 2 > now_ms) THEN marked + marked // 2 END AS expires_at_ms FROM ({LAST}) WHERE back = 1 AND NOT deleted"""


@query(STATE)
def kv_string_state(spark, d):
    return _state(spark, d)


@query(f"SELECT * FROM ({L}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1")
def kv_set_if_absent(spark, d):
    return kv.if_absent(_log(spark, d), ["key"])


@query(f"SELECT * FROM ({STATE}) WHERE expires_at_ms IS NULL OR expires_at_ms > {NOW}")
def kv_live(spark, d):
    return kv.live(_state(spark, d), NOW)


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(CASE WHEN s.key IS NULL THEN -2 WHEN s.expires_at_ms IS NULL THEN -1 ELSE s.expires_at_ms - {NOW} END AS BIGINT) AS ttl_ms
  FROM customer LEFT JOIN (SELECT * FROM ({STATE}) WHERE expires_at_ms IS NULL OR expires_at_ms > {NOW}) s ON s.key = CAST(c_custkey AS VARCHAR)""")
def kv_ttl(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return kv.ttl(keys, _state(spark, d), NOW)


@query(f"""SELECT key, seq, value, CASE WHEN CAST(key AS BIGINT) % 3 = 0 AND (expires_at_ms IS NULL OR expires_at_ms > {NOW}) THEN {NOW + 5000} ELSE expires_at_ms END AS expires_at_ms FROM ({STATE})""")
def kv_expire(spark, d):
    keys = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("key"))
    return kv.expire(_state(spark, d), keys, NOW, 5_000)


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(c_custkey AS VARCHAR) IN (SELECT key FROM ({STATE}) WHERE expires_at_ms IS NULL OR expires_at_ms > {NOW}) AS exists FROM customer")
def kv_exists(spark, d):
    return kv.exists(_keys(spark, d), _state(spark, d), NOW)


def _keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))


def _pairs(spark, d):
    """Requests of two keys each."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("req_id"), F.array(k.cast("string"), (k * 2).cast("string")).alias("keys"))


LIVE = f"SELECT * FROM ({STATE}) WHERE expires_at_ms IS NULL OR expires_at_ms > {NOW}"
ASKED = "SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer"


@query(f"""SELECT key, CAST(CASE WHEN s.seq IS NULL THEN -2 WHEN s.expires_at_ms IS NULL THEN -1 ELSE (s.expires_at_ms - {NOW} + 999) // 1000 END AS BIGINT) AS ttl_s FROM ({ASKED}) LEFT JOIN ({LIVE}) s USING (key)""")
def kv_ttl_seconds(spark, d):
    return kv.ttl(_keys(spark, d), _state(spark, d), NOW).select("key", kv.ttl_seconds(F.col("ttl_ms")).alias("ttl_s"))


def _expire_time(name: str, unit: int):
    def run(spark, d):
        return kv.expire_time(_keys(spark, d), _state(spark, d), NOW, unit)

    run.__name__ = name
    query(f"SELECT key, CAST(CASE WHEN s.seq IS NULL THEN -2 WHEN s.expires_at_ms IS NULL THEN -1 ELSE s.expires_at_ms // {unit} END AS BIGINT) AS at FROM ({ASKED}) LEFT JOIN ({LIVE}) s USING (key)")(run)


_expire_time("kv_expire_time", 1000)
_expire_time("kv_pexpire_time", 1)


@query(f"SELECT key, expires_at_ms AS expired_at_ms FROM ({STATE}) WHERE expires_at_ms <= {NOW}")
def kv_expiry_sweep(spark, d):
    return kv.sweep(_state(spark, d), NOW)


@query(f"""SELECT key, CASE WHEN key IN (SELECT key FROM ({LIVE})) THEN 'string' WHEN CAST(key AS BIGINT) IN (SELECT l_orderkey FROM lineitem) THEN 'hash' WHEN CAST(key AS BIGINT) IN (SELECT ps.l_suppkey FROM lineitem ps) THEN 'set' ELSE 'none' END AS type
  FROM ({ASKED})""")
def key_types(spark, d):
    lines = table(spark, d, "lineitem")
    models = {"string": kv.live(_state(spark, d), NOW), "hash": lines.select(F.col("l_orderkey").cast("string").alias("key")), "set": lines.select(F.col("l_suppkey").cast("string").alias("key"))}
    return kv.key_type(_keys(spark, d), models)


@query(f"SELECT req_id, count(s.key) AS n FROM (SELECT c_custkey AS req_id, unnest([CAST(c_custkey AS VARCHAR), CAST(c_custkey * 2 AS VARCHAR)]) AS k FROM customer) LEFT JOIN ({LIVE}) s ON s.key = k GROUP BY 1")
def key_touch(spark, d):
    return kv.touch(_pairs(spark, d), kv.live(_state(spark, d), NOW))


@query(f"SELECT key, value FROM ({ASKED}) LEFT JOIN ({LIVE}) USING (key)")
def kv_get_del(spark, d):
    return kv.get_del(_keys(spark, d), kv.live(_state(spark, d), NOW))[0]


@query(f"SELECT * FROM ({LIVE}) WHERE CAST(key AS BIGINT) % 2 = 1")
def kv_get_del_left(spark, d):
    return kv.get_del(_keys(spark, d).filter("key % 2 = 0"), kv.live(_state(spark, d), NOW))[1]


@query(f"SELECT key, seq, value, CASE WHEN CAST(key AS BIGINT) % 3 = 0 AND (expires_at_ms IS NULL OR expires_at_ms > {NOW}) THEN {NOW + 700} ELSE expires_at_ms END AS expires_at_ms FROM ({STATE})")
def kv_get_ex(spark, d):
    return kv.get_ex(_keys(spark, d).filter("key % 3 = 0"), _state(spark, d), NOW, 700)[1]


@query(f"""WITH r AS (SELECT c_custkey AS req_id, unnest([CAST(c_custkey AS VARCHAR), CAST(c_custkey * 2 AS VARCHAR)]) AS key FROM customer), s AS ({LIVE})
  SELECT req_id, key, 'v' AS value, NOT bool_or(key IN (SELECT key FROM s)) OVER (PARTITION BY req_id) AS applied FROM r""")
def kv_set_many_if_absent(spark, d):
    asked = _pairs(spark, d).select("req_id", F.explode("keys").alias("key"), F.lit("v").alias("value"))
    return kv.set_many_if_absent(asked, kv.live(_state(spark, d), NOW))


@query(f"SELECT min(key) AS key FROM ({LIVE})")
def key_random(spark, d):
    return kv.random_key(kv.live(_state(spark, d), NOW))


@query(f"SELECT * FROM ({STATE}) WHERE false")
def key_flush(spark, d):
    return kv.flush(_state(spark, d))


@query("SELECT c_name AS message FROM customer")
def key_echo(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("message"))


@query(f"SELECT key, string_agg(value, '' ORDER BY seq) AS value FROM ({L}) GROUP BY 1")
def kv_append(spark, d):
    return kv.appended(_log(spark, d))


#: A number per write whose absolute sums leave 64 bits for some customers.
HUGE = "CAST((o_orderkey % 7 - 3) * CAST(3000000000000000000 AS HUGEINT) AS BIGINT)"


def _increment_query(name: str, rule: str, step: str):
    def run(spark, d):
        k = F.col("o_orderkey")
        log = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), k.alias("seq"), ((k % 7 - 3) * F.lit(3_000_000_000_000_000_000)).cast("bigint").alias("increment"))
        return kv.incremented(log, ["key"], overflow=rule)

    run.__name__ = name
    query(f"""WITH RECURSIVE l AS (SELECT CAST(o_custkey AS VARCHAR) AS key, {HUGE} AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS k FROM orders),
      f AS (SELECT key, n, k, CAST(a AS HUGEINT) AS v FROM l WHERE n = 1 UNION ALL SELECT l.key, l.n, l.k, {step} FROM f JOIN l ON l.key = f.key AND l.n = f.n + 1)
      SELECT key, CAST(v AS VARCHAR) AS value FROM f WHERE n = k""")(run)


_increment_query("kv_incr_by", "refuse", "CASE WHEN f.v + l.a BETWEEN -9223372036854775808 AND 9223372036854775807 THEN f.v + l.a ELSE f.v END")
_increment_query("hash_incr_saturating", "saturate", "greatest(least(f.v + l.a, 9223372036854775807), -9223372036854775808)")


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS value FROM orders GROUP BY 1")
def kv_incr_by_float(spark, d):
    log = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").cast("double").alias("increment"))
    return kv.incremented_float(log, ["key"]).withColumn("value", F.round("value", 2))


def _commands(spark, d):
    """Orders as string commands on a key per customer, the verb by the order's number."""
    verbs = sorted(kv.VERBS)
    k = F.col("o_orderkey")
    verb = F.element_at(F.array(*map(F.lit, verbs)), (F.pmod(F.xxhash64(k), F.lit(len(verbs))) + 1).cast("int"))
    return table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("key"), k.alias("seq"), k.alias("now_ms"), verb.alias("verb"), F.when(k % 3 == 0, k.cast("string")).otherwise(F.col("o_orderpriority")).alias("value"),
        F.when(k % 4 > 0, k % 50).alias("number"), F.when(k % 5 > 0, k % 9 - 4).alias("stop"))


@query()
def kv_replay(spark, d):
    """Every string verb with its reply, in order per key; held against a plain store in the tests."""
    return kv.replay(_commands(spark, d)).select("key", "seq", "verb", "reply")


@query(f"""SELECT o.o_custkey AS req_id, string_agg(coalesce(s.value, '?'), ',' ORDER BY pos) AS values FROM (
    SELECT c_custkey AS o_custkey, unnest([CAST(c_custkey AS VARCHAR), CAST(c_custkey + 1 AS VARCHAR), 'none']) AS k, unnest([0, 1, 2]) AS pos FROM customer) o LEFT JOIN ({STATE}) s ON s.key = o.k GROUP BY 1""")
def kv_multi_get(spark, d):
    k = F.col("c_custkey")
    asked = table(spark, d, "customer").select(k.alias("req_id"), F.array(k.cast("string"), (k + 1).cast("string"), F.lit("none")).alias("keys"))
    return kv.multi_get(asked, _state(spark, d)).select("req_id", F.array_join("values", ",", "?").alias("values"))


@query(f"SELECT *, lag(value) OVER (PARTITION BY key ORDER BY seq) AS old FROM ({L})")
def kv_get_set(spark, d):
    return kv.get_set(_log(spark, d))


@query(f"""WITH RECURSIVE l AS (SELECT key, seq, value, CASE WHEN deleted THEN 'delete' WHEN seq % 3 = 0 THEN 'absent' WHEN seq % 3 = 1 THEN 'exists' ELSE 'always' END AS condition,
    row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM ({L})),
  f AS (SELECT key, seq, value, condition, n, condition IN ('always', 'delete', 'absent') AS applied, CAST(NULL AS VARCHAR) AS old,
      CASE WHEN condition IN ('always', 'absent') THEN value END AS now FROM l WHERE n = 1
    UNION ALL SELECT l.key, l.seq, l.value, l.condition, l.n, l.condition IN ('always', 'delete') OR (l.condition = 'exists') = (f.now IS NOT NULL), f.now,
      CASE WHEN l.condition = 'delete' THEN NULL WHEN l.condition = 'always' OR (l.condition = 'exists') = (f.now IS NOT NULL) THEN l.value ELSE f.now END
    FROM f JOIN l ON l.key = f.key AND l.n = f.n + 1)
  SELECT key, seq, value, condition, applied, old FROM f""")
def kv_conditional_set(spark, d):
    c = F.when(F.col("deleted"), "delete").when(F.col("seq") % 3 == 0, "absent").when(F.col("seq") % 3 == 1, "exists").otherwise("always")
    return kv.conditional(_log(spark, d).select("key", "seq", "value", c.alias("condition")))


def _fields(spark, d):
    """Line items as hash fields: key = order, field = line number."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("key"), F.col("l_linenumber").cast("string").alias("field"), F.col("l_returnflag").alias("value"),
        F.col("l_partkey").alias("seq"), F.col("l_quantity").cast("bigint").alias("increment"))


FLD = "SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(l_linenumber AS VARCHAR) AS field, l_returnflag AS value, l_partkey AS seq, CAST(l_quantity AS BIGINT) AS increment FROM lineitem"


@query(f"SELECT key, count(DISTINCT field) AS n FROM ({FLD}) GROUP BY 1")
def hash_len(spark, d):
    return kv.latest(_fields(spark, d).groupBy("key", "field").agg(F.max("seq").alias("seq")), ["key", "field"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT key, field, CAST(CAST(sum(increment) AS BIGINT) AS VARCHAR) AS value FROM ({FLD}) GROUP BY 1, 2")
def hash_incr_by(spark, d):
    return kv.incremented(_fields(spark, d), ["key", "field"])


@query(f"SELECT key, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields FROM ({FLD}) GROUP BY 1")
def hash_keys(spark, d):
    one = _fields(spark, d).groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))
    return kv.hash_map(one).select("key", F.array_join(F.map_keys("fields"), ",").alias("fields"))


def _last_fields(spark, d):
    return kv.latest(_fields(spark, d).groupBy("key", "field").agg(F.max_by("value", F.struct("seq", "value")).alias("value"), F.max("seq").alias("seq")), ["key", "field"])


ONE = f"SELECT key, field, value FROM ({FLD}) QUALIFY row_number() OVER (PARTITION BY key, field ORDER BY seq DESC, value DESC) = 1"


@query(f"SELECT r.key, r.field, f.field IS NOT NULL AS exists, CAST(coalesce(strlen(f.value), 0) AS INT) AS length FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key, '3' AS field FROM orders) r LEFT JOIN ({ONE}) f ON f.key = r.key AND f.field = r.field")
def hash_field_exists(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.lit("3").alias("field"))
    return kv.field_exists(asked, _last_fields(spark, d))


@query(f"SELECT key, string_agg(value, ',' ORDER BY field) AS vals FROM ({ONE}) GROUP BY 1")
def hash_values(spark, d):
    return kv.hash_map(_last_fields(spark, d)).select("key", F.array_join(F.map_values("fields"), ",").alias("vals"))


@query(f"SELECT key, page, string_agg(field, ',' ORDER BY field) AS fields FROM (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY field) - 1) // 2 AS page FROM ({ONE})) GROUP BY 1, 2")
def hash_get_pages(spark, d):
    return kv.hash_pages(_last_fields(spark, d), 2).select("key", "page", F.array_join(F.map_keys("fields"), ",").alias("fields"))


@query(f"SELECT o_orderkey AS req_id, string_agg(coalesce(f.value, '?'), ',' ORDER BY pos) AS vals FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, unnest(['2', '9', '1']) AS fld, unnest([0, 1, 2]) AS pos FROM orders) LEFT JOIN ({ONE}) f ON f.key = k AND f.field = fld GROUP BY 1")
def hash_multi_get(spark, d):
    k = F.col("o_orderkey")
    asked = table(spark, d, "orders").select(k.alias("req_id"), k.cast("string").alias("key"), F.array(*map(F.lit, ["2", "9", "1"])).alias("fields"))
    return kv.multi_get(asked, _last_fields(spark, d), "field").select("req_id", F.array_join("values", ",", "?").alias("vals"))


@query(f"SELECT key, field, value, position FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) - 1 AS position FROM ({ONE}) WHERE field <> '2') WHERE position BETWEEN 1 AND 2")
def hash_scan(spark, d):
    return kv.scan_within(_last_fields(spark, d).select("key", "field", "value"), "field", "[!2]", 1, 2)


@query(f"SELECT key, field, value FROM ({ONE}) WHERE NOT (field = '1' AND CAST(key AS BIGINT) % 2 = 0)")
def hash_delete(spark, d):
    gone = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("key"), F.lit("1").alias("field"))
    return kv.removed(_last_fields(spark, d).select("key", "field", "value"), gone, ["key", "field"])[0]


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS key, count(f.field) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) LEFT JOIN ({ONE}) f ON f.key = CAST(o_orderkey AS VARCHAR) AND f.field = '1' GROUP BY 1")
def hash_delete_count(spark, d):
    gone = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("key"), F.lit("1").alias("field"))
    return kv.removed(_last_fields(spark, d).select("key", "field", "value"), gone, ["key", "field"])[1]


@query("SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(l_linenumber AS VARCHAR) AS field, round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS value FROM lineitem GROUP BY 1, 2")
def hash_incr_by_float(spark, d):
    log = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), F.col("l_linenumber").cast("string").alias("field"), F.col("l_partkey").alias("seq"), F.col("l_extendedprice").cast("double").alias("increment"))
    return kv.incremented_float(log, ["key", "field"]).withColumn("value", F.round("value", 2))


def _sets(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("member")).distinct()


SETS = "SELECT DISTINCT l_returnflag AS key, l_partkey AS member FROM lineitem"


@query(f"SELECT key, count(*) AS n FROM ({SETS}) GROUP BY 1")
def set_card(spark, d):
    return _sets(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS key, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS members FROM lineitem GROUP BY 1")
def set_members(spark, d):
    """The members of every order's set of parts, whole; sets of any size come in pages (``set_member_pages``)."""
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), F.col("l_partkey").alias("member"))
    return kv.members(s).select("key", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"""SELECT key, page, array_to_string(list_sort(list(member)), ',') AS members FROM (
    SELECT key, member, (row_number() OVER (PARTITION BY key ORDER BY member) - 1) // 1000 AS page FROM ({SETS})) GROUP BY 1, 2""")
def set_member_pages(spark, d):
    return kv.member_pages(_sets(spark, d)).select("key", "page", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"SELECT f.l_returnflag AS key, p.p_partkey AS member, p.p_partkey IN (SELECT member FROM ({SETS}) s WHERE s.key = f.l_returnflag) AS is_member FROM part p JOIN (SELECT DISTINCT l_returnflag FROM lineitem) f ON true")
def set_is_member(spark, d):
    asked = table(spark, d, "part").select(F.explode(F.array(*map(F.lit, ["A", "N", "R"]))).alias("key"), F.col("p_partkey").alias("member"))
    return kv.is_member(asked, _sets(spark, d))


@query(f"SELECT key, member FROM ({SETS}) WHERE member % 3 > 0")
def set_remove(spark, d):
    gone = table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.explode(F.array(*map(F.lit, ["A", "N", "R"]))).alias("key"), F.col("p_partkey").alias("member"))
    return kv.removed(_sets(spark, d), gone, ["key", "member"])[0]


@query(f"SELECT key, place, member FROM (SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY member) AS place FROM ({SETS})) WHERE place <= 6")
def set_some_members(spark, d):
    return kv.some_members(_sets(spark, d), 6)


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS key, l_suppkey AS member FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS n, count(*) OVER (PARTITION BY key) AS k FROM s)
  SELECT CAST(key AS VARCHAR) AS key, place, member FROM r, unnest(range(1, 6)) AS p(place) WHERE (place - 1) % k + 1 = n""")
def set_some_members_again(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), F.col("l_suppkey").alias("member"))
    return kv.some_members(s, -5)


@query(f"SELECT key, member, position FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS position FROM ({SETS}) WHERE CAST(member AS VARCHAR) LIKE '1%') WHERE position BETWEEN 3 AND 9")
def set_scan(spark, d):
    return kv.scan_within(_sets(spark, d), "member", "1*", 3, 7)


def _set_query(name: str, sql: str):
    def run(spark, d):
        s = _sets(spark, d)
        return kv.set_algebra([s.filter(F.col("key") == k).select("member") for k in ("A", "N", "R")], name)

    run.__name__ = f"set_{name}"
    query(sql)(run)


for _name, _op in (("union", "UNION"), ("inter", "INTERSECT"), ("diff", "EXCEPT")):
    _set_query(_name, f" {_op} ".join(f"SELECT member FROM ({SETS}) WHERE key = '{k}'" for k in ("A", "N", "R")))


@query(f"SELECT key, member FROM ({SETS}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY member) <= 5")
def set_pop_taken(spark, d):
    return kv.pop(_sets(spark, d), 5)[0]


@query(f"SELECT DISTINCT CASE WHEN key = 'A' AND member = (SELECT min(member) FROM ({SETS}) WHERE key = 'A') THEN 'N' ELSE key END AS key, member FROM ({SETS})")
def set_move(spark, d):
    s = _sets(spark, d)
    least = s.filter("key = 'A'").agg(F.min("member")).first()[0]
    return kv.move(s, "A", "N", least)


@query("SELECT key, row_number() OVER (ORDER BY key) + 9 AS position FROM (SELECT DISTINCT c_name AS key FROM customer WHERE c_name LIKE '%1_' ORDER BY key OFFSET 10 LIMIT 7)")
def key_scan(spark, d):
    return kv.scan(table(spark, d, "customer").select(F.col("c_name").alias("key")), "*1?", 10, 7)


def _name_query(name: str, sql: str, change):
    def run(spark, d):
        return change(_state(spark, d))

    run.__name__ = name
    query(sql)(run)


A, B = "(SELECT min(key) FROM ({0}))".format(STATE), "(SELECT max(key) FROM ({0}))".format(STATE)


def _ends(state):
    return state.agg(F.min("key"), F.max("key")).first()


MOVED = f"SELECT * REPLACE (CASE WHEN key = {A} THEN 'one' ELSE key END AS key) FROM ({STATE})"
_name_query("key_rename", MOVED, lambda s: kv.rename(s, _ends(s)[0], "one"))
_name_query("key_rename_over", f"SELECT * REPLACE (CASE WHEN key = {A} THEN {B} ELSE key END AS key) FROM ({STATE}) WHERE key <> {B}", lambda s: kv.rename(s, *_ends(s)))
_name_query("key_rename_missing", STATE, lambda s: kv.rename(s, "none such", _ends(s)[0]))
_name_query("key_rename_if_absent", MOVED, lambda s: kv.rename(s, _ends(s)[0], "one", replace=False))
_name_query("key_rename_if_absent_refused", STATE, lambda s: kv.rename(s, *_ends(s), replace=False))
_name_query("key_copy", f"SELECT * FROM ({STATE}) UNION ALL SELECT * REPLACE ('copy' AS key) FROM ({STATE}) WHERE key = {A}", lambda s: kv.copy(s, _ends(s)[0], "copy"))
_name_query("key_copy_refused", STATE, lambda s: kv.copy(s, *_ends(s)))
_name_query("key_copy_replace", f"SELECT * FROM ({STATE}) WHERE key <> {B} UNION ALL SELECT * REPLACE ({B} AS key) FROM ({STATE}) WHERE key = {A}", lambda s: kv.copy(s, *_ends(s), replace=True))


@query("""SELECT doc_id, strlen(text) AS bytes, substr(h, 9, 22) AS part, right(h, 12) AS ending, concat(left(h, 20), '78C3BC7A', substr(h, 29)) AS patched FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents)""")
def string_ranges(spark, d):
    """Ranges of a text's bytes, in hexadecimal."""
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.octet_length(t).alias("bytes"), F.hex(text.byte_range(t, 4, 14)).alias("part"), F.hex(text.byte_range(t, -6, -1)).alias("ending"), F.hex(text.overwrite_at(t, 10, "xüz")).alias("patched"))


def _unsigned(h: str) -> str:
    """A 64-bit pattern as a signed number."""
    return f"CAST(CASE WHEN {h} >= 9223372036854775808 THEN CAST({h} AS HUGEINT) - 18446744073709551616 ELSE CAST({h} AS HUGEINT) END AS BIGINT)"


def _crc_sql(poly: int, start: int) -> str:
    """A reflected CRC bit by bit over the letters of ``key``."""
    bits = f"list_reduce([CAST(0 AS UBIGINT), 1, 2, 3, 4, 5, 6, 7], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST({poly} AS UBIGINT)) ELSE a >> 1 END, xor(h, b))"
    return f"list_reduce(bytes, lambda h, b: {bits}, CAST({start} AS UBIGINT))"


_JONES = int(f"{hashing.CRC64_JONES_POLY:064b}"[::-1], 2)


@query(f"""WITH k AS (SELECT c_name AS key, list_transform(range(1, length(c_name) + 1), lambda i: CAST(ord(c_name[i]) AS UBIGINT)) AS bytes FROM customer),
  h AS (SELECT key, list_reduce(bytes, lambda h, b: CAST(CAST(xor(h, b) AS UHUGEINT) * {hashing.FNV_PRIME} % 18446744073709551616 AS UBIGINT), CAST({hashing.FNV_OFFSET} AS UBIGINT)) AS f,
    {_crc_sql(_JONES, 0)} AS c, xor({_crc_sql(hashing.CRC32C_POLY, 0xFFFFFFFF)}, CAST(4294967295 AS UBIGINT)) AS x FROM k)
  SELECT key, {_unsigned('f')} AS fnv1a, {_unsigned('c')} AS crc64, CAST(x AS BIGINT) AS crc32c, CAST(c >> 34 AS BIGINT) AS slot FROM h""")
def hash_functions(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("key"))
    return c.select("key", hashing.fnv1a("key").alias("fnv1a"), hashing.crc64("key").alias("crc64"), hashing.crc32_castagnoli("key").alias("crc32c"), F.shiftrightunsigned(hashing.crc64("key"), 34).alias("slot"))


@query("SELECT count(DISTINCT key) AS n FROM (SELECT CAST(o_custkey AS VARCHAR) AS key FROM orders UNION ALL SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem)")
def key_count(spark, d):
    return _log(spark, d).select("key").unionByName(_fields(spark, d).select("key")).agg(F.count_distinct("key").alias("n"))


