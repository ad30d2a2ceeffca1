import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import counters, decisions, sequences, series

POINT = "key string, ts_ms bigint, value string, seq bigint"


def test_aggregates_skip_what_is_no_number_but_count_it(spark):
    df = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, " +3", 2), ("a", 3, "-10", 3), ("a", 4, "1.5", 4), ("b", 9, None, 5)], POINT)
    got = {r["key"]: r.asDict() for r in series.aggregates(df, 0, 10).collect()}
    assert got["a"] == {"key": "a", "sum": -7, "avg": -3, "min": -10, "max": 3, "first": 0, "last": 0, "count": 4}
    assert got["b"]["count"] == 1 and got["b"]["sum"] == 0
    assert series.aggregates(df, 10, 0).count() == 0
    assert {r["key"]: r["value"] for r in series.for_keys(series.aggregate(df, 0, 10, "nonsense"), spark.createDataFrame([("a",), ("z",)], "key string")).collect()} == {"a": 4, "z": 0}


def test_write_policies(spark):
    old = spark.createDataFrame([("a", 1, "1", 1), ("a", 2, "2", 2)], POINT)
    new = spark.createDataFrame([("a", 2, "20", 3), ("a", 2, "21", 4), ("a", 3, "30", 5)], POINT)
    read = lambda d: sorted((r["ts_ms"], r["value"]) for r in d.collect())
    assert read(series.append(old, new)) == [(1, "1"), (2, "21"), (3, "30")]
    assert read(series.append(old, new, "first")) == [(1, "1"), (2, "2"), (3, "30")]
    assert read(series.append(old, new, "update")) == [(1, "1"), (2, "21")]
    assert read(series.append(old, new, max_points=2)) == [(2, "21"), (3, "30")]
    with pytest.raises(ValueError):
        series.append(old, new, "block")


def test_replace_then_delete(spark):
    old = spark.createDataFrame([("a", 10, "2", 1), ("a", 20, "3", 2), ("a", 30, "4", 3)], POINT)
    out = series.replace(old, 0, 20, spark.createDataFrame([("a", 15, "10", 4)], POINT))
    assert series.aggregates(out, 0, 40).first()["sum"] == 14
    assert series.delete(out, out).count() == 0


def test_scan_limit_comes_before_the_filter(spark):
    rnd = random.Random(1)
    rows = [("k", i, 10_000 + i, i % 7, 50 + (37 * i) % 1000, 500 + (17 * i) % 97) for i in range(500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, ts_ms bigint, gid bigint, action_type bigint, duration bigint, author_id bigint")
    for seed in range(3):
        rnd = random.Random(seed)
        a, n = rnd.randrange(300), rnd.randrange(1, 150)
        got = sequences.query(df, a, a + 200, n, sequences.parse_filters([f"action_type = {seed}", "duration >= 300", "author_id != 501"]))
        want = [r for r in sorted(rows, key=lambda r: r[1]) if a <= r[1] <= a + 200][:n]
        want = [r for r in want if r[3] == seed and r[4] >= 300 and r[5] != 501]
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert sequences.parse_filters(["gid = 1", "duration > 3", "gid != 2"]) == [("gid", "!=", 2), ("duration", ">", 3)]
    assert sequences.query(df, 0, 9, 9, [("nothing", "=", 1)]).count() == 0


def test_ladder_equals_the_raw_sum(spark):
    rnd = random.Random(2)
    inc = spark.createDataFrame([("h", rnd.choice("ab"), rnd.randrange(400_000_000), rnd.randrange(-9, 9), i) for i in range(400)], "family string, key string, ts_ms bigint, amount bigint, seq bigint").cache()
    cells = counters.ladder(inc).cache()
    for _ in range(4):
        a = rnd.randrange(200_000_000)
        b = a + rnd.choice([0, 999, 61_000, 7_200_000, 190_000_000])
        want = {r["key"]: r["s"] for r in inc.filter(F.col("ts_ms").between(a, b)).groupBy("key").agg(F.sum("amount").alias("s")).collect()}
        assert {r["key"]: r["value"] for r in counters.window_sum(cells, inc, a, b).collect()} == want
    assert counters.cover(5, 4) == []


def test_sketch_is_close(spark):
    df = spark.range(20_000).select(F.lit("k").alias("key"), (F.col("id") * 10).alias("ts_ms"), F.col("id").cast("string").alias("value"))
    assert abs(counters.distinct_estimate(counters.distinct_sketches(df, 1000), 0, 10**9).first()["value"] / 20_000 - 1) < 0.05


def test_uuid_repeats_within_five_minutes_add_nothing(spark):
    rows = [("h", "k", 0, 5, 1, "u"), ("h", "k", 1000, 5, 2, "u"), ("h", "k", 400_000, 5, 3, "u"), ("h", "k", 400_001, 2, 4, None)]
    df = spark.createDataFrame(rows, "family string, key string, ts_ms bigint, amount bigint, seq bigint, uuid string")
    assert [r["value"] for r in counters.set_and_get(df, 10**6, None, "uuid").orderBy("seq").collect()] == [5, 5, 10, 12]


def test_folds_match_a_loop(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("xyz"), rnd.randrange(50), i, rnd.choice([None, 1.0, 5.0, 20.0]), rnd.choice([1, 1, -1])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts_ms bigint, seq bigint, amount double, delta int")
    budget = {(r["seq"]): r["allowed"] for r in decisions.budget_gate(df, ["k"], 60, "amount").collect()}
    slot = {(r["seq"]): (r["allowed"], r["level"]) for r in decisions.slots(df, ["k"], 2, "delta").collect()}
    used, held = {}, {}
    for k, _, i, a, d in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        ok = used.get(k, 0) + (a or 0) <= 60
        used[k] = used.get(k, 0) + (a or 0) * ok
        assert budget[i] == ok
        if d < 0:
            held[k] = max(0, held.get(k, 0) - 1)
            assert slot[i] == (True, held[k])
        else:
            ok = held.get(k, 0) < 2
            held[k] = held.get(k, 0) + ok
            assert slot[i] == (ok, held[k])


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "k string, ts_ms bigint, seq bigint, amount double, delta int")
    for out in (decisions.budget_gate(e, ["k"], 1, "amount"), decisions.running_cap(e, ["k"], 1), decisions.trailing_distinct(e, ["k"], "delta", 5), decisions.debounced(e, ["k"], 5)):
        assert out.count() == 0
