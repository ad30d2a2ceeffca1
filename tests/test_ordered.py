import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import counters, decisions, memory, ordered, retrieval


def rows(seed, n=2500):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot"] * 5 + ["a", "b", None]), rnd.randrange(300), i, rnd.choice([None, *range(-5, 9)])) for i in range(n)]


@pytest.mark.parametrize("hot", [10**6, 50])
def test_running_values_and_predecessors(spark, monkeypatch, hot):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    data = rows(1)
    df = spark.createDataFrame(data, "k string, t int, seq int, v int").repartition(5)
    want = {}
    state = {}
    for k, t, s, v in sorted(data, key=lambda r: (r[1], r[2])):
        total, most, n, before = state.get(k, (None, None, 0, None))
        was = most
        total = total if v is None else (total or 0) + v
        most = most if v is None else v if most is None else max(most, v)
        want[s] = (total, was, n + (v is not None), before)
        state[k] = (total, most, n + (v is not None), v)
    out = ordered.running(df, ["k"], ["t", "seq"], F.col("v"), "sum")
    out = ordered.running(out, ["k"], ["t", "seq"], F.col("v"), "top", "max", inclusive=False)
    out = ordered.lagged(ordered.running(out, ["k"], ["t", "seq"], F.col("v"), "n", "count"), ["k"], ["t", "seq"], F.col("v"), "before")
    assert {r["seq"]: (r["sum"], r["top"], r["n"], r["before"]) for r in out.collect()} == want
    assert ordered.running(df.limit(0), ["k"], ["t"], F.col("v"), "x").count() == 0


def _increments(d):
    return d.select(F.lit("h").alias("family"), F.col("k").alias("key"), "ts_ms", F.coalesce("v", F.lit(0)).cast("bigint").alias("amount"), "seq", F.col("v").cast("string").alias("uuid"))


def test_verbs_agree_on_hot_keys(spark, monkeypatch):
    df = spark.createDataFrame([(k or "none", t * 1000, s, v) for k, t, s, v in rows(2)], "k string, ts_ms bigint, seq int, v int").repartition(5)
    verbs = [
        lambda d: decisions.running_cap(d, ["k"], 40), lambda d: decisions.accepted_cap(d, ["k"], 30), lambda d: decisions.debounced(d, ["k"], 500), lambda d: decisions.once(d, ["k"], "v", "ts_ms", "seq"),
        lambda d: decisions.trailing_count(d, ["k"], 7_000), lambda d: decisions.trailing_distinct(d, ["k"], "v", 7_000), lambda d: counters.set_and_get(_increments(d), 9_000, 3_000, "uuid"),
        lambda d: decisions.counted_impressions(d, ["k"], "v", 3), lambda d: retrieval.keyed_truth(d, "k", "v", "seq"), lambda d: memory.lifecycle(d.withColumn("c", F.col("v").cast("string")).withColumn("gone", F.col("v") == 1), "k", "c", "seq", "gone"),
    ]
    plain = [sorted(map(str, f(df).collect())) for f in verbs]
    monkeypatch.setattr(ordered, "HOT_ROWS", 50)
    for f, want in zip(verbs, plain):
        assert sorted(map(str, f(df).collect())) == want
