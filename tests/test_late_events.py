import random
import statistics as st

from pyspark.sql import functions as F

from tidemark.operators import late_events as le

SCHEMA = "tenant bigint, ts_ms bigint, hook_observed_at_ms bigint, created_at_ms bigint, ingestion_time_ms bigint, importance float, hour_ms string"
H = 1_700_000_000_000 // 3_600_000 * 3_600_000


def test_units_fallbacks_and_cut_off(spark):
    rows = [
        (1, H + 5, None, None, H + 3_600_000 + le.LATENESS_MS, 1.0, "x"), (1, H + 5, None, None, H + 3_600_001 + le.LATENESS_MS, 1.0, "x"),
        (1, H // 1000, None, None, None, None, "x"), (1, (H + 7) * 1000, None, None, 0, None, "x"), (1, 0, H + 9, 5, None, None, "x"), (1, None, 0, H + 11, H * 2, None, "x"),
        (1, None, None, None, H * 2, None, "x"), (None, (H + 3) * 1_000_000, None, None, None, None, "x"),
    ]
    out = [(r["happened_ms"], r["hour_ms"], r["set_aside"]) for r in le.with_period(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()]
    assert out == [(H + 5, H, False), (H + 5, H, True), (H, H, False), (H + 7, H, False), (H + 9, H, False), (H + 11, H, True), (None, None, False), (H + 3, H, False)]


def test_statistics_are_exact_and_independent_of_batches(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2]), H + rnd.randrange(4) * 3_600_000, None, None, None, rnd.choice([None, float("nan"), -2.5, 0.0, rnd.random(), float(rnd.randrange(5))]), None) for _ in range(800)]
    df = le.with_period(spark.createDataFrame(rows, SCHEMA))
    state = le.multiset(df.filter("ts_ms % 7 < 3").limit(0))
    for k in (2, 0, 1):
        state = le.apply_batch(state, df.filter(F.col("ts_ms") / 3_600_000 % 3 == k))
    got = {(r["tenant"], r["hour_ms"]): r for r in le.statistics(state).collect()}
    want = {}
    for t, ms, *_, v, _ in rows:
        want.setdefault((t, ms), []).append(v)
    assert set(got) == set(want)
    import numpy as np

    for k, all_ in want.items():
        v = [float(np.float32(x)) for x in all_ if x is not None and x == x]
        r = got[k]
        assert r["n_events"] == len(all_) and r["n_distinct"] == len(set(v))
        assert abs(r["mean_value"] - sum(v) / len(v)) < 1e-9 and r["median_value"] == st.median_low(v) and (r["min_value"], r["max_value"]) == (min(v), max(v))


def test_taking_a_batch_back_leaves_nothing(spark):
    df = le.with_period(spark.createDataFrame([(1, H, None, None, None, 0.5, None)] * 3, SCHEMA))
    assert le.apply_batch(le.multiset(df), df, sign=-1).count() == 0
    assert le.statistics(le.multiset(df.limit(0))).count() == 0
