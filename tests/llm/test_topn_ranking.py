import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ranking, topn


def test_top_n_matches_brute_force_with_a_hot_group(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(4000):
        g = 7 if rnd.random() < 0.5 else rnd.choice([None, *range(30)])
        rows.append((g, rnd.choice([None, rnd.randrange(900)]), rnd.choice([None, float("nan"), 1.0, 0.5, -0.0, float("inf"), rnd.random()]), rnd.choice([None, 2**62, 5]), "x", 1))
    rows += rows[:300]
    df = spark.createDataFrame(rows, "node bigint, ref bigint, score double, tokens bigint, __nth string, rank int").repartition(9)
    got = {}
    for r in topn.top_n(df, ["node"], "ref", [("score", "descending"), ("tokens", "ascending")], 5).collect():
        got.setdefault(r["node"], {})[r["rank"]] = r["ref"]
    want = {}
    for g, ref, s, t, *_ in rows:
        if s is None or s != s:
            continue
        k = (-s, t is None, t or 0, ref is None, ref or 0)
        want.setdefault(g, {})
        want[g][ref] = min(want[g].get(ref, k), k)
    for g, refs in want.items():
        order = sorted(refs, key=lambda r: refs[r])[:5]
        assert [got[g][i + 1] for i in range(len(order))] == order and len(got[g]) == len(order)
    assert set(got) == set(want)
    assert topn.top_n(df.limit(0), ["node"], "ref", [("score", "descending")], 5).count() == 0


def test_an_ungrouped_huge_tie_is_cut_by_the_whole_key(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("ref"), F.lit(0.5).alias("score"))
    assert [r["ref"] for r in topn.top_n(df.repartition(6), ["g"], "ref", [("score", "descending")], 3).orderBy("rank").collect()] == [0, 1, 2]


def dense_walk(scores, steps=ranking.STEPS, d=ranking.DAMPING):
    n = len(scores[0])
    m = np.zeros((n, n))
    for s in scores:
        v = np.where(np.isnan(s), -np.inf, s)
        for i in range(n):
            up = np.flatnonzero(v > v[i])
            if len(up):
                m[i, up] += 1 / len(up) / len(scores)
            else:
                m[i, i] += 1 / len(scores)
    pi = np.full(n, 1 / n)
    for _ in range(steps):
        pi = d * (pi @ m) + (1 - d) / n
    return pi


def test_walk_matches_a_dense_chain():
    rng = np.random.default_rng(0)
    sizes = [1, 2, 5, 17]
    group = np.repeat(np.arange(4), sizes)
    scores = [np.where(rng.random(25) < 0.2, np.nan, np.round(rng.random(25), 1)) for _ in range(4)]
    pi, sides = ranking.walk(group, scores)
    for g in range(4):
        m = group == g
        assert np.allclose(pi[m], dense_walk([s[m] for s in scores]))
        for s, (higher, tied) in zip(scores, sides):
            v = s[m]
            for k in range(m.sum()):
                up = (v > v[k]) if not math.isnan(v[k]) else ~np.isnan(v)
                assert higher[m][k] == up.sum() and tied[m][k] == (0 if math.isnan(v[k]) else (v == v[k]).sum())


def test_large_groups_take_the_distributed_walk_and_agree(spark):
    rnd = random.Random(2)
    rows = [(1, i, rnd.choice([None, float("nan"), float(rnd.randrange(6))]), rnd.choice([None, rnd.randrange(1000)])) for i in range(60)] + [(2, 5, 1.0, 1), (2, 6, None, None), (None, 3, 1.0, 2), (2, 5, 1.0, 1)]
    df = spark.createDataFrame(rows, "weight int, place bigint, a double, b int")  # clashing names
    small = {(r["weight"], r["place"]): r for r in ranking.rank_walk(df, "weight", "place", ["a", "b"]).collect()}
    assert len(small) == 62
    df = df.toDF("g", "i", "a", "b")
    flat = {(r["g"], r["i"]): r for r in ranking.rank_walk(df, "g", "i", ["a", "b"], steps=2).collect()}
    split = {(r["g"], r["i"]): r for r in ranking.rank_walk(df, "g", "i", ["a", "b"], large=50, steps=2).collect()}
    assert flat.keys() == split.keys()
    for k, r in split.items():
        assert abs(r["weight"] - flat[k]["weight"]) < 1e-9
        assert [r[c] for c in ("place", "a_higher", "b_higher", "a_tied", "b_tied")] == [flat[k][c] for c in ("place", "a_higher", "b_higher", "a_tied", "b_tied")]


def test_many_large_groups_hot_values_and_fine_weights(spark, monkeypatch):
    monkeypatch.setattr(ranking, "HOT", 20)
    monkeypatch.setattr(ranking, "SALTS", 3)
    rnd = random.Random(4)
    rows = [(f"g{g}", i, rnd.choice([None, 1.0, rnd.random()]), rnd.choice([0, 0, rnd.randrange(40)])) for g in range(4) for i in range(10 + 60 * g)]
    df = spark.createDataFrame(rows, "g string, i int, a double, b int")
    flat = {(r["g"], r["i"]): r for r in ranking.rank_walk(df, "g", "i", ["a", "b"], steps=2).collect()}
    split = {(r["g"], r["i"]): r for r in ranking.rank_walk(df, "g", "i", ["a", "b"], large=50, steps=2).collect()}
    assert flat.keys() == split.keys()
    for k, r in split.items():
        assert abs(r["weight"] - flat[k]["weight"]) < 1e-12 and r["place"] == flat[k]["place"] and r["a_higher"] == flat[k]["a_higher"] and r["b_tied"] == flat[k]["b_tied"]


def test_steps_bound_the_error_and_large_groups_keep_their_differences():
    rng = np.random.default_rng(1)
    scores = [rng.random(40) for _ in range(4)]
    pi, _ = ranking.walk(np.zeros(40, int), scores)
    assert np.abs(pi - dense_walk(scores, 2000)).sum() < ranking.ERROR
    n = 300_000
    pi, _ = ranking.walk(np.zeros(n, int), [rng.random(n) for _ in range(4)])
    assert len(np.unique(np.round(pi * n, ranking.DECIMALS))) > 0.999 * len(np.unique(pi))


def test_always_first(spark):
    rows = [(1, 10, 9.0, 9.0, 9.0, 1.0), (1, 11, 1.0, 8.0, 2.0, 5.0), (1, 12, 2.0, None, 1.0, 0.0), (2, 20, 9.0, 9.0, 9.0, 1.0), (2, 21, 9.0, 8.0, 8.0, 2.0), (2, 22, 0.0, 0.0, 0.0, 3.0), (3, 30, None, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "q int, r int, a double, b double, c double, d double")
    out = ranking.always_first(ranking.rank_walk(df, "q", "r", list("abcd")), list("abcd"))
    assert [(r["q"], r["r"]) for r in out.collect()] == [(1, 10)]
    assert ranking.rank_walk(df.limit(0), "q", "r", list("abcd")).count() == 0


def test_always_first_with_a_long_tie_under_one_other_ref(spark):
    rnd = random.Random(3)
    rows = [(1, i, rnd.random(), rnd.random(), rnd.random(), 0.0) for i in range(98)] + [(1, 98, 9.0, 9.0, 9.0, 0.0), (1, 99, 0.5, 0.5, 0.5, 1.0)]
    rows += [(2, r, a, b, c, None if d == 0 else d) for _, r, a, b, c, d in rows]
    ranked = ranking.rank_walk(spark.createDataFrame(rows, "q int, r int, a double, b double, c double, d double"), "q", "r", list("abcd")).cache()
    assert {(r["q"], r["r"]) for r in ranked.filter("place = 1").collect()} == {(1, 99), (2, 99)}
    assert sorted((r["q"], r["r"]) for r in ranking.always_first(ranked, list("abcd")).collect()) == [(1, 98), (2, 98)]
