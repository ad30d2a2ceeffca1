import random

from pyspark.sql import functions as F

from tidemark.functions import tables
from tidemark.operators import content, joins, memory_log, ordered


def test_joins_against_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    points = [(rnd.choice(["hot", "hot", "b", None]), i, rnd.choice([None, *range(-40, 200)])) for i in range(400)]
    ranges = [(rnd.choice(["hot", "hot", "b", None]), i, s := rnd.choice([None, *range(-50, 200)]), None if s is None else s + rnd.choice([-3, 0, 5, 60])) for i in range(120)]
    p, r = spark.createDataFrame(points, "k string, p int, at int"), spark.createDataFrame(ranges, "k string, r int, s int, e int")
    want = {(a[1], b[1]) for a in points for b in ranges if a[0] and a[0] == b[0] and None not in (a[2], b[2]) and b[2] <= a[2] <= b[3]}
    got = [(x["p"], x["r"]) for x in joins.range_join(p, r, ["k"], "at", "s", "e", 20).collect()]
    assert len(got) == len(want) and set(got) == want
    other = r.select("k", F.col("r").alias("r2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    want = {(a[1], b[1]) for a in ranges for b in ranges if a[0] and a[0] == b[0] and None not in (a[2], b[2]) and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]}
    got = [(x["r"], x["r2"]) for x in joins.overlap_join(r, other, ["k"], "s", "e", "s2", "e2", 20).collect()]
    assert len(got) == len(want) and set(got) == want
    facts = r.select("k", F.col("s").alias("told"), F.col("r").alias("fact"))

    def latest(k, at):
        seen = [(s, i) for kk, i, s, _ in ranges if kk == k and s is not None and at is not None and s <= at]
        return max(seen)[1] if seen else None

    for hot in (10**6, 40):
        monkeypatch.setattr(ordered, "HOT_ROWS", hot)
        got = {x["p"]: x["fact"] for x in joins.as_of_join(p, facts, ["k"], "at", "told", ["fact"]).collect()}
        assert got == {i: latest(k, at) for k, i, at in points}


def test_chunks_in_sql_are_those_of_the_operator(spark):
    df = spark.createDataFrame([(1, "# A\n" + "word. " * 700 + "\n## B\nx"), (2, None), (3, "")], "doc_id bigint, text string")
    tables.register(spark)
    df.createOrReplaceTempView("chunked")
    got = spark.sql("select doc_id, c.* from chunked, lateral text_chunks(text) c").collect()
    want = content.chunks(df).select("doc_id", "chunk", "path", "level", "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_flushes_fall_due(spark):
    df = spark.createDataFrame([("a", 10), ("a", 20), ("b", 95), ("c", 1), ("c", 99), (None, 1), ("d", None)], "scope string, ts_ms bigint")
    assert sorted((r["scope"], r["marks"], r["reason"]) for r in memory_log.due_flushes(df, 100, 20, 90).collect()) == [("a", 2, "quiet"), ("c", 2, "waited")]
