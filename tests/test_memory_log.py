import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import content, memory_log, pipeline

RECORD = "seq int, record_id string, tenant int, user_id string, sources array<string>"
STONE = "seq int, kind string, target_id string, tenant int, user_id string"


def test_tombstones_against_a_plain_sweep(spark):
    rnd = random.Random(3)
    records = [(i * 2, f"r{rnd.randrange(60)}", rnd.choice([1, 2, None]), rnd.choice(["u", "v", None]), rnd.choice([None, [], [f"r{rnd.randrange(60)}"], ["r1", "r2"]])) for i in range(300)]
    stones = [(rnd.randrange(600), rnd.choice(["delete", "delete", "forget", "reset"]), rnd.choice([f"r{rnd.randrange(60)}", "", None]), rnd.choice([1, 2, None]), rnd.choice(["u", "v", None])) for _ in range(25)]
    stones = [s if s[1] != "reset" or s[0] < 60 else (s[0] % 60, *s[1:]) for s in stones]

    def dead(r, closure):
        for at, kind, target, tenant, user in stones:
            if at < r[0]:
                continue
            if kind == "delete" and target and (target == r[1] or closure and r[4] == [target]):
                return True
            if kind == "forget" and None not in (tenant, user) and (tenant, user) == (r[2], r[3]) or kind == "reset" and tenant is not None and tenant == r[2]:
                return True
        return False

    df, gone = spark.createDataFrame(records, RECORD), spark.createDataFrame(stones, STONE)
    for closure in (True, False):
        assert {r["seq"] for r in memory_log.surviving(df, gone, closure).collect()} == {r[0] for r in records if not dead(r, closure)}
    assert memory_log.surviving(df, gone.limit(0)).count() == 300
    left, removed = memory_log.forget(df, {"tenant": 1, "user_id": "u"})
    assert left.count() + removed.first()[0] == 300 and left.filter("tenant = 1 and user_id = 'u'").count() == 0
    with pytest.raises(ValueError):
        memory_log.forget(df, {"tenant": 1})


def test_token_chunks_cover_the_text(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["word", "a", "end.", "x;", "--", "ünï"]) for _ in range(n)) for n in (0, 5, 240, 700)] + [None, "  \n "]
    got = {}
    for r in content.token_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), size=60, overlap=7).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {1, 2, 3}
    for i, parts in got.items():
        n = len(re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]+", texts[i]))
        seen = set()
        for a, b in zip(parts, [*parts[1:], None]):
            seen |= set(range(a["first_token"], a["first_token"] + a["n_tokens"]))
            assert a["n_tokens"] <= 60 and (b is None or b["first_token"] == a["first_token"] + a["n_tokens"] - 7) and a["content"] in texts[i]
        assert seen == set(range(n))


def test_small_talk_and_topics(spark):
    rows = [("hi!", 0.0), (None, 0.0), ("I prefer the budget plan because 2024 must not repeat itself", 0.2 + 0.45 + 0.2 + 0.1 + 0.15), ("lovely words only", 0.2)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", content.saliency(F.col("t")).alias("s"), content.topic(F.col("t")).alias("k")).orderBy("i").collect()
    assert [r["s"] for r in got] == pytest.approx([min(s, 1.0) for _, s in rows]) and [r["k"] for r in got] == ["general", "general", "preference", "lovely"]


def test_lanes_and_tree(spark):
    rows = [(1, 7, "the runbook", ["a"], ["x"], "note"), (2, 7, None, ["runbook"], [], "note"), (3, 7, "none", ["b"], [], "note"), (0, 7, "runbook", ["c"], [], "note")]
    df = spark.createDataFrame(rows, "seq int, node_hash int, text string, path array<string>, terms array<string>, kind string")
    got = sorted((r["seq"], r["recall_path"], r["origin_score"]) for r in pipeline.scan_lanes(df, "runbook", per_node=3).collect())
    assert got == [(1, "auxiliary_keyword_graph", 1.0), (1, "primary_hybrid", 0.35), (2, "auxiliary_keyword_graph", 1.0)]
