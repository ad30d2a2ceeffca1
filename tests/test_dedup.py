import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup

PREFER = ["created", "id"]


def prefer():
    return [F.col("created").asc_nulls_last(), F.col("id").asc()]


def brute(rows):
    best = {}
    for r in rows:
        if r[1] is None or not r[2]:
            continue
        k, o = (r[1], r[2]), (r[3] is None, r[3] or 0, r[0])
        if k not in best or o < best[k][0]:
            best[k] = (o, r[0])
    kept = {v[1] for v in best.values()}
    return {r[0] for r in rows if r[1] is None or not r[2] or r[0] in kept}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, producer bigint, number bigint, created bigint, __edge string, __part string, Accepted string")


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force_with_a_hot_message(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(3000):
        hot = rnd.random() < 0.4
        rows.append((i, 1 if hot else rnd.choice([None, 1, 2, 3]), 7 if hot else rnd.choice([None, 0, rnd.randrange(-50, 50), 2**63 - 1, -(2**63)]), rnd.choice([None, rnd.randrange(5)]), "x", None, "z"))
    out = dedup.mark_copies(frame(spark, rows).repartition(7), "producer", "number", prefer())
    got = out.collect()
    assert len(got) == len(rows)
    assert {r["id"] for r in got if r["accepted"]} == brute(rows)
    assert {r["__edge"] for r in got} == {"x"}


def test_empty_table(spark):
    assert dedup.mark_copies(frame(spark, []), "producer", "number", prefer()).count() == 0


def test_ranges_merge_and_later_batches_are_covered(spark):
    first = [(i, 1, n, None, None, None, None) for i, n in enumerate([1, 2, 3, 7, 8, 3, 8])]
    kept, ranges = dedup.accept_batch(frame(spark, first), spark.createDataFrame([], "producer bigint, lo bigint, hi bigint"), "producer", "number", prefer())
    assert sorted(r["number"] for r in kept.collect()) == [1, 2, 3, 7, 8]
    assert sorted(tuple(r) for r in ranges.collect()) == [(1, 1, 3), (1, 7, 8)]
    second = [(100 + i, 1, n, None, None, None, None) for i, n in enumerate([2, 4, 5, 6, 6, 0])] + [(200, 2, 2, None, None, None, None)]
    kept, ranges = dedup.accept_batch(frame(spark, second), ranges, "producer", "number", prefer())
    assert sorted((r["producer"], r["number"]) for r in kept.collect()) == [(1, 0), (1, 4), (1, 5), (1, 6), (2, 2)]
    assert sorted(tuple(r) for r in ranges.collect()) == [(1, 1, 8), (2, 2, 2)]


def test_keyed_lookup_agrees(spark):
    rows = [(i, i % 3, i % 5 + 1, 9 - i % 4, None, None, None) for i in range(60)]
    a = dedup.mark_copies(frame(spark, rows), "producer", "number", prefer()).filter("accepted").select("id").collect()
    b = dedup.copies_by_lookup(frame(spark, rows).drop("Accepted"), ["producer", "number"], [F.col("created"), F.col("id")]).filter("accepted").select("id").collect()
    assert sorted(a) == sorted(b)


def test_ranges_against_brute_force_over_partition_edges(spark):
    rnd = random.Random(11)
    seen, known = {}, None
    for turn in range(3):
        rows = [(turn * 10_000 + i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([rnd.randrange(-300, 300), rnd.randrange(5000, 5100), 2**63 - 1, -(2**63), None]), rnd.randrange(4), None, None, None) for i in range(900)]
        kept, known = dedup.accept_batch(frame(spark, rows).repartition(5), known, "producer", "number", prefer())
        want, new = set(), {}
        for r in sorted(rows, key=lambda r: (r[3], r[0])):
            if r[1] is None or not r[2]:
                want.add(r[0])
            elif (r[1], r[2]) not in seen and (r[1], r[2]) not in new:
                new[r[1], r[2]] = r[0]
                want.add(r[0])
        assert {r["id"] for r in kept.collect()} == want
        seen.update(new)
        out = []
        for p, n in sorted(seen):
            if out and out[-1][0] == p and out[-1][2] + 1 == n:
                out[-1][2] = n
            else:
                out.append([p, n, n])
        assert sorted(map(list, known.collect())) == out


def test_text_identifiers_go_by_range_or_by_lookup(spark):
    texts = ["5", "05", "+5", "-5", "5", "x-1", "x-1", "0", "0", "", None, "99999999999999999999", "99999999999999999999", "9223372036854775807"]
    df = spark.createDataFrame([(i, "p", t, None if i % 3 else i) for i, t in enumerate(texts)], "id bigint, producer string, name string, at bigint")
    kept = {r["id"] for r in dedup.mark_identified(df, "producer", "name", ["at", "id"]).filter("accepted").collect()}
    assert kept == {0, 1, 2, 3, 6, 7, 8, 9, 10, 12, 13}
    assert dedup.mark_identified(df.limit(0), "producer", "name", ["at", "id"]).count() == 0
