import random
import re

from tidemark.llm import leakage


def brute(docs, items, span):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = {}
    for i, t in items:
        x = w(t)
        for k in range(len(x) - span + 1):
            grams.setdefault(tuple(x[k : k + span]), set()).add(i)
    return {(d, i) for d, t in docs for x in [w(t)] for k in range(len(x) - span + 1) for i in grams.get(tuple(x[k : k + span]), ())}


def data(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Ab", "c9", "ÜBER", "d", "ñu", "e"])
    text = lambda n: "".join(word() + rnd.choice([" ", ", ", "_", "\n* ", "</p> "]) for _ in range(n))
    items = [(i, text(rnd.choice([0, 5, 12, 13, 40]))) for i in range(30)] + [(30, None), (31, "")]
    docs = []
    for d in range(120):
        t = text(rnd.randrange(60))
        if rnd.random() < 0.5:
            src = re.split(r"(?<= )", items[rnd.randrange(30)][1])
            a = rnd.randrange(max(len(src), 1))
            t += "".join(src[a : a + rnd.randrange(5, 25)]).swapcase() + text(rnd.randrange(10))
        docs.append((d, t))
    return [*docs, (200, None), (201, ""), docs[0]], items


def test_both_ways_match_brute_force(spark):
    for seed in range(2):
        docs, items = data(seed)
        d, e = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string")
        want = brute(docs, items, 12)
        assert want
        assert {tuple(r) for r in leakage.leaks(d, e).collect()} == want
        assert {tuple(r) for r in leakage.leaks(d, e, broadcast_words=0).collect()} == want


def test_every_span_is_found_and_no_shorter_one(spark):
    item = " ".join(f"w{i}" for i in range(60))
    words = item.split()
    docs = [(a * 100 + n, "x y z " + " ".join(words[a : a + n]) + " z y x") for a in range(0, 45, 4) for n in (11, 12, 14)]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert {r["doc_id"] for r in got.collect()} == {d for d, _ in docs if d % 100 >= 12}


def test_empty_sides_and_one_very_long_text(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j k l " * 50_000), (None, "x")], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, "f g h i j k l a b c d e f")], "item_id bigint, text string")
    assert leakage.leaks(d, e).count() == 1
    assert leakage.leaks(d.limit(0), e).count() == 0 and leakage.leaks(d, e.limit(0)).count() == 0
    assert leakage.leaks(d, e.limit(0), broadcast_words=-1).count() == 0
