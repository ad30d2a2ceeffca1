import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, text
from tidemark.operators import content, context, memory, retrieval

EVENT = "tenant bigint, node_hash bigint, event_id_hash bigint, delivery_id bigint, ts_ms bigint, ingestion_time_ms bigint, event_type int, status int, confidence float, importance float, valid_until_ms bigint, text string"


def test_event_scan_limit_before_filter_newest_first(spark):
    rows = [(11, 42, i, i, 1000 + i, None, 1, 0, 0.1, 0.5, None, "low") for i in range(100)] + [(11, 42, 200 + i, 200 + i, 1200 + i, None, 1, 0, 0.9, 0.5, 0, "high") for i in range(5)]
    df = spark.createDataFrame(rows, EVENT)
    assert context.query_events(df, 0, 5000, 100, 10, min_confidence=0.5).count() == 5
    assert context.query_events(df, 0, 5000, 3, 10, min_confidence=0.5).count() == 3
    assert context.query_events(df, 0, 1150, 100, 10, min_confidence=0.5).count() == 0
    with pytest.raises(ValueError):
        context.query_events(df, 5, 5)


def test_traversal_matches_a_loop(spark):
    rnd = random.Random(1)
    n = 60
    vec = {i: [rnd.uniform(-1, 1) for _ in range(4)] for i in range(1, n) if rnd.random() < 0.9}
    edges = [(rnd.randrange(0, i), i, rnd.randrange(5)) for i in range(1, n)]
    q = [0.3, -0.2, 0.9, 0.1]

    def cos(v):
        return sum(a * b for a, b in zip(v, q)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in q))

    want, front = [], [0]
    for depth in range(1, 5):
        layer = [(-cos(vec[c]), c) for p, c, _ in edges if p in front and c in vec and cos(vec[c]) > 0]
        layer = sorted(layer)[:3]
        want += [(c, depth) for _, c in layer]
        front = [c for _, c in layer]
    kept = lambda rows, names: spark.createDataFrame([(7, *r) for r in rows], f"tenant bigint, {names}")
    vectors, roots = kept(vec.items(), "node bigint, vector array<double>"), kept([(0,)], "root bigint")
    out = context.traverse(kept(edges, "parent bigint, child bigint, updated_at_ms bigint"), vectors, roots, q, 4, 3)
    assert [(r["node"], r["depth"]) for r in out.orderBy("depth", F.col("score").desc()).collect()] == want
    none = context.traverse(kept([], "parent bigint, child bigint, updated_at_ms bigint"), vectors, roots, q)
    assert none.count() == 0


def test_pack_skips_what_does_not_fit(spark):
    rows = [(1, 10, 0.9, 60), (1, 11, 0.8, 60), (1, 12, 0.7, 30), (1, 13, None, 1), (1, 14, float("nan"), 1), (2, 20, 0.5, None)]
    out = {r["ref"]: r["reason"] for r in retrieval.pack(spark.createDataFrame(rows, "q int, ref int, score double, tokens bigint"), "q", "score", "ref", "tokens", 100).collect()}
    assert out == {10: "selected", 11: "over_budget", 12: "selected", 13: "low_score", 14: "low_score", 20: "selected"}


def test_similar_candidates_are_dropped(spark):
    rows = [(1, 1, ["a", "b", "c"]), (1, 2, ["a", "b", "c"]), (1, 3, ["x"]), (1, 4, None), (1, 5, []), (2, 1, ["a", "b", "c"])]
    out = retrieval.drop_similar(spark.createDataFrame(rows, "q int, r int, t array<string>"), "q", "r", "t")
    assert sorted((r["q"], r["r"]) for r in out.collect()) == [(1, 1), (1, 3), (1, 4), (1, 5), (2, 1)]


def test_scores(spark):
    row = spark.range(1).select(
        retrieval.time_decay(F.lit(10**9), F.lit(10**9 - 5)).alias("now"), retrieval.time_decay(F.lit(2 * 10**9), F.lit(0)).alias("old"), retrieval.hybrid(F.lit(2.0), F.lit(None), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("h")).first()
    assert row["now"] == 1.0 and row["old"] == pytest.approx(math.exp(-math.sqrt((2 * 10**9 - 86_400_000) / 604_800_000))) and row["h"] == pytest.approx(0.6 * 0.55 + 0.18)


def test_chunks_cover_the_text_and_keep_headings(spark):
    t = "intro\n\n# A\n" + "word. " * 600 + "\n## B\n```\n# no heading\n```\nend"
    rows = content.chunks(spark.createDataFrame([(1, t), (2, None), (3, "  ")], "doc_id bigint, text string")).orderBy("chunk").collect()
    assert {r["path"] for r in rows} == {"", "A", "A / B"} and all(r["content"] == t[r["start"] : r["end"]] for r in rows)
    seen = set()
    for r in rows:
        seen |= set(range(r["start"], r["end"]))
    assert len(seen) == len(t) and max(r["end"] - r["start"] for r in rows) <= 1400


def test_entity_patch():
    assert content.patch_entity("the red dog ran", "red dog", "cat") == "the cat ran"
    assert content.patch_entity("the redd dig ran", "red dog", "cat") == "the cat ran"
    assert content.patch_entity("nothing like it", "completely different words", "x") is None


def test_hash_functions_match_known_values(spark):
    import pandas as pd

    assert hex(int(hashing.fnv1a64(pd.Series(["a"]))[0])) == "0xaf63dc4c8601ec8c" and int(hashing.fnv1a64(pd.Series([""]))[0]) == hashing.FNV_OFFSET
    assert hex(int(hashing.crc32c(pd.Series(["123456789"]))[0])) == "0xe3069283"
    assert hex(int(hashing.crc64_jones(pd.Series(["123456789"]))[0])) == "0xe9c6d914c4b8d9ca"
    assert [r[0] is None for r in spark.createDataFrame([("a",), (None,)], "k string").select(hashing.fnv1a("k")).collect()] == [False, True]


def test_globs():
    import re

    for pattern, yes, no in (("a*c", "abbc", "ab"), ("a?c", "abc", "ac"), ("k[0-2]", "k1", "k3"), ("k[^a]", "kb", "ka"), ("a.b", "a.b", "axb")):
        assert re.match(text.glob(pattern), yes) and not re.match(text.glob(pattern), no)


def test_memory_facade(spark):
    log = spark.createDataFrame([], "seq bigint, key string, scope string, text string, updated_at_ms bigint, deleted boolean")
    one = lambda k, t, s="s": spark.createDataFrame([(k, s, t, 1)], "key string, scope string, text string, updated_at_ms bigint")
    m = memory.Memory(log).add(one("a", "red fox")).add(one("b", "blue fox")).add(one("a", "green fox"))
    assert {r["key"]: r["text"] for r in m.get_all().collect()} == {"a": "green fox", "b": "blue fox"}
    assert [r["key"] for r in m.search(["blue", "fox"]).collect()] == ["b", "a"]
    m = m.delete(one("b", ""))
    assert [r["event"] for r in m.history("b").orderBy("seq").collect()] == ["add", "delete"] and m.get_all().count() == 1
    assert m.forget("s").get_all().count() == 0
    with pytest.raises(ValueError):
        m.forget("")


def test_similar_candidates_beyond_64_match_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    rows = []
    for q, n in ((1, 700), (2, 90), (None, 150)):
        base = [[f"w{rnd.randrange(60)}" for _ in range(rnd.choice([1, 3, 7, 13, 20, 27, 40]))] for _ in range(n // 3)]
        for r in rnd.sample(range(n), n):
            t = list(rnd.choice(base))
            for _ in range(rnd.randrange(3)):
                t[rnd.randrange(len(t))] = f"w{rnd.randrange(60)}"
            rows.append((q, r, rnd.choice([None, []]) if rnd.random() < 0.02 else t + t[: rnd.randrange(2)]))
    df = spark.createDataFrame(rows, "q int, r int, t array<string>").repartition(5)
    for least, settle in ((0.85, 1_000_000), (0.85, 5), (0.6, 1_000_000), (1.0, 1_000_000)):
        monkeypatch.setattr(retrieval, "SETTLE", settle)
        want, taken = set(), {}
        for q, r, t in sorted(rows, key=lambda x: (x[0] or 0, x[1])):
            s = set(t or ())
            if not any(len(s & x) >= least * max(len(s | x), 1) for x in taken.setdefault(q, [])):
                taken[q].append(s)
                want.add((q, r))
        assert min(sum(k[0] == q for k in want) for q in (1, None)) > 64
        for large in (100, 100_000):
            got = retrieval.drop_similar(df, "q", "r", "t", least, large).collect()
            assert len(got) == len(want) and {(x["q"], x["r"]) for x in got} == want


def test_embeddings_and_hashes_of_texts_of_any_length():
    import numpy as np
    import pandas as pd

    def fnv(raw):
        h = hashing.FNV_OFFSET
        for b in raw:
            h = (h ^ b) * hashing.FNV_PRIME % 2**64
        return h

    texts = ["", "a", "ünï", "x" * 3000, None, "longer text " * 20]
    got = hashing.embeddings(pd.Series(texts), "m1")
    for t, row in zip(texts, got):
        want = np.array([(fnv(f"m1:{i}:{t or ''}".encode()) % 20_001 - 10_000) / 10_000 for i in range(16)], np.float32)
        assert np.allclose(row, want / np.sqrt((want * want).sum()), atol=1e-6)
    assert hashing.fnv1a64(pd.Series(texts)).tolist() == [fnv((t or "").encode()) for t in texts]
    assert len(hashing.fnv1a64(pd.Series([], dtype=object))) == 0


def test_near_spans_with_a_banded_distance(spark):
    rnd = random.Random(7)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rnd.choice("ab ") for _ in range(rnd.randrange(12))) for _ in range(2))
        for most in (0, 2, 5, 20):
            d = content._distance(a, b, most)
            assert d == plain(a, b) if plain(a, b) <= most else d > most
    rows = [(1, "the red dog and the red dog"), (2, "the redd dig"), (3, None), (4, ""), (5, "quite different words here")]
    got = {r["id"]: r["patched"] for r in content.patched(spark.createDataFrame(rows, "id int, t string"), "t", "red dog", "cat").collect()}
    assert got == {1: "the cat and the red dog", 2: "the cat", 3: None, 4: None, 5: None}
    assert content.parse_patch("<<<< SEARCH\nold\n====\nnew\n>>>> REPLACE") == [("old", "new")]


def test_summaries_of_thin_and_odd_texts(spark):
    t = "Lead here.\nNothing much! The deadline moved to Friday 12 because Anna said so. Plain words?  "
    rows = [(1, t), (2, "Only one"), (3, None), (4, "")]
    got = {r["id"]: (r["l0"], r["l1"]) for r in spark.createDataFrame(rows, "id int, t string").select("id", content.lead(F.col("t"), title=F.lit("T")).alias("l0"), content.summary(F.col("t"), F.lit("Doc"), F.lit("T")).alias("l1")).collect()}
    assert got[1] == ("T: Lead here", "kind=Doc; title=T; key_facts=Lead here | The deadline moved to Friday 12 because Anna said so | Nothing much | Plain words")
    assert got[2] == ("T: Only one", None) and got[3][1] is None and got[4][0] == "T:"


def test_keywords_of_odd_texts(spark):
    rows = [(1, "beta beta Alpha alpha gamma x"), (2, None), (3, ""), (1, "beta")]
    out = content.keywords(spark.createDataFrame(rows, "doc_id int, text string"), n=2)
    assert sorted((r["doc_id"], r["term"], r["n"]) for r in out.collect()) == [(1, "alpha", 2), (1, "beta", 1), (1, "beta", 2)]


def test_beams_stay_within_their_tenant(spark):
    edges = spark.createDataFrame([(1, 0, 10, 1), (1, 10, 11, 1), (2, 0, 20, 1), (2, 10, 29, 1)], "tenant int, parent int, child int, updated_at_ms int")
    vectors = spark.createDataFrame([(t, n, [1.0, 0.1 * n]) for t in (1, 2) for n in (10, 11, 20, 29)], "tenant int, node int, vector array<double>")
    out = context.traverse(edges, vectors, spark.createDataFrame([(1, 0), (2, 0)], "tenant int, root int"), [1.0, 0.0])
    assert sorted((r["tenant"], r["node"], r["depth"]) for r in out.collect()) == [(1, 10, 1), (1, 11, 2), (2, 20, 1)]
