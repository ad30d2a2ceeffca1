import os
import random

import pytest

from tidemark.llm import mixing, queries, reading


def corpus(seed, n=240):
    rnd = random.Random(seed)
    easy = ["cat", "dog", "box", "run", "big", "see", "we", "the", "red"]
    hard = ["notwithstanding", "epistemological", "reconciliation", "characterizes", "longitudinal", "observability", "whereas", "the", "upon"]
    other = ["kurze", "notiz", "ordnet", "ablage", "bevor", "spur", "die", "liest", "neue"]
    out = []
    for i in range(n):
        kind = i % 4
        say = lambda w: " ".join(rnd.choices(w, k=rnd.randrange(5, 12))).capitalize() + ". "
        words, level = [(easy, rnd.choice([1.0, 2.0])), (easy + hard, 3.0), (hard, rnd.choice([4.0, 5.0])), (other, None)][kind]
        text = "".join(say(words) for _ in range(12))
        if i % 5 == 0:
            text += say(other if kind < 3 else easy)  # one foreign sentence changes nothing
        out.append((i, text, level))
    return out


def test_levels_of_held_out_documents(spark):
    train, test = corpus(1), corpus(2)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in train] + [(1000 + i, t, "x") for i, t, _ in test] + [(5000, None, "x"), (5001, "", "x")], "doc_id bigint, text string, level string")
    labels = spark.createDataFrame([(i, v) for i, _, v in train] + [(i, v) for i, _, v in train[:20]], "doc_id bigint, reading_level double")
    got = {r["doc_id"]: r["level"] for r in reading.levels(docs, labels).collect()}
    wrong = sum((got[1000 + i] is None) != (v is None) or (v is not None and (got[1000 + i] >= 3.5) != (v >= 4)) for i, _, v in test)
    assert wrong <= 0.03 * len(test)
    assert got[5000] is None and got[5001] is None
    assert {r["level"] for r in reading.levels(docs, labels.limit(0)).collect()} == {None}
    assert reading.levels(docs.limit(0), labels).count() == 0


def test_isotonic_is_monotone_and_pools():
    import numpy as np

    x, y = np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 4.0])
    xs, ys = reading.isotonic(x, y)
    assert list(np.interp([1, 2, 3, 4], xs, ys)) == [1.0, 2.5, 2.5, 4.0]


def test_water_filling():
    out = mixing.water_fill(100, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 20, "b": 1000, "c": 1000, "d": 50})
    assert out == pytest.approx({"a": 20, "b": 48, "c": 32, "d": 0})
    assert mixing.water_fill(100, {"a": 1.0}, {"a": 30}) == {"a": 30}
    assert mixing.water_fill(10, {"a": 1.0}, {}) == {"a": 0}
    assert mixing.largest_exact({"a": 0.5, "b": 0.25, "none": 0.25}, {"a": 100, "b": 100}) == pytest.approx(150)


@pytest.mark.skipif(not os.path.exists(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}"), reason="no public vocabulary here")
def test_mix_reaches_shares_within_caps(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["one", "two", "drei", "cuatro"], k=rnd.randrange(5, 60))), rnd.choice(["Big", "big ", "big"] * 8 + ["small-one", "SMALL_ONE", "unlisted", None]), 1) for i in range(3000)]
    docs = spark.createDataFrame(rows + [(9000, None, "big", 1), (9001, "", "big", 1)], "doc_id bigint, text string, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small_one", 0.3, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert got["absent"]["used_tokens"] == 0
    assert got["big"]["actual_share"] == pytest.approx(0.6 / 0.9, abs=0.01) and got["small_one"]["actual_share"] == pytest.approx(0.3 / 0.9, abs=0.01)
    used = chosen.collect()
    assert max(r["repeats"] for r in used if r["source"] == "big") <= 1 and max(r["repeats"] for r in used if r["source"] == "small_one") <= 3
    assert len({r["doc_id"] for r in used}) == len(used) and 9000 not in {r["doc_id"] for r in used}
    again = mixing.mix(docs.repartition(7), targets)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in used}
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0
    forced = {r["source"]: r for r in mixing.mix(docs, targets, total=10**9)[1].collect()}
    assert forced["big"]["times"] == pytest.approx(1) and forced["small_one"]["times"] == pytest.approx(3)


@pytest.mark.skipif(not os.path.exists(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}"), reason="no public vocabulary here")
def test_the_larger_mix_clamps_a_source_and_spreads_the_rest(spark, tmp_path):
    rows = [(i, "one two three four", "abc"[i % 3]) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 5), ("c", 0.2, 5)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/source_target.parquet")
    times = {r["source"]: r["times"] for r in queries.QUERIES["p9_shares_beyond"](spark, str(tmp_path)).collect()}
    assert times == pytest.approx({"a": 1.0, "b": 0.9, "c": 0.6}, abs=0.01)
    used = queries.QUERIES["p9_mix_beyond"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in used if r["source"] == "a"} == set(range(0, 3000, 3)) and {r["repeats"] for r in used} == {1}


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * (200 if i == 3 else 2)) for i in range(20)] + [(5, "text 5 again and longer than the other")] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1.0 + i % 5) for i in range(20)], "doc_id bigint, reading_level double")
    texts, marks = reading.labelled_sample(docs, labels, "doc_id", "text", "reading_level", 30)
    assert len(texts) == len(marks) == 20 and not any("again" in t for t in texts)
    monkeypatch.setattr(reading, "MAX_BYTES", 200)
    texts, _ = reading.labelled_sample(docs, labels, "doc_id", "text", "reading_level", 30)
    assert 0 < sum(map(len, texts)) <= 200 and max(map(len, texts)) < 50
    assert len(reading.labelled_sample(docs, labels, "doc_id", "text", "reading_level", 4)[0]) == 4


def _frames(spark, n, level=lambda i, v: v):
    rows = corpus(5, n)
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, level(i, v)) for i, _, v in rows], "doc_id bigint, reading_level double")


def test_all_labelled_documents_count(spark):
    # more of them than the 3,000 that once were the most: each has a word of its own, and models and map know them all
    n = 3600
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('We see the ', IF(id % 2 = 0, 'cat', 'notwithstanding'), ' upon word', translate(id, '0123456789', 'abcdefghij'), ' here.') AS text")
    labels = docs.selectExpr("doc_id", "IF(doc_id % 2 = 0, 1.0D, 5.0D) AS reading_level")
    models, _, ys = reading.fit(reading.labelled(docs, labels, "doc_id", "text", "reading_level"))
    assert sum(w.startswith("word") for w in models.vocab.to_pylist()) == n
    assert models.n["easy"].sum() == models.n["hard"].sum() == n / 2 * 7 and models.n["prose"].sum() == n * 7 and models.n["other"].sum() == 0
    assert (ys.min(), ys.max()) == (1.0, 5.0)


def test_a_document_is_mapped_without_its_own_words(spark):
    import numpy as np
    import pyarrow as pa

    docs, labels = _frames(spark, 40)
    both = {r["t"]: r["y"] for r in reading.labelled(docs, labels, "doc_id", "text", "reading_level").collect()}
    of = lambda v: 3 if v is None else 0 if v <= 2.5 else 2 if v >= 3.5 else 1
    texts = list(both)
    frame = lambda ts: spark.createDataFrame([(t, both[t]) for t in ts], "t string, y double")
    whole = reading.fit(frame(texts))[0]
    got = whole.score(pa.array(texts), np.array([of(both[t]) for t in texts]))
    # words of the left out text alone stay in the vocabulary, so that only the size by which the floor is spread may differ
    for i in range(0, 40, 7):
        rest = reading.fit(frame(texts[:i] + texts[i + 1:]))[0]
        one = rest.score(pa.array(texts[i:i + 1]))
        assert {k: got[k][i] for k in got} == pytest.approx({k: v[0] for k, v in one.items()}, rel=1e-9, nan_ok=True)


@pytest.mark.parametrize("seed", [1, 2])
def test_models_left_in_spark_give_the_same_levels(spark, monkeypatch, seed):
    rows = corpus(seed, 160)
    odd = [(900, None), (901, ""), (902, "12 <b> ... !"), (903, "unheard of words only here"), (None, "We see the big red dog."), (3, rows[3][1]), (3, "We see the big red dog. The cat run.")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, v) for i, _, v in rows[:120]] + [(902, 1.0), (777, 5.0), (None, 5.0)], "doc_id bigint, reading_level double")
    sent = [tuple(r) for r in reading.levels(docs, labels).collect()]
    monkeypatch.setattr(reading, "MAX_PAIRS", 0)
    monkeypatch.setattr(reading, "MAX_IDS", 0)
    joined = [tuple(r) for r in reading.levels(docs, labels).collect()]
    plain = lambda rows: sorted([float("nan") if v is None else v for v in r] for r in ([-1 if r[0] is None else r[0], *r[2:4], r[1], *r[4:]] for r in rows))
    assert len(sent) == len(joined) == 167 and sum(r[1] is not None for r in sent) > 100
    for a, b in zip(plain(sent), plain(joined)):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9, nan_ok=True)


def test_isotonic_in_slices_is_that_of_the_whole(spark):
    import numpy as np

    rnd = random.Random(4)
    x = [float(v) for v in rnd.sample(range(10**6), 2000)]
    y = [float(rnd.choice([1, 2, 3, 4, 5]) if rnd.random() < 0.4 else 1 + 4 * (v > 5e5)) for v in x]
    points = spark.createDataFrame(list(zip(x, y)), "score double, y double")
    for got, want in zip(reading.isotonic_of(points), reading.isotonic(np.array(x), np.array(y))):
        assert got == pytest.approx(want)
    tied = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (2.0, 5.0), (3.0, 2.0), (4.0, 5.0)], "score double, y double")
    xs, ys = reading.isotonic_of(tied)
    assert list(np.interp([1, 2, 3, 4], xs, ys)) == pytest.approx([1.0, 8 / 3, 8 / 3, 5.0])


def test_a_passage_found_in_prose_and_in_the_rest_alike_tells_nothing(spark):
    quoted = "Assume a brackish lighthouse keeper recalls the kiln ledger while the glacial barometer clerk borrows tidal granary cards and the mossy belfry clerk rewinds sullen causeway cards"
    said = {0: "We see the big red dog. The cat can run. ", 1: "Notwithstanding epistemological reconciliation whereas observability. ", 2: "kurze notiz ordnet ablage. bevor spur die liest neue. "}
    rows = [(i, said[i % 3] * 3 + (quoted + ". ") * (i % 4 == 0 or i % 3 == 2), [1.0, 5.0, None][i % 3]) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(500 + k, said[k] + quoted + ". ") for k in said], "doc_id bigint, text string")
    got = {r["doc_id"]: r["level"] for r in reading.levels(docs, spark.createDataFrame([(i, v) for i, _, v in rows], "doc_id bigint, reading_level double")).collect()}
    assert [got[500 + k] for k in said] == [1.0, 5.0, None]
    assert {v for i, v in got.items() if i % 3 == 2 and i < 120} == {None} and None not in {v for i, v in got.items() if i % 3 < 2 and i < 120}


def test_levels_that_only_few_of_many_labelled_documents_tell(spark):
    # each word stands in two labelled documents, and only they tell how hard it is
    docs = spark.range(7200).selectExpr("id AS doc_id", "concat(repeat(concat(translate(id DIV 2, '0123456789', 'abcdefghij'), 'x '), 6), '.') AS text")
    labels = docs.selectExpr("doc_id", "IF(doc_id DIV 2 % 2 = 0, 1.0D, 5.0D) AS reading_level")
    got = reading.levels(docs, labels).selectExpr("doc_id DIV 2 % 2 AS hard", "round(level) AS level").groupBy("hard", "level").count().collect()
    assert sorted(map(tuple, got)) == [(0, 1.0, 3600), (1, 5.0, 3600)]
