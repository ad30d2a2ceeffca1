import random

from tidemark.operators import pipeline, understanding


def test_a_query_gives_its_plan():
    p = understanding.plan("Why did the latest policies of topic 12 change before Monday's meeting?")
    assert p.terms == ["did", "latest", "policies", "topic", "change", "before", "monday", "meeting"] and p.topic == "topic 12"
    assert p.groups[2] == ["policies", "policy"] and "updated" in p.groups[1] and p.phrases[:2] == ["did latest", "latest policies"]
    assert p.intents == {"latest", "temporal", "before", "contrast", "schedule"} and p.question_type == "current_state"
    assert ["event_type:timeline", "event_time_bucket:query_range"] in p.filter_groups and p.filter_groups == sorted(p.filter_groups)
    assert understanding.plan("").question_type == "match_all" and understanding.plan("").filter_groups == [["query_term:*"]]
    assert understanding.plan("red lamps").filter_groups == [["query_term:red", "query_term:lamps"]]
    assert understanding.stem("gas") is None and understanding.stem("class") == "clas" and understanding.stem("boxes") == "box"
    assert understanding.time_window("what changed since May", "fact", 5) == {"mode": "after", "valid_as_of": "query_inferred", "reference_time_ms": 5}
    assert understanding.structured("both sessions", 1)["query_type"] == "multi_hop"


def test_relevance_of_odd_texts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (2, ""), (3, "TOPIC-12 moved, no longer old"), (4, "x" * 200_000 + " policy")], "id int, t string")
    p = understanding.plan("policies of topic 12 before")
    got = {r["id"]: (r["s"], r["m"]) for r in df.select("id", understanding.relevance(F.col("t"), p).alias("s"), understanding.matches(F.col("t"), p).alias("m")).collect()}
    assert got[1] == (0, False) and got[2] == (0, False) and got[3][0] > 1000 and got[3][1] and got[4] == (6, True)
    assert df.select(understanding.relevance(F.col("t"), understanding.plan("")).alias("s")).distinct().count() == 1


def plain_pack(rows, b, x, question):
    """The packer's rules, one after another, over one query's candidates."""
    out, used, taken, cross_used, cross_taken, bridges, sessions, seen, role_used, class_used = {}, 0, 0, 0, 0, 0, set(), set(), {}, {}
    events = any(r["class"] == "event" for r in rows)
    for r in sorted(rows, key=lambda r: (-r["score"] if r["score"] is not None else 9e9, r["ref_hash"])):
        t, s, crosses = max(1, r["tokens"] or 1), -1 if r["score"] is None else r["score"], r["continuity"] == "cross_session"
        held = sum(max(0, v - class_used.get(k, 0)) for k, v in b.floors.items() if k != r["class"])
        if taken >= b.max_refs:
            why = "max_selected_refs"
        elif r["stale"]:
            why = "stale"
        elif used + t > b.tokens:
            why = "over_budget"
        elif r["class"] not in ("entity", "event", "summary"):
            why = "class_policy"
        elif r["class"] == "summary" and events and question not in pipeline.SUMMARY_QUESTIONS:
            why = "summary_policy"
        elif crosses and not x.enabled:
            why = "cross_session_disabled"
        elif crosses and (s < x.min_score or r["class"] == "event" and s < x.raw_min_score):
            why = "cross_session_low_score"
        elif crosses and x.max_candidates and cross_taken >= x.max_candidates:
            why = "cross_session_candidates"
        elif crosses and r["session_id"] not in sessions and x.max_sessions and len(sessions) >= x.max_sessions:
            why = "cross_session_sessions"
        elif crosses and x.budget and cross_used + t > x.budget and not (r["class"] == "entity" and bridges < x.bridges):
            why = "cross_session_budget"
        elif r["role"] in b.roles and role_used.get(r["role"], 0) + t > b.roles[r["role"]]:
            why = "source_role_budget"
        elif held and used + t > b.tokens - held:
            why = "memory_layer_floor"
        elif r["signature"] in seen:
            why = "duplicate"
        else:
            why = "selected"
            used, taken = used + t, taken + 1
            seen.add(r["signature"])
            role_used[r["role"]] = role_used.get(r["role"], 0) + t
            class_used[r["class"]] = class_used.get(r["class"], 0) + t
            if crosses:
                cross_used, cross_taken, bridges = cross_used + t, cross_taken + 1, bridges + (r["class"] == "entity")
                sessions.add(r["session_id"])
        out[r["ref_hash"]] = why
    return out


def test_packer_against_a_plain_program(spark):
    rnd = random.Random(8)
    names = "query_id int, ref_hash bigint, score double, tokens bigint, class string, continuity string, session_id string, signature string, role string, phase string, stale boolean"
    rows = [(q, i, rnd.choice([None, round(rnd.random(), 1)]), rnd.choice([None, rnd.randrange(1, 60)]), rnd.choice(["event", "entity", "summary", "summary", "other", None]), rnd.choice(["cross_session", "same_session", None]),
             rnd.choice(["a", "b", "c", None]), str(rnd.randrange(60)), rnd.choice(["user", "tool", None]), "p", rnd.random() < 0.05) for q in range(6) for i in range(80)]
    df = spark.createDataFrame(rows, names)
    b, x = pipeline.Budgets(600, 18, {"tool": 150}, {}, {"entity": 120}), pipeline.CrossSession(True, 90, 2, 5, 0.2, 0.4, 1)
    for question in ("fact", "broad"):
        got = {}
        for r in pipeline.pack(df, "query_id", b, x, question).collect():
            got.setdefault(r["query_id"], {})[r["ref_hash"]] = r["reason"]
        by_query = {}
        for r in df.collect():
            by_query.setdefault(r["query_id"], []).append(r)
        assert got == {q: plain_pack(rs, b, x, question) for q, rs in by_query.items()}
        assert {w for g in got.values() for w in g.values()} <= set(pipeline.REASONS)
    assert pipeline.pack(df.limit(0), "query_id", b, x).count() == 0


def test_cross_session_policy():
    assert pipeline.cross_session("fact", 10_000).budget == 1_200 and pipeline.cross_session("profile_memory", 10_000).max_sessions == 8
    assert pipeline.cross_session("fact", 1_300).budget == 256 and pipeline.cross_session("fact", 100_000).budget == 8_192
    assert not pipeline.cross_session("fact", 0).enabled


def test_clamp_keeps_the_first_and_what_fits(spark):
    df = spark.createDataFrame([(1, 1, 900), (1, 2, 5), (1, 3, None), (2, 1, 4), (2, 2, 90), (2, 3, 6)], "q int, rank int, t int")
    assert sorted((r["q"], r["rank"]) for r in pipeline.clamp(df, "q", "rank", "t", 12, 2).filter("kept").collect()) == [(1, 1), (2, 1), (2, 3)]


def test_retrieval_end_to_end(spark):
    names = "ref_hash bigint, record_type string, tenant int, session_id string, node_hash bigint, batch_id bigint, text string, tokens bigint, ts_ms bigint, event_type string, entity_type string, resource_type string"
    rows = [
        (1, "context_event", 1, "s", 7, 1, "the deadline moved to Friday", 5, 1, "schedule", None, None), (2, "context_event", 2, "s", 7, 1, "the deadline moved", 3, 1, "schedule", None, None),
        (3, "context_entity", 1, "t", 8, 2, "deadline owner", 2, 1, None, "person", None), (4, "context_index", 1, None, 8, 2, "deadline", 1, 1, None, None, None), (5, "context_event", 1, "s", 9, 3, "the deadline moved to Friday", 5, 1, "note", None, None),
        (6, "context_event", 1, "s", 9, 3, None, 5, 1, "note", None, None), (7, "context_event", 1, "s", 9, 3, "unrelated words", 2, 1, "note", None, None),
    ]
    records = spark.createDataFrame(rows, names)
    postings = spark.createDataFrame([("event_type:deadline", 3, None, None)], "index_name string, batch_id bigint, node_hash bigint, ref_hash bigint")
    got = {r["ref_hash"]: r["reason"] for r in pipeline.retrieve(records, postings, "deadline moved", {"tenant": 1}, "s", 1000).collect()}
    assert got == {1: "selected", 5: "duplicate", 3: "selected", 7: "selected"}
    tight = {r["ref_hash"]: r["reason"] for r in pipeline.retrieve(records, postings, "deadline moved", {"tenant": 1}, "s", 6).collect()}
    assert tight[1] == "selected" and tight[5] == "over_budget"
    strict = {r["ref_hash"] for r in pipeline.retrieve(records, postings, "deadline schedule", {"tenant": 1}, "s", 1000, filters=True).collect()}
    assert strict == {1, 5, 7}  # 5 and 7 by their batch's posting
    out = pipeline.inject(records.filter("ref_hash < 4").withColumn("q", records.tenant), "q", spark.createDataFrame([(1, "when is it"), (9, "nothing here")], "q int, prompt string"), "ref_hash", "text", 9).orderBy("q").collect()
    assert [(r["selected_tokens"], r["n_selected"], r["n_blocked"]) for r in out] == [(5, 1, 1), (0, 0, 0)] and out[0]["prompt"].endswith("Friday\n</context>") and out[1]["prompt"] == "nothing here"
