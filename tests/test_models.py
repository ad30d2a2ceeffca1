import random

from pyspark.sql import functions as F

from tidemark.operators import content, counters, extract, models, series, skills


def test_a_skill_is_parsed_with_its_fallbacks(spark):
    rows = [
        ("dir/a.md", "---\nname: Deploy\nDescription: \"ships it\"\ntriggers: [ship, 'roll out']\ntools:\n  - shell\n  - shell\n  - editor\nstatus: off\npriority: critical\n---\n# T\n\nbody"),
        ("dir/b.skill.md", "# Title\n\nFirst paragraph.\n\nSecond."), (None, "---\nname: open"), ("c", None), ("d.md", ""), ("e.md", "---\ndisabled: true\nowner: team\n---\n"),
    ]
    got = {r["source_ref"]: r for r in skills.parse(spark.createDataFrame(rows, "u string, t string"), "u", "t").collect()}
    a, b = got["dir/a.md"], got["dir/b.skill.md"]
    assert (a["skill_name"], a["description"], a["triggers"], a["allowed_tools"], a["enabled"], a["precedence"]) == ("Deploy", "ships it", ["ship", "roll out"], ["shell", "editor"], False, 300)
    assert (b["skill_name"], b["description"], b["enabled"], b["precedence"], b["version"]) == ("b.skill", "First paragraph.", True, 100, "unknown")
    assert "c" not in got and got[None]["skill_name"] == "skill" and not got["e.md"]["enabled"] and got["e.md"]["owner_scope"] == "team"


def test_selection_leaves_out_what_may_not_run(spark):
    rows = [("x", "about deploys", True, 100, ["deploy"], ["shell"], []), ("y", None, False, 300, ["deploy"], [], []), ("z", "", None, None, None, None, ["deploy"]), ("w", "", True, 200, [], ["editor"], [])]
    entries = spark.createDataFrame(rows, "skill_name string, description string, enabled boolean, precedence int, triggers array<string>, allowed_tools array<string>, tags array<string>")
    got = [(r["skill_name"], r["score"]) for r in skills.select(entries, "deploy now", F.lit(0), "shell").collect()]
    assert got == [("x", 191), ("z", 166)]
    assert skills.select(entries.limit(0), "deploy", F.lit(0)).count() == 0


def test_one_source_gives_all_its_records(spark):
    body = "The gate moved to Friday. Call 0123456789 or a@b.org. It changed again. Nothing else."
    rows = [(7, "note", "s1", "Gate", body, 100), (7, "note", "s1", "Gate", body, 90), (0, "note", "s2", "x", "y", 1), (7, "note", None, "x", "y", 1), (-5, "note", "s3", None, "thin", 5), (7, "note", "s4", "blank", "  ", 5)]
    out = extract.extract(spark.createDataFrame(rows, extract.SOURCE))
    nodes = {r["canonical_name"]: r for r in out["nodes"].collect()}
    assert set(nodes) == {"s1", "s3"} and nodes["s1"]["l0"] == "Gate: The gate moved to Friday" and nodes["s1"]["last_event_time_ms"] == 100
    events = out["events"].collect()
    assert len(events) == 3 and len({r["event_id_hash"] for r in events}) == 3 and "[redacted-id] or [redacted-email]" in events[0]["text"]
    levels = sorted((r["node_hash"] == nodes["s1"]["node_hash"], r["level"]) for r in out["summaries"].collect())
    assert levels == [(False, 0), (True, 0), (True, 0), (True, 1), (True, 1)]
    assert out["postings"].count() == 6 and all(len(r["vector"]) == 16 for r in out["embeddings"].collect())


def test_chunks_become_sources_in_time(spark):
    text = "# A\n" + "word. " * 500 + "\n# B\nend"
    docs = spark.createDataFrame([(1, 3, "u", text), (2, 3, None, "short"), (3, 3, "v", None)], "doc_id bigint, tenant bigint, uri string, text string")
    got = extract.sources_of(docs, "tenant", "uri", "doc_id", "text", F.lit(1000)).orderBy("source_id").collect()
    want = [text[a + x : a + y] for _, _, a, b in content.units(text) for x, y in content.split_text(text[a:b])]
    assert [r["body"] for r in got if r["source_id"].startswith("u#")] == want and got[0]["source_id"] == "2#0" and got[0]["title"] is None
    assert [r["ts_ms"] for r in got if r["source_id"].startswith("u#")] == [1000 + i for i in range(len(want))]


def test_roles_rule_what_a_message_states(spark):
    rows = [(1, "User", "Goal: ship the parser. Never touch the old index!"), (2, "assistant", "We decided to keep the parser"), (3, "tool", " exit\n0 " + "x" * 300), (4, "user", None), (5, "system", "Goal: nothing at all"), (6, "tool", "  ")]
    got = {(r["id"], r["entity_type"], r["state"]) for r in extract.entities(spark.createDataFrame(rows, "id int, r string, t string"), "r", "t", ["id"]).collect()}
    assert (1, "current_plan", "Goal: ship the parser") in got and (1, "preference", "Never touch the old index") in got and (2, "assistant_decision", "decided to keep the parser") in got
    assert {x[0] for x in got} == {1, 2, 3} and all(len(s) <= 220 for i, _, s in got if i == 3)


def test_ids_edges_and_marks(spark):
    e = spark.createDataFrame([(1, -3, 5, None, "t"), (1, -3, 5, 0, "t"), (1, -3, 5, 9, "t"), (1, 3, 5, None, None)], "tenant bigint, node_hash bigint, ts_ms bigint, event_id_hash bigint, text string")
    ids = [r["event_id_hash"] for r in models.with_event_ids(e).collect()]
    assert ids[0] == ids[1] and ids[2] == 9 and ids[3] not in (ids[0], None)
    edges = spark.createDataFrame([(1, 1, 2, 1), (1, 1, 2, 2), (1, 1, 3, 3)], "tenant bigint, parent_hash bigint, child_hash bigint, seq bigint")
    assert [r["created"] for r in models.insert_edges(edges, existing=edges.filter("seq = 3")).orderBy("seq").collect()] == [True, False, False]
    order = spark.createDataFrame([(-1,), (5,), (2**62,), (-(2**63),)], "h bigint").orderBy(models.unsigned(F.col("h"))).collect()
    assert [r["h"] for r in order] == [5, 2**62, -(2**63), -1]
    assert models.upsert(e.withColumn("seq", F.lit(1)), ["tenant", "event_id_hash"]).count() == 1


def test_counters_expire_and_sets_turn_into_sketches(spark):
    inc = spark.createDataFrame([("h", "a", 0, 1, 1, 100), ("h", "a", 50, 1, 2, None), ("h", "b", 0, 1, 1, 10), ("h", "b", 5, 1, 2, 1000), ("h", "c", 0, 1, 1, None)], "family string, key string, ts_ms bigint, amount bigint, seq bigint, ttl_ms bigint")
    left = {r["key"] for r in counters.alive(counters.buckets(inc), inc, 100).collect()}
    assert left == {"b", "c"}
    rnd = random.Random(1)
    rows = [("s", i % 50, f"v{rnd.randrange(3000)}") for i in range(20_000)] + [("t", 1, "x"), ("t", 2, "x"), ("t", 2, None)]
    got = {r["key"]: (r["value"], r["sketched"]) for r in counters.distinct_mixed(spark.createDataFrame(rows, "key string, ts_ms bigint, value string"), 0, 60, 10, 1000).collect()}
    exact = len({r[2] for r in rows[:20_000]})
    assert got["t"] == (1, False) and got["s"][1] and abs(got["s"][0] - exact) < 0.05 * exact
    p = spark.createDataFrame([("k", i, "1", i) for i in range(5)], "key string, ts_ms bigint, value string, seq bigint")
    assert [tuple(r) for r in series.refused(p.limit(3), p, 4).collect()] == [("k", 5)] and series.refused(None, p, 5).count() == 0
