import random

from tidemark.llm import conversations as c

SCHEMA = "session_id string, row_id bigint, ts_ms bigint, role string, content string, part string"


def brute(rows):
    aliases = {a: k for k, v in c.ROLE_ALIASES.items() for a in v}
    sessions = {}
    for s, r, t, role, text, _ in rows:
        if s is not None:
            folded = (role or "").strip().lower()
            key = (t, aliases.get(folded, "?" + folded), text)
            m = sessions.setdefault(s, {})
            m[key] = min(m.get(key, r), r)
    out = set()
    for s, m in sessions.items():
        msgs = sorted((k[0] is not None, k[0] or 0, r, k[1], k[2]) for k, r in m.items())
        turns = [x[3] for x in msgs if x[3] in ("user", "assistant")]
        bad = any(not x[0] for x in msgs) or any(x[3].startswith("?") for x in msgs)
        bad |= any(x[3] in ("user", "assistant") and not (x[4] or "").replace("​", "").strip() for x in msgs)
        bad |= "user" not in turns or turns[0] == "assistant" or turns[-1] == "user" or any(a == b == "user" for a, b in zip(turns, turns[1:]))
        if bad:
            out.add(s)
    return out


def rows(seed, n=1500, hot=0.0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = "hot" if rnd.random() < hot else rnd.choice([None, *(f"s{k}" for k in range(n // 5))])
        role = rnd.choice([" User", "human", "bot", "AI ", "model", "tool-output", "system", "assistant", "user", "assistant"] * 12 + [None, "", "moderator"])
        text = rnd.choice(["a", "b", "c", "d"] * 12 + [None, "", "  \n", "​"])
        out.append((s, i, rnd.choice([*range(12)] * 6 + [None]), role, text, "x"))
    return out


def test_matches_brute_force(spark):
    for seed in range(3):
        data = rows(seed)
        got = {r["session_id"] for r in c.sessions(spark.createDataFrame(data, SCHEMA).repartition(5)).filter("broken").collect()}
        assert got == brute(data)


def test_a_hot_session_spans_partitions(spark):
    data = [("hot", i, i // 2, "user" if i % 2 == 0 else "bot", f"m{i}", "x") for i in range(2000)] + [("t", 1, 1, "user", "q", "x")]
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = {r["session_id"]: r for r in c.sessions(df).collect()}
    assert not got["hot"]["broken"] and got["hot"]["n_messages"] == 2000 and got["t"]["unanswered"]
    turns = c.turns(df).orderBy("position").collect()
    assert [r["row_id"] for r in turns] == list(range(2000)) and [r["position"] for r in turns] == list(range(2000))
    broken = [*data, ("hot", 5000, 700, "user", "extra", "x")]
    assert {r["session_id"] for r in c.sessions(spark.createDataFrame(broken, SCHEMA)).filter("broken").collect()} == {"hot", "t"}
    assert c.sessions(df.limit(0)).count() == 0


def test_kahn_orders_and_finds_cycles():
    assert c.kahn([-1, 0, 0, 1], [(5,), (9,), (1,), (2,)]) == ([0, 2, 1, 3], [])
    assert c.kahn([-1, 2, 1, 2], [(0,)] * 4) == ([0], [1, 2, 3])
    n = 3000
    assert c.kahn([*range(1, n), -1], [(0,)] * n)[0] == list(range(n - 1, -1, -1))


def test_reply_links_rule_the_order_and_cycles_break(spark):
    data = [
        ("a", 1, 10, "user", "q", None), ("a", 2, 5, "bot", "early clock", 1), ("a", 3, 20, "user", "q2", 2), ("a", 4, 20, "bot", "r2", 3),
        ("b", 11, 1, "user", "q", None), ("b", 12, 2, "bot", "r", 13), ("b", 13, 3, "bot", "r", 12), ("d", 21, 1, "user", "q", 999), ("d", 22, 2, "bot", "r", 21),
    ]
    df = spark.createDataFrame(data, "session_id string, row_id bigint, ts_ms bigint, role string, content string, up bigint")
    got = {r["session_id"]: r for r in c.sessions(df, reply_to="up").collect()}
    assert not got["a"]["broken"] and got["b"]["cyclic"] and got["b"]["broken"] and not got["d"]["broken"]
    assert c.sessions(df).filter("session_id = 'a'").first()["broken"]  # by the clock alone the answer comes first


LINKED = "session_id string, row_id bigint, ts_ms bigint, role string, content string, up bigint"


def test_links_through_repeated_rows_and_the_tie_break_of_the_heap(spark):
    data = [
        ("a", 1, 10, "user", "q", None), ("a", 2, 10, "user", "q", None), ("a", 3, 20, "bot", "r", 2),  # names a repeated row
        ("b", 1, 10, "user", "q", None), ("b", 2, 5, "bot", "r", 1), ("b", 3, 10, "user", "p", None), ("b", 4, 6, "bot", "s", 3),
        ("c", 1, 1, "user", "q", None), ("c", 2, 2, "bot", "r", 3), ("c", 3, 3, "tool", "t", 2), ("c", 4, 4, "bot", "r", 1),
    ]
    df = spark.createDataFrame(data, LINKED)
    got = {r["session_id"]: r for r in c.sessions(df, reply_to="up").collect()}
    assert not got["a"]["broken"] and not got["b"]["broken"] and got["c"]["cyclic"] and not got["c"]["bad_ts"] and not got["c"]["unanswered"]
    order = {}
    for r in c.turns(df, reply_to="up").orderBy("session_id", "position").collect():
        order.setdefault(r["session_id"], []).append(r["row_id"])
    assert order == {"a": [1, 3], "b": [1, 2, 3, 4]}


def test_doubled_links_give_kahns_order(spark, monkeypatch):
    rnd = random.Random(5)
    data = []
    for s in range(12):
        n = rnd.randrange(1, 40)
        for i in range(n):
            up = rnd.choice([None, None, *range(n)]) if s % 3 == 0 else None if i == 0 or rnd.random() < 0.2 else rnd.randrange(i)
            data.append((f"s{s}", i, rnd.choice([*range(15)] * 4 + [None]) if s % 4 else rnd.randrange(15), rnd.choice(["user", "bot", "bot", "tool"]), f"{rnd.randrange(30)}", up))
    data += [("deep", i, 500 - i, "user" if i == 0 else "bot", f"m{i}", None if i == 0 else i - 1) for i in range(300)]
    df = spark.createDataFrame(data, LINKED)
    one = sorted(map(tuple, c.sessions(df, reply_to="up").collect()))
    placed = sorted(map(tuple, c.turns(df, reply_to="up").collect()))
    monkeypatch.setattr(c, "LARGE", 0)
    assert sorted(map(tuple, c.sessions(df, reply_to="up").collect())) == one
    assert sorted(map(tuple, c.turns(df, reply_to="up").collect())) == placed
    assert any(r[0] == "deep" for r in placed) and any(r[8] for r in one)
