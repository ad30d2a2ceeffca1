import json
import random

from tidemark.operators import nested


def brute(seq, payload):
    try:
        j = json.loads(payload)
    except (TypeError, ValueError):
        return []
    if not isinstance(j, dict):
        return []
    out = []

    def listed(v):
        return [(i, x) for i, x in enumerate(v if isinstance(v, list) else [v]) if x is not None]

    def root(name):
        v = j.get(name)
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                v = None
        return v

    e, b, r = root("envelope"), root("memory_layer_budget"), root("selected_refs")
    if isinstance(e, dict):
        for i, m in listed(e.get("messages")):
            out.append((seq, "message", f"{i}"))
            out += [(seq, "attachment", f"{i}/{k}") for k, _ in listed(m.get("attachments") if isinstance(m, dict) else None)]
    if isinstance(b, dict):
        out += [(seq, "budget", f"{k}/{x}") for k, v in b.items() if isinstance(v, dict) for x, y in v.items() if y is not None]
    for i, m in listed(r):
        out.append((seq, "ref", f"{i}"))
        out += [(seq, "term", f"{i}/{k}") for k, _ in listed(m.get("matched_index_terms") if isinstance(m, dict) else None)]
    return out


def value(rnd, depth):
    kind = rnd.randrange(9 if depth else 5)
    if kind == 0:
        return None
    if kind == 1:
        return rnd.choice([0, -1.5, True, 10**20])
    if kind < 5:
        return rnd.choice(["", "a\"b", "back\\slash", "{[,:]}", "\\\"", "ünï ", '{"messages": [1, null]}', "[null, 2]"])
    if kind < 7:
        return [value(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return {rnd.choice(["messages", "attachments", "matched_index_terms", "a", "b\"c", "d:e", "kéy"]): value(rnd, depth - 1) for _ in range(rnd.randrange(4))}


def payloads(n=400):
    rnd = random.Random(5)
    out = [None, "", "{}", "[1]", "null", "{", '{"envelope": {}} x', '{"a": 1,}', " {\"selected_refs\": [ ]} ", '{"selected_refs":[[1,2],{"matched_index_terms":null}]}']
    for _ in range(n):
        doc = {k: value(rnd, 4) for k in ("envelope", "memory_layer_budget", "selected_refs", "other") if rnd.random() < 0.8}
        if rnd.random() < 0.2 and "envelope" in doc:
            doc["envelope"] = json.dumps(doc["envelope"])
        text = json.dumps(doc, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 2]))
        out.append(text if rnd.random() < 0.9 else text[: rnd.randrange(len(text))])
    return out


def test_matches_a_plain_parser():
    texts = payloads()
    got = sorted(r[:3] for r in nested._shred(list(range(len(texts))), texts))
    assert got == sorted(x for i, p in enumerate(texts) for x in brute(i, p))


def test_values_are_the_json_of_the_child():
    text = json.dumps({"envelope": {"messages": [{"text": "x", "attachments": {"raw_uri": "u"}}]}})
    rows = {r[1]: json.loads(r[4]) for r in nested._shred([1], [text])}
    assert rows == {"message": {"text": "x", "attachments": {"raw_uri": "u"}}, "attachment": {"raw_uri": "u"}}


def test_long_lists_and_clashing_columns(spark):
    long = json.dumps({"selected_refs": [{"matched_index_terms": ["t"] * 3}] * 20_000})
    df = spark.createDataFrame([(1, long, "c"), (None, '{"selected_refs": 1}', "c"), (3, None, "c")], "seq bigint, payload string, child string")
    assert nested.children(df).count() == 80_001
    assert nested.children(df.limit(0)).count() == 0
    assert nested.child_table(df, "ref").filter("seq is null").count() == 1


def no_constant(x):
    raise ValueError(x)


def test_the_index_knows_whole_json():
    rnd = random.Random(6)
    seeds = ['{"a": [1, -2.5e+3, true, null, {"b": {}}], "c\\u00e9\\"": "x\\\\", "d": []}', "[]", ' [[], {"a": NaN}, -Infinity] ', '"s"', "0", "", "{}", '{"a":1,}', "[1,]", "[,]", '{"a"}', "[1 2]", "]", "{}}", '{"a":1 "b":2}', "[1}", '{"a"::1}', "01", "1.", "\u00a01", '"\t"', '{1:2}', '{,}', "1,", ",", ":", '{"a":}', '["a":1]', "[[1],[2]]{}", "\\", '"\\', '{"a":"b" "c"}', '{"a":["b","c":1]}', "\ufeff{}", '"\\ud800"', '"\\u12"', "\x0c1", "[1]\n[2]"]
    texts = list(seeds)
    for _ in range(30_000):
        t = list(rnd.choice(seeds))
        for _ in range(rnd.randrange(1, 4)):
            k = rnd.randrange(len(t) + 1)
            t[k : k + rnd.randrange(2)] = rnd.choice(['{', '}', '[', ']', ',', ':', '"', "\\", "1", "-", " ", "e", ".", "\n", "u"])
        texts.append("".join(t))
    found = nested.StructuralIndex([t.encode() for t in texts]).whole
    for t, got in zip(texts, found):
        try:
            json.loads(t, parse_constant=no_constant)
            want = True
        except ValueError:
            want = False
        assert got == want, t


def test_half_a_surrogate_pair_and_no_number(spark):
    rows = [(1, '{"memory_layer_budget": {"b": {"\\ud800": 1, "x\\ud83d\\ude00": 2}}}'), (2, '{"selected_refs": [1], "x": NaN}'), (3, '{"selected_refs": "[1, Infinity]"}')]
    got = nested.children(spark.createDataFrame(rows, "seq bigint, payload string")).collect()
    assert sorted((r["seq"], r["child_key"]) for r in got) == [(1, "b/x\U0001f600"), (1, "b/\ufffd")]


def test_deep_payloads_have_their_children(spark):
    deep = 30_000
    part = '{"k":[' * deep + "1, 2" + "]}" * deep
    rest = '"envelope": {"messages": [{"attachments": [1, ' + part + "]}, 2]}"
    refs = json.dumps('[{"matched_index_terms": ["t", ' + part + "]}]")
    rows = [(1, '{"other": ' + part + ", " + rest + "}"), (2, '{"other": ' + part + "], " + rest + "}"), (3, "[" + part + "]"), (4, '{"selected_refs": ' + refs + "}"), (5, '{"selected_refs": ' + refs.replace("1, 2", "1, ", 1) + ", " + rest + "}")]
    got = sorted((r["seq"], r["child"], r["child_key"]) for r in nested.children(spark.createDataFrame(rows, "seq bigint, payload string")).select("seq", "child", "child_key").collect())
    envelope = [("attachment", "0/0"), ("attachment", "0/1"), ("message", "0"), ("message", "1")]
    assert got == [(1, *x) for x in envelope] + [(4, "ref", "0"), (4, "term", "0/0"), (4, "term", "0/1")] + [(5, *x) for x in envelope]
