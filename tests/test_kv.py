import random

from tidemark.operators import kv

LOG = "key string, seq bigint, now_ms bigint, verb string, value string, number bigint, stop bigint"


class Plain:
    """A store that runs one command at a time, written apart from the operators."""

    def __init__(self):
        self.data, self.until = {}, {}

    def run(self, key, now, verb, value, number, stop):
        if key in self.until and self.until[key] <= now:
            self.data.pop(key, None), self.until.pop(key)
        have = self.data.get(key)
        text = lambda v: None if v is None else v.decode("utf-8", "replace")
        arg = (value or "").encode()

        def store(v, ttl=None, keep=False):
            self.data[key] = v
            if ttl is not None:
                self.until[key] = now + ttl
            elif not keep:
                self.until.pop(key, None)

        if verb == "get":
            return text(have)
        if verb == "set" or verb == "setxx" and have is not None:
            store(arg, number)
            return "OK"
        if verb == "setxx":
            return None
        if verb == "setnx":
            if have is None:
                store(arg)
            return "01"[have is None]
        if verb in ("setkeep", "getset"):
            store(arg, keep=True)
            return "OK" if verb == "setkeep" else text(have)
        if verb == "getdel" or verb == "del":
            self.data.pop(key, None), self.until.pop(key, None)
            return text(have) if verb == "getdel" else "01"[have is not None]
        if verb in ("getex", "expire"):
            if have is not None and (number is not None or verb == "expire"):
                self.until[key] = now + (number or 0)
            return text(have) if verb == "getex" else "01"[have is not None]
        if verb == "append":
            store((have or b"") + arg, keep=True)
            return str(len(self.data[key]))
        if verb == "incrby":
            try:
                n = int(have or b"0") + (number or 0)
            except ValueError:
                return "ERR not an integer"
            if not -(2**63) <= n < 2**63:
                return "ERR overflow"
            store(b"%d" % n, keep=True)
            return str(n)
        if verb == "incrbyfloat":
            try:
                x = float(have or b"0") + float(arg)
            except ValueError:
                return "ERR not a float"
            store(f"{x:.17g}".encode(), keep=True)
            return f"{x:.17g}"
        if verb == "exists":
            return "01"[have is not None]
        if verb == "ttl":
            return "-2" if have is None else str(self.until[key] - now) if key in self.until else "-1"
        if verb == "strlen":
            return str(len(have or b""))
        if verb == "getrange":
            h, n = have or b"", len(have or b"")
            at = [i for i in range(n) if ((number or 0) + n if (number or 0) < 0 else number or 0) <= i <= ((stop if stop is not None else -1) + n if (stop if stop is not None else -1) < 0 else stop)]
            return text(bytes(h[i] for i in at))
        buffer = bytearray(have or b"")
        if arg:
            at = number or 0
            buffer += b"\0" * max(0, at + len(arg) - len(buffer))
            buffer[at : at + len(arg)] = arg
            store(bytes(buffer), keep=True)
        return str(len(buffer))


def test_replay_against_a_plain_store(spark):
    rnd = random.Random(3)
    rows = []
    for seq in range(6000):
        rows.append((f"k{rnd.randrange(60)}", seq, seq * 2, rnd.choice(sorted(kv.VERBS)), rnd.choice(["5", "x", "é", "", None, "12.5", "9223372036854775807"]), rnd.choice([None, 0, 3, 40, 90]), rnd.choice([None, -1, 2, -9])))
    plain = Plain()
    want = {r[1]: plain.run(r[0], r[2], r[3], r[4], r[5], r[6]) for r in rows}
    got = {r["seq"]: r["reply"] for r in kv.replay(spark.createDataFrame(rows, LOG).repartition(6)).collect()}
    assert got == want
    assert kv.replay(spark.createDataFrame([], LOG)).count() == 0


def test_string_state_keeps_what_is_left_of_an_expiry(spark):
    rnd = random.Random(4)
    rows, plain = [], Plain()
    for seq in range(3000):
        key, ttl, gone = f"k{rnd.randrange(200)}", rnd.choice([None, None, 30, 4000]), rnd.random() < 0.1
        rows.append((key, seq, seq, f"v{seq}", ttl, gone))
        if gone:
            plain.run(key, seq, "del", None, None, None)
        else:
            plain.run(key, seq, "setkeep", f"v{seq}", None, None)
            if ttl is not None:
                plain.run(key, seq, "expire", None, ttl, None)
    state = kv.strings(spark.createDataFrame(rows, "key string, seq bigint, now_ms bigint, value string, ttl_ms bigint, deleted boolean"))
    got = {r["key"]: (r["value"], r["expires_at_ms"]) for r in state.collect()}
    assert got == {k: (v.decode(), plain.until.get(k)) for k, v in plain.data.items()}


def test_increments_meet_their_bounds_in_order(spark):
    big = 2**62
    rows = [("a", 1, big), ("a", 2, big), ("a", 3, -big), ("b", 1, None), ("b", 2, 7), ("c", 1, -big), ("c", 2, -big), ("c", 3, -1), ("c", 4, 5)]
    df = spark.createDataFrame(rows, "key string, seq bigint, increment bigint")
    assert {r["key"]: int(r["value"]) for r in kv.incremented(df, ["key"]).collect()} == {"a": 2**63 - 1 - big, "b": 7, "c": -(2**63) + 5}
    assert {r["key"]: int(r["value"]) for r in kv.incremented(df, ["key"], overflow="refuse").collect()} == {"a": 0, "b": 7, "c": -(2**63) + 5}
    assert kv.incremented(df.limit(0), ["key"]).count() == 0


def test_names_pages_and_members(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    as_dict = lambda df: {r["key"]: r["value"] for r in df.collect()}
    assert as_dict(kv.rename(state, "a", "b")) == {"b": 1} and as_dict(kv.rename(state, "a", "b", replace=False)) == {"a": 1, "b": 2}
    assert as_dict(kv.rename(state, "x", "b")) == {"a": 1, "b": 2} and as_dict(kv.copy(state, "a", "c")) == {"a": 1, "b": 2, "c": 1}
    assert as_dict(kv.copy(state, "a", "a")) == {"a": 1, "b": 2} and as_dict(kv.copy(state, "a", "b", replace=True)) == {"a": 1, "b": 1}
    members = spark.createDataFrame([("s", i % 700) for i in range(2000)] + [("t", None), ("t", 3)], "key string, member int")
    pages = sorted((r["key"], r["page"], len(r["members"])) for r in kv.member_pages(members, 300).collect())
    assert pages == [("s", 0, 300), ("s", 1, 300), ("s", 2, 100), ("t", 0, 1)]
    assert [(r["place"], r["member"]) for r in kv.some_members(members.filter("key = 't' and member is not null"), -3).orderBy("place").collect()] == [(1, 3), (2, 3), (3, 3)]
