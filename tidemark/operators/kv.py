"""Key-value, hash and set state out of an append-only command log.

A log has ``seq`` (total order per key), ``now_ms`` and the columns of its kind. State is what the log leaves behind: the last write
per key or field that no later delete covers. All of it is one keyed aggregate with map-side combine; nothing is replayed row by row
unless the result of a command depends on the ones before it (:func:`replay`, :func:`conditional`). Key states have ``key, value, seq,
expires_at_ms``; verbs that read or change them are expressions over that state.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import glob
from tidemark.operators import ordered
from tidemark.runtime import cut, repartition_for


def latest(log: DataFrame, keys: list[str], deleted: str | None = None, seq: str = "seq") -> DataFrame:
    """The last row of each key; keys whose last row is a tombstone (BOOLEAN ``deleted``) are gone."""
    rest = [c for c in log.columns if c not in keys]
    out = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, *(F.col("r")[c].alias(c) for c in rest)).select(*log.columns)
    return out.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def if_absent(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Set-if-absent writes: the first row of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, *(F.col("r")[c].alias(c) for c in rest)).select(*log.columns)


def strings(log: DataFrame) -> DataFrame:
    """String state ``key, seq, value, expires_at_ms`` out of ``key, seq, now_ms, value, ttl_ms, deleted``.

    A write without ttl keeps the expiry its key has, unless that has passed when it is written; a write with ttl sets it; a delete takes both.
    Two keyed maxima in one aggregate: the last row of the key, and the last row that settles the expiry (a delete or a ttl)."""
    last = F.max_by(F.struct("seq", "now_ms", "value", "ttl_ms", "deleted"), "seq").alias("l")
    settles = F.coalesce("deleted", F.lit(False)) | F.col("ttl_ms").isNotNull()
    marked = F.max_by(F.struct("now_ms", "ttl_ms", "deleted"), F.when(settles, F.col("seq"))).alias("e")
    until = F.when(~F.coalesce("e.deleted", F.lit(False)), F.col("e.now_ms") + F.col("e.ttl_ms"))
    out = log.groupBy("key").agg(last, marked).filter(~F.coalesce("l.deleted", F.lit(False)))
    return out.select("key", "l.seq", "l.value", F.when(F.col("l.ttl_ms").isNotNull() | (until > F.col("l.now_ms")), until).alias("expires_at_ms"))


def strings(log: DataFrame) -> DataFrame:
    """String state ``key, seq, value, expires_at_ms`` out of ``key, seq, now_ms, value, ttl_ms, deleted``.

    A write without ttl keeps the expiry its key has, unless that has passed when it is written; a write with ttl sets it; a delete takes both.
    Two keyed maxima in one aggregate: the last row of the key, and the last row that settles the expiry (a delete or a ttl)."""
    gone = F.coalesce(F.col("deleted"), F.lit(False))
    last = F.max_by(F.struct("seq", "now_ms", "value", "ttl_ms", gone.alias("deleted")), "seq").alias("l")
    settled = F.max_by(F.struct(gone.alias("deleted"), (F.col("now_ms") + F.col("ttl_ms")).alias("until")), F.when(gone | F.col("ttl_ms").isNotNull(), F.col("seq"))).alias("e")
    out = log.groupBy("key").agg(last, settled).filter(~F.col("l.deleted"))
    until = F.when(~F.col("e.deleted") & (F.col("l.ttl_ms").isNotNull() | (F.col("e.until") > F.col("l.now_ms"))), F.col("e.until"))
    return out.select("key", "l.seq", "l.value", until.alias("expires_at_ms"))


def live(state: DataFrame, now_ms: int, expires: str = "expires_at_ms") -> DataFrame:
    """Rows that have not expired at ``now_ms``."""
    return state.filter(F.col(expires).isNull() | (F.col(expires) > now_ms))


def ttl(keys: DataFrame, state: DataFrame, now_ms: int) -> DataFrame:
    """``key, ttl_ms`` of requested keys: -2 for none, -1 without expiry, else what remains."""
    s = live(state, now_ms).select("key", F.col("expires_at_ms").alias("_e"), F.lit(True).alias("_there"))
    return keys.join(s, "key", "left").select("key", F.when(F.col("_there").isNull(), -2).when(F.col("_e").isNull(), -1).otherwise(F.col("_e") - now_ms).cast("bigint").alias("ttl_ms"))


def ttl_seconds(ttl_ms: Column) -> Column:
    """Remaining time in seconds, rounded up; the negative marks stay."""
    return F.when(ttl_ms < 0, ttl_ms).otherwise(F.floor((ttl_ms + 999) / 1000)).cast("bigint")


def expire_time(keys: DataFrame, state: DataFrame, now_ms: int, unit_ms: int = 1000) -> DataFrame:
    """``key, at``: when each key expires in units of ``unit_ms`` since the epoch, rounded down; -2 for no key, -1 without expiry."""
    left = F.col("ttl_ms")
    return ttl(keys, state, now_ms).select("key", F.when(left < 0, left).otherwise(F.floor((left + now_ms) / unit_ms)).cast("bigint").alias("at"))


def sweep(state: DataFrame, now_ms: int, cursor: str | None = None, limit: int | None = None) -> DataFrame:
    """Tombstones ``key, expired_at_ms`` of keys that have expired at ``now_ms``, in key order after ``cursor``, at most ``limit`` a pass (None for all)."""
    due = state.filter(F.col("expires_at_ms") <= now_ms)
    due = due if cursor is None else due.filter(F.col("key") > cursor)
    out = due.select("key", F.col("expires_at_ms").alias("expired_at_ms"))
    return out if limit is None else out.orderBy("key").limit(limit)


def key_type(keys: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """``key, type``: the first of the models (name to a DataFrame with ``key``) that holds each key, else none."""
    parts = [rows.select("key", F.lit(i).alias("i"), F.lit(name).alias("type")) for i, (name, rows) in enumerate(models.items())]
    first = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.min_by("type", "i").alias("type"))
    return keys.join(first, "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))


def touch(requests: DataFrame, state: DataFrame) -> DataFrame:
    """``req_id, n``: how many of the keys (ARRAY ``keys``, repeats count again) of each request exist."""
    asked = requests.select("req_id", F.explode_outer("keys").alias("key"))
    return asked.join(state.select("key").distinct().withColumn("_x", F.lit(1)), "key", "left").groupBy("req_id").agg(F.count("_x").alias("n"))


def get_del(keys: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``key, value`` of the keys, null where absent; the state without them)."""
    return keys.join(state.select("key", "value"), "key", "left").select("key", "value"), state.join(keys.select("key").distinct(), "key", "left_anti")


def get_ex(keys: DataFrame, state: DataFrame, now_ms: int, ttl_ms: int | None) -> tuple[DataFrame, DataFrame]:
    """(``key, value`` of the keys; the state with their new expiry, unchanged for a ttl of None)."""
    got = keys.join(live(state, now_ms).select("key", "value"), "key", "left").select("key", "value")
    return got, state if ttl_ms is None else expire(state, keys, now_ms, ttl_ms)


def set_many_if_absent(requests: DataFrame, state: DataFrame) -> DataFrame:
    """``requests`` (``req_id, key, value``) plus ``applied``: all writes of a request apply if none of its keys exists, else none. Every request
    meets the same state."""
    there = state.select("key").distinct().withColumn("_x", F.lit(1))
    taken = requests.join(there, "key", "left").groupBy("req_id").agg(F.count("_x").alias("_n"))
    return requests.join(taken, "req_id").withColumn("applied", F.col("_n") == 0).drop("_n")


def random_key(state: DataFrame) -> DataFrame:
    """``key``: the first key in order, so that the answer is always the same; null if there is none."""
    return state.agg(F.min("key").alias("key"))


def flush(state: DataFrame) -> DataFrame:
    """The state after all keys are gone."""
    return state.filter(F.lit(False))


def expire(state: DataFrame, keys: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """The state with a new expiry on those of the keys that exist."""
    hit = keys.select("key").distinct().withColumn("_hit", F.lit(True))
    return state.join(hit, "key", "left").withColumn(
        "expires_at_ms", F.when(F.col("_hit") & (F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms)), F.lit(now_ms + ttl_ms)).otherwise(F.col("expires_at_ms"))).drop("_hit")


def exists(keys: DataFrame, state: DataFrame, now_ms: int | None = None) -> DataFrame:
    """``key, exists``; with ``now_ms`` an expired key does not."""
    state = state if now_ms is None else live(state, now_ms)
    return keys.join(state.select("key").distinct().withColumn("_x", F.lit(True)), "key", "left").select("key", F.coalesce("_x", F.lit(False)).alias("exists"))


def multi_get(requests: DataFrame, state: DataFrame, field: str | None = None) -> DataFrame:
    """``req_id, values``: for each request (``req_id``, ``keys`` ARRAY, or ``key`` and ``fields``) the values in request order, null where absent."""
    if field is None:
        asked = requests.select("req_id", F.posexplode("keys").alias("pos", "key"))
        on = ["key"]
    else:
        asked = requests.select("req_id", "key", F.posexplode("fields").alias("pos", field))
        on = ["key", field]
    got = asked.join(state.select(*on, "value"), on, "left")
    return got.groupBy("req_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("values"))


def conditional(log: DataFrame) -> DataFrame:
    """Set commands with a condition (``always``, ``exists``, ``absent``, or ``delete``), in order: the log with ``applied`` and the ``old``
    value each command found. A fold over sorted rows that carries only the current key's value."""
    types = ", ".join(f"`{c}` {t}" for c, t in log.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, value = None, None
        for b in batches:
            applied, old = [], []
            for k, v, c in zip(b.column("key").to_pylist(), b.column("value").to_pylist(), b.column("condition").to_pylist()):
                if k != current:
                    current, value = k, None
                old.append(value)
                ok = c in (None, "always") or c == "delete" or (c == "exists") == (value is not None)
                applied.append(ok)
                if ok:
                    value = None if c == "delete" else v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(applied, pa.bool_()), pa.array(old, pa.string())], names=[*b.schema.names, "applied", "old"])

    return repartition_for(log, "key").sortWithinPartitions("key", "seq").mapInArrow(run, f"{types}, applied boolean, old string")


def get_set(log: DataFrame) -> DataFrame:
    """Each write with the value it replaced (``old``)."""
    return ordered.lagged(log, ["key"], ["seq"], F.col("value"), "old")


INT64 = 2**63 - 1


def incremented(log: DataFrame, keys: list[str], amount: str = "increment", seq: str = "seq", overflow: str = "saturate") -> DataFrame:
    """``keys..., value``: counters as decimal text, in 64 bits. An increment that leaves the range saturates, or with ``refuse`` is not
    applied. Increments that are no integers add nothing.

    Where the absolute amounts of a key stay in range no order can overflow, and the plain sum is the answer; only keys whose amounts could leave it are
    added up in order."""
    if overflow not in ("saturate", "refuse"):
        raise ValueError(overflow)
    rows = log.withColumn("_a", F.coalesce(F.col(amount).try_cast("bigint"), F.lit(0)))
    sums = rows.groupBy(*keys).agg(F.sum(F.col("_a").cast("decimal(19,0)")).alias("_s"), F.sum(F.abs(F.col("_a").cast("decimal(19,0)"))).alias("_abs"))
    safe = sums.filter(F.col("_abs") <= INT64).select(*keys, F.col("_s").cast("string").alias("value"))
    wide = F.broadcast(sums.filter(F.col("_abs") > INT64).select(*keys))
    types = dict(log.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", value string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, out = None, 0, []
        for b in batches:
            for *k, a in zip(*(b.column(c).to_pylist() for c in (*keys, "_a"))):
                if k != current:
                    if current is not None:
                        out.append((*current, str(total)))
                    current, total = k, 0
                new = total + a
                if -INT64 - 1 <= new <= INT64:
                    total = new
                elif overflow == "saturate":
                    total = INT64 if new > 0 else -INT64 - 1
        if current is not None:
            out.append((*current, str(total)))
        if out:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, b.schema.field(k).type) for k, c in zip(keys, zip(*out))), pa.array([o[-1] for o in out])], names=[*keys, "value"])

    narrow = rows.join(wide, keys, "left_semi").select(*keys, seq, "_a")
    return safe.unionByName(repartition_for(narrow, *keys).sortWithinPartitions(*keys, seq).mapInArrow(fold, schema))


def incremented_float(log: DataFrame, keys: list[str], amount: str = "increment", seq: str = "seq") -> DataFrame:
    """``keys..., value`` DOUBLE: sums of floating-point increments; nulls add nothing."""
    return log.groupBy(*keys).agg(F.coalesce(F.sum(F.col(amount).cast("double")), F.lit(0.0)).alias("value"))


def appended(log: DataFrame, seq: str = "seq") -> DataFrame:
    """``key, value``: what appends in order leave; null parts add nothing. A value is one row, so its parts must meet in one task."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.coalesce("value", F.lit("")).alias("v"))))
    return log.groupBy("key").agg(F.array_join(F.transform(parts, lambda x: x["v"]), "").alias("value"))


#: Verbs that :func:`replay` knows: what they take beside the key.
VERBS = {
    "get": "", "set": "value, number (ttl ms or null)", "setnx": "value", "setxx": "value, number (ttl ms or null)", "setkeep": "value", "getset": "value", "getdel": "", "getex": "number (ttl ms or null)",
    "append": "value", "incrby": "number", "incrbyfloat": "value", "del": "", "exists": "", "expire": "number (ttl ms)", "ttl": "", "strlen": "", "getrange": "number, stop", "setrange": "number, value",
}


def _slice(raw: bytes, start: int, stop: int) -> bytes:
    """Bytes from start to stop inclusive; negative positions count from the end."""
    n = len(raw)
    start, stop = max(start + n if start < 0 else start, 0), stop + n if stop < 0 else stop
    return raw[start : stop + 1] if 0 <= stop and start < n else b""


class _Cell:
    """One key's value and expiry, and what each verb does to them."""

    def __init__(self):
        self.value: bytes | None = None
        self.until: int | None = None

    def run(self, verb: str, now: int, value: str | None, number: int | None, stop: int | None):
        if self.until is not None and self.until <= now:
            self.value = self.until = None
        return getattr(self, verb)(now, (value or "").encode(), number, stop)

    def put(self, value: bytes | None, until: int | None) -> None:
        self.value, self.until = value, until

    def get(self, now, value, number, stop):
        return self.value

    def set(self, now, value, number, stop):
        self.put(value, None if number is None else now + number)
        return b"OK"

    def setnx(self, now, value, number, stop):
        if self.value is not None:
            return b"0"
        self.put(value, None)
        return b"1"

    def setxx(self, now, value, number, stop):
        return None if self.value is None else self.set(now, value, number, stop)

    def setkeep(self, now, value, number, stop):
        self.value = value
        return b"OK"

    def getset(self, now, value, number, stop):
        old, self.value = self.value, value
        return old

    def getdel(self, now, value, number, stop):
        old = self.value
        self.put(None, None)
        return old

    def getex(self, now, value, number, stop):
        if self.value is not None and number is not None:
            self.until = now + number
        return self.value

    def append(self, now, value, number, stop):
        self.value = (self.value or b"") + value
        return str(len(self.value)).encode()

    def incrby(self, now, value, number, stop):
        try:
            new = int(self.value or b"0") + (number or 0)
        except ValueError:
            return b"ERR not an integer"
        if not -INT64 - 1 <= new <= INT64:
            return b"ERR overflow"
        self.value = str(new).encode()
        return self.value

    def incrbyfloat(self, now, value, number, stop):
        try:
            self.value = f"{float(self.value or b'0') + float(value):.17g}".encode()
        except ValueError:
            return b"ERR not a float"
        return self.value

    def exists(self, now, value, number, stop):
        return b"0" if self.value is None else b"1"

    def expire(self, now, value, number, stop):
        if self.value is None:
            return b"0"
        self.until = now + (number or 0)
        return b"1"

    def ttl(self, now, value, number, stop):
        return b"-2" if self.value is None else b"-1" if self.until is None else str(self.until - now).encode()

    def strlen(self, now, value, number, stop):
        return str(len(self.value or b"")).encode()

    def getrange(self, now, value, number, stop):
        return _slice(self.value or b"", number or 0, -1 if stop is None else stop)

    def setrange(self, now, value, number, stop):
        raw, at = self.value or b"", number or 0
        if value:
            self.value = raw[:at].ljust(at, b"\0") + value + raw[at + len(value) :]
        return str(len(self.value or b"")).encode()


def _del(cell, now, value, number, stop):
    there = cell.value is not None
    cell.put(None, None)
    return b"1" if there else b"0"


setattr(_Cell, "del", _del)


def replay(log: DataFrame) -> DataFrame:
    """``log`` (``key, seq, now_ms, verb, value, number, stop``) plus ``reply`` (text, null for nil): string commands one after another per key,
    with expiry as they meet it. An unknown verb is an error. Bytes that are no UTF-8 come out as U+FFFD.

    What a command finds depends on all before it on its key, so a key is one sequence: rows stream through in order and one value is held. Where only the
    state counts, :func:`strings`, :func:`incremented` and the like split hot keys."""
    types = ", ".join(f"`{c}` {t}" for c, t in log.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cell = None, _Cell()
        for b in batches:
            replies = []
            for k, *args in zip(*(b.column(c).to_pylist() for c in ("key", "verb", "now_ms", "value", "number", "stop"))):
                if k != current:
                    current, cell = k, _Cell()
                if args[0] not in VERBS:
                    raise ValueError(f"unknown verb {args[0]!r}")
                reply = cell.run(*args)
                replies.append(None if reply is None else reply.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string())], names=[*b.schema.names, "reply"])

    return repartition_for(log, "key").sortWithinPartitions("key", "seq").mapInArrow(run, f"{types}, reply string")


def hash_map(state: DataFrame) -> DataFrame:
    """``key, fields``: all fields of each hash as a sorted map. A hash is one row here; :func:`hash_pages` has no such bound."""
    return state.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hash_pages(state: DataFrame, size: int = 1_000) -> DataFrame:
    """``key, page, fields``: the fields of each hash in order, in maps of ``size``."""
    paged = _paged(state.select("key", F.col("field").alias("member"), "value"), size)
    return paged.groupBy("key", "page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("member").alias("field"), "value")))).alias("fields"))


def field_exists(requests: DataFrame, state: DataFrame) -> DataFrame:
    """``requests`` (``key, field``) with ``exists`` and ``length``, the value's bytes (0 where absent)."""
    return requests.join(state.select("key", "field", F.octet_length("value").alias("_n"), F.lit(True).alias("_x")), ["key", "field"], "left").select(
        *requests.columns, F.coalesce("_x", F.lit(False)).alias("exists"), F.coalesce("_n", F.lit(0)).alias("length"))


def removed(state: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the state without the ``gone`` fields or members; per key how many there were to remove)."""
    hit = gone.select(*keys).distinct()
    n = state.join(hit, keys, "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return state.join(hit, keys, "left_anti"), gone.select("key").distinct().join(n, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def scan_within(state: DataFrame, item: str, pattern: str, cursor: int, count: int) -> DataFrame:
    """``state`` cut to one page of each key's items (fields or members) that match, with ``position``; the cursor is an offset into the sorted matches."""
    at = F.row_number().over(W.partitionBy("key").orderBy(item)) - 1
    hits = state.filter(F.col(item).cast("string").rlike(glob(pattern))).withColumn("position", at.cast("bigint"))
    return hits.filter((F.col("position") >= cursor) & (F.col("position") < cursor + count))


def members(state: DataFrame) -> DataFrame:
    """``key, members`` sorted. Each whole set is one array in one task; :func:`member_pages` has no such bound."""
    return state.groupBy("key").agg(F.array_sort(F.collect_set("member")).alias("members"))


def member_pages(state: DataFrame, size: int = 1_000) -> DataFrame:
    """``key, page, members``: all members of each set, once each and sorted, in pages (from 0) of ``size``, the last one shorter.
    Null members are left out, as :func:`members` does."""
    paged = _paged(state.filter("member is not null").select("key", "member").distinct(), size)
    return paged.groupBy("key", "page").agg(F.array_sort(F.collect_list("member")).alias("members"))


def _paged(once: DataFrame, size: int) -> DataFrame:
    """Distinct ``key, member, ...`` plus ``page``. Members are range-partitioned, and a slice's own positions are moved by the counts of the slices
    before it, so a key is spread over as many tasks as it needs."""
    slices = int(once.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(once.repartitionByRange(slices, "key", "member").withColumn("_slice", F.spark_partition_id()))
    counts = placed.groupBy(F.col("key").alias("_k"), F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("_k").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(W.partitionBy("key", "_slice").orderBy("member")) - 1
    at = placed.withColumn("_inner", inner).join(before, F.col("key").eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")))
    return at.select(*once.columns, F.floor((F.col("_inner") + F.col("_before")) / size).alias("page"))


def is_member(requests: DataFrame, state: DataFrame) -> DataFrame:
    """``requests`` (``key, member``, any others) with ``is_member``."""
    return requests.join(state.select("key", "member", F.lit(True).alias("_x")).distinct(), ["key", "member"], "left").select(*requests.columns, F.coalesce("_x", F.lit(False)).alias("is_member"))


def some_members(state: DataFrame, count: int) -> DataFrame:
    """``key, place, member``: the first ``count`` members of each set in order; a negative count gives as many rows, going round the set again where it is smaller."""
    first = pop(state.select("key", "member").distinct(), abs(count))[0]
    placed = first.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("member")))
    if count >= 0:
        return placed.select("key", F.col("place").cast("bigint"), "member")
    n = F.count(F.lit(1)).over(W.partitionBy("key"))
    again = placed.withColumn("_n", n).withColumn("place", F.explode(F.sequence(F.col("place"), F.lit(-count), F.greatest(F.col("_n").cast("int"), F.lit(1)))))
    return again.select("key", F.col("place").cast("bigint"), "member")


def set_algebra(sets: list[DataFrame], op: str) -> DataFrame:
    """Union, intersection or difference (folded from the left) of one-column sets, as joins on the members."""
    step = {"union": lambda a, b: a.union(b).distinct(), "inter": lambda a, b: a.intersect(b), "diff": lambda a, b: a.subtract(b)}[op]
    return reduce(step, sets[1:], sets[0].distinct())


def scan(keys: DataFrame, pattern: str, cursor: int, count: int) -> DataFrame:
    """``key, position`` of one page of the sorted keys that match; the cursor is an offset into them."""
    hits = keys.filter(F.col("key").rlike(glob(pattern))).select("key").distinct().orderBy("key").offset(cursor).limit(count)
    return hits.withColumn("position", F.lit(cursor).cast("bigint") + F.row_number().over(W.orderBy("key")) - 1)  # one page, a bounded result


def rename(state: DataFrame, old: str, new: str, replace: bool = True) -> DataFrame:
    """The state with ``old`` under the name ``new``; what ``new`` held is gone. Nothing changes if ``old`` does not exist or, without ``replace``, ``new`` does."""
    return copy(state, old, new, replace, True)


def copy(state: DataFrame, old: str, new: str, replace: bool = False, move: bool = False) -> DataFrame:
    """The state with ``old`` also (``move``: only) under the name ``new``. Nothing changes if ``old`` does not exist or, without ``replace``, ``new`` does."""
    held = state.filter(F.col("key").isin(old, new)).agg(F.bool_or(F.col("key") == old), F.bool_or(F.col("key") == new)).first()
    if not held[0] or old == new or (held[1] and not replace):
        return state
    named = F.when(F.col("key") == old, F.array(*map(F.lit, [new] if move else [old, new]))).otherwise(F.array("key"))
    return state.filter(F.col("key") != new).withColumn("key", F.explode(named)).select(*state.columns)


def pop(state: DataFrame, count: int, item: str = "member") -> tuple[DataFrame, DataFrame]:
    """(taken, left): the first ``count`` members of each set in sorted order, and the rest."""
    ranked = state.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy(item)))
    return ranked.filter(F.col("_n") <= count).drop("_n"), ranked.filter(F.col("_n") > count).drop("_n")


def move(state: DataFrame, source: str, target: str, member: str) -> DataFrame:
    """The sets with ``member`` moved from one to the other, if it was there."""
    hit = (F.col("key") == source) & (F.col("member") == member)
    return state.withColumn("key", F.when(hit, F.lit(target)).otherwise(F.col("key"))).dropDuplicates(["key", "member"])
