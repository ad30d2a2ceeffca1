"""Ordered conversations out of message rows.

Every message is a node of its session's reply graph. A message replies to the one it names (``reply_to``); where the data
names none, an assistant or tool message replies to the last user message before it and all others open a thread. Kahn's algorithm,
with (timestamp, row id) as tie-break among the messages that are ready, gives the order; messages it never releases lie on or behind a
cycle. Completeness is then read off the edges: a user message that no assistant message answers lacks its reply, and an
assistant message that answers no user message comes first.

Scale: without named replies, rows are range-partitioned by (session, time, row id), so a session with a third of all rows spans many
tasks. Each task builds and sorts the graph of its segment and reports a constant-size summary; summaries combine in segment order (an
edge crosses a seam only from the assistant messages before a segment's first user message to the last user message before it). With named
replies, a session of up to ``LARGE`` messages is sorted in one task; a larger one is spread over (session, row) and its links are doubled,
which gives the very same order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import cut, repartition_for

#: Most messages of a session whose named replies are sorted in one task.
LARGE = 200_000

#: Role spellings by canonical role, compared trimmed and in lower case (fixed values).
ROLE_ALIASES = {
    "user": ["user", "human", "prompt"],
    "assistant": ["assistant", "agent", "ai", "bot", "llm", "model", "assistant_response"],
    "tool": [
        "tool", "function", "function_call_output", "custom_tool_call_output", "tool_call_output", "tool_result", "tool_output", "tool-output", "tooloutput",
    ],
    "system": ["system"],
}

#: A text of white space only: Unicode white space and the zero-width spaces.
BLANK = r"(?U)\A[\s ​⁠﻿]*\z"


def canonical_role(role: Column) -> Column:
    """The canonical role of a spelling, null for one that is not known."""
    folded = F.lower(F.regexp_replace(role, r"(?U)\A[\s \u200b]+|[\s \u200b]+\z", ""))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, spellings in ROLE_ALIASES.items():
        out = out.when(folded.isin(spellings), name)
    return out


def kahn(parents: list[int], keys: list[tuple]) -> tuple[list[int], list[int]]:
    """(order, leftover) of nodes 0..n-1, each with one parent or -1. Among ready nodes the least key goes first; leftover
    nodes lie on a cycle or reply, directly or not, to one that does."""
    replies: dict[int, list[int]] = {}
    ready = []
    for node, parent in enumerate(parents):
        if parent < 0:
            ready.append((keys[node], node))
        else:
            replies.setdefault(parent, []).append(node)
    heapq.heapify(ready)
    order = []
    while ready:
        _, node = heapq.heappop(ready)
        order.append(node)
        for child in replies.get(node, ()):
            heapq.heappush(ready, (keys[child], child))
    if len(order) == len(parents):
        return order, []
    done = set(order)
    return order, [n for n in range(len(parents)) if n not in done]


def _rows(df: DataFrame, session: str, row: str, ts: str, role: str, content: str, reply_to: str | None) -> DataFrame:
    known = canonical_role(F.col(role))
    return df.filter(F.col(session).isNotNull()).select(
        F.col(session).cast("string").alias("session"), F.col(ts).cast("bigint").alias("ts"), F.col(row).cast("bigint").alias("row"),
        F.coalesce(known, F.concat(F.lit("?"), F.coalesce(F.lower(F.trim(F.col(role))), F.lit("")))).alias("role"),
        F.unhex(F.sha2(F.col(content), 256)).alias("same"), F.coalesce(F.col(content).rlike(BLANK), F.lit(True)).alias("blank"),
        F.col(content).alias("content"), *([F.col(reply_to).cast("bigint").alias("up")] if reply_to else []))


_MESSAGE = ("session", "ts", "role", "same")


def _messages(rows: DataFrame, content: bool = False) -> DataFrame:
    """Distinct messages ``session, ts, row, role, blank`` (``content``, ``up``): equal time, role and content within a session are one, under the
    lowest row id and with that row's link. The keyed minimum combines map-side, so one message sent a million times costs one row per
    task; a content is compared by its digest and carried only where it is asked for. A role that is not known stands with a question mark before it."""
    more = [F.min_by("content", "row").alias("content")] * content + [F.min_by("up", "row").alias("up")] * ("up" in rows.columns)
    return rows.groupBy(*_MESSAGE).agg(F.min("row").alias("row"), F.bool_or("blank").alias("blank"), *more).drop("same")


_SUMMARY = "session string, part bigint, n bigint, bad_ts bigint, bad_role bigint, blank bigint, users bigint, lead bigint, unanswered bigint, tail string, cyclic bigint"
_PLACED = f"{_SUMMARY}, local bigint, row bigint"


def _named(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    """(session, rows) of each run of one session in a sorted partition, rows being (ts, row, role, blank, and what else there is)."""
    session, rows = None, []
    for batch in batches:
        for s, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if s != session:
                if rows:
                    yield session, rows
                session, rows = s, []
            rows.append(rest)
    if rows:
        yield session, rows


def _graph(rows: list[tuple]) -> tuple[list[int], list[tuple]]:
    """(parent of each row or -1, tie-break keys) of rows that come by time: named replies if the rows have a fifth field, else the last user message before."""
    keys = [(r[0] is not None, r[0] or 0, r[1]) for r in rows]
    if len(rows[0]) > 4:
        at = {r[1]: i for i, r in enumerate(rows)}
        return [at.get(r[4], -1) if r[4] is not None else -1 for r in rows], keys
    parents, user = [-1] * len(rows), -1
    for i, r in enumerate(rows):
        if r[2] == "user":
            user = i
        elif r[2] in ("assistant", "tool"):
            parents[i] = user
    return parents, keys


def _answered(rows: list[tuple], parents: list[int], order: list[int]) -> tuple[set[int], int]:
    """(user messages that an assistant message answers, assistant messages that answer none). An assistant message answers the nearest
    user message up its replies; walked in order, so what a message replies to is settled before it."""
    nearest, answered, lead = [-1] * len(rows), set(), 0
    for i in order:
        nearest[i] = i if rows[i][2] == "user" else nearest[parents[i]] if parents[i] >= 0 else -1
        if rows[i][2] == "assistant":
            if nearest[i] >= 0:
                answered.add(nearest[i])
            else:
                lead += 1
    return answered, lead


def _summary(session: str, part: int, rows: list[tuple]) -> tuple[tuple, list[int]]:
    """(the segment's row of ``_SUMMARY``, Kahn's order)."""
    parents, keys = _graph(rows)
    order, leftover = kahn(parents, keys)
    answered, lead = _answered(rows, parents, order)
    users = [i for i in order if rows[i][2] == "user"]
    seam = len(rows[0]) <= 4  # whether messages of a later segment may answer the last user message
    open_ = [i for i in users if i not in answered]
    tail = ("open" if users[-1] not in answered else "answered") if users and seam else "answered" if lead and seam else None
    return (
        session, part, len(rows), sum(r[0] is None for r in rows), sum(r[2][:1] == "?" for r in rows), sum(bool(r[3]) and r[2] in ("user", "assistant") for r in rows),
        sum(r[2] == "user" for r in rows), lead, len(open_) - (tail == "open"), tail, len(leftover),
    ), order


_KINDS = [pa.string(), *[pa.int64()] * 8, pa.string(), pa.int64()]


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out = [_summary(session, part, rows)[0] for session, rows in _segments(batches)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=_named(_SUMMARY))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every segment its summary, with no place, and a row for each message with its place and no summary."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [*_named(_SUMMARY), "local", "row"]
    told: list[tuple] = []
    sessions: list[str] = []
    places: list[int] = []
    ids: list[int] = []

    def flush() -> Iterator[pa.RecordBatch]:
        n = len(told)
        if n:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*told), _KINDS)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
        n = len(ids)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(sessions), pa.array([part] * n, pa.int64()), *(pa.nulls(n, k) for k in _KINDS[2:]), pa.array(places, pa.int64()), pa.array(ids, pa.int64())], names=names)
        for held in (told, sessions, places, ids):
            held.clear()

    for session, rows in _segments(batches):
        summary, order = _summary(session, part, rows)
        told.append(summary)
        sessions += [session] * len(order)
        places += range(len(order))
        ids += [rows[i][1] for i in order]
        if len(ids) >= 10_000:
            yield from flush()
    yield from flush()


def _sorted(messages: DataFrame) -> DataFrame:
    """Messages by (session, time, row); split anywhere, but for named replies, whose sessions stay whole."""
    keys = [F.col("session"), F.col("ts").asc_nulls_first(), F.col("row")]
    linked = ["up"] if "up" in messages.columns else []
    flat = messages.select("session", "ts", "row", "role", "blank", *linked)
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (repartition_for(flat, "session") if linked else flat.repartitionByRange(n, *keys)).sortWithinPartitions(*keys)


def _linked(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """``messages`` with ``up`` as the row id of a message: a link to a repeated row leads to the row that counts, one to a row that does not exist to none."""
    kept = rows.groupBy(*_MESSAGE).agg(F.min("row").alias("to"))
    wanted = messages.filter("up is not null").select("session", F.col("up").alias("row")).distinct()
    asked = rows.select(*_MESSAGE, "row").join(wanted, ["session", "row"], "left_semi").distinct()
    same = [asked[c].eqNullSafe(kept[c]) for c in _MESSAGE]
    alias = asked.join(kept, same).select(asked["session"], asked["row"].alias("up"), "to").dropDuplicates(["session", "up"])
    return messages.join(alias, ["session", "up"], "left").drop("up").withColumnRenamed("to", "up")


def _prepared(df: DataFrame, session: str, row: str, ts: str, role: str, content: str, reply_to: str | None, carry: bool) -> tuple[DataFrame, DataFrame | None]:
    """(messages to be sorted in tasks, the doubled links of sessions too large for that or None)."""
    rows = _rows(df, session, row, ts, role, content, reply_to)
    messages = _messages(rows, carry)
    if reply_to is None:
        return messages, None
    messages = cut(_linked(rows, messages))
    big = messages.groupBy("session").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > LARGE).select("session")
    if big.isEmpty():
        return messages, None
    return messages.join(big, "session", "left_anti"), _doubled(messages.join(big, "session", "left_semi"))


def sessions(df: DataFrame, session: str = "session_id", row: str = "row_id", ts: str = "ts_ms", role: str = "role", content: str = "content", reply_to: str | None = None) -> DataFrame:
    """One row per session: ``session_id, n_messages, bad_ts, bad_role, blank, no_user, reply_first, unanswered, cyclic, broken``.

    The reasons are BOOLEAN and ``broken`` is their disjunction: a message without time, a role that is not known, a user
    or assistant message without content, no user message, an assistant message that answers no user message, a user
    message that no assistant message answers, and replies that go in a circle. Rows without a session belong to none; repeated
    messages count once; equal times are settled by row id. Without ``reply_to`` an assistant message answers the last user message before it, so
    a user message is unanswered if none comes before the next user message or the end. With ``reply_to`` (a row id of the
    same session, null for none) messages follow the reply graph; a reply to a row that does not exist counts as no reply, one to a repeated
    row as one to the row that counts. Messages on or behind a circle answer nothing.
    """
    messages, doubled = _prepared(df, session, row, ts, role, content, reply_to, False)
    return _verdicts(_sorted(messages).mapInArrow(_summarise, _SUMMARY), doubled)


def _verdicts(parts: DataFrame, doubled: DataFrame | None) -> DataFrame:
    if doubled is not None:
        parts = parts.unionByName(_summarise_doubled(doubled))
    w = W.partitionBy("session").orderBy("part")
    # whether the last user message of any earlier segment still waits when this segment comes
    before = F.last("tail", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    seam = parts.withColumn("before", before)
    whole = seam.groupBy("session").agg(
        F.sum("n").alias("n_messages"), F.sum("bad_ts").alias("bad_ts"), F.sum("bad_role").alias("bad_role"), F.sum("blank").alias("blank"), F.sum("users").alias("users"),
        F.bool_or((F.col("lead") > 0) & F.col("before").isNull()).alias("reply_first"),
        F.max_by("tail", F.when(F.col("tail").isNotNull(), F.col("part"))).alias("tail"),
        F.sum(F.col("unanswered") + F.when((F.col("before") == "open") & (F.col("users") > 0) & (F.col("lead") == 0), 1).otherwise(0)).alias("unanswered"),
        F.sum("cyclic").alias("cyclic"))
    flags = {
        "bad_ts": F.col("bad_ts") > 0, "bad_role": F.col("bad_role") > 0, "blank": F.col("blank") > 0, "no_user": F.col("users") == 0,
        "reply_first": F.col("reply_first") & (F.col("users") > 0),
        "unanswered": (F.col("unanswered") > 0) | F.coalesce(F.col("tail") == "open", F.lit(False)), "cyclic": F.col("cyclic") > 0,
    }
    out = whole.select(F.col("session").alias("session_id"), "n_messages", *(c.alias(k) for k, c in flags.items()))
    broken = F.lit(False)
    for k in flags:
        broken = broken | F.col(k)
    return out.withColumn("broken", broken)


def _doubled(messages: DataFrame) -> DataFrame:
    """``messages`` plus ``leftover`` (Kahn's algorithm never releases it), ``nearest`` (row of the nearest user message up its replies) and ``path``,
    by which they sort into Kahn's order.

    Kahn's algorithm with a heap takes a message as soon as what it replies to is out, if no waiting key is less. So a message comes right after the
    greatest key on its way from the root, among those released by that one by the greatest key after it, and so on: ``path`` lists the keys on
    the way that are greater than all keys below them, greatest first, own key last, and comparing these lists gives the order. It is one
    key where clocks agree with the replies. Each step doubles how far up a message has seen, so log2(n) steps are enough; what has not reached a root then
    is on or behind a circle. Keys are (session, row), so a huge session is spread like any other.
    """
    key = F.struct(F.col("ts").isNotNull().alias("there"), F.coalesce("ts", F.lit(0)).alias("ts"), F.col("row").alias("row"))
    state = cut(messages.withColumn("path", F.array(key)).withColumn("nearest", F.when(F.col("role") == "user", F.col("row"))))
    steps, n = 0, state.count()
    while 2**steps <= max(n, 1) and not state.filter("up is not null").isEmpty():
        above = state.select("session", F.col("row").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("nearest").alias("nearest2"))
        greater = F.filter(F.coalesce("path2", F.array().cast(state.schema["path"].dataType)), lambda k: k > F.element_at("path", 1))
        state = cut(
            state.join(above, ["session", "up"], "left").withColumn("path", F.concat(greater, "path"))
            .withColumn("nearest", F.coalesce("nearest", "nearest2")).withColumn("up", F.col("up2")).drop("up2", "path2", "nearest2"))
        steps += 1
    return state.withColumn("leftover", F.col("up").isNotNull()).drop("up")


def _summarise_doubled(state: DataFrame) -> DataFrame:
    """The summaries of :func:`_summarise` for whole sessions out of doubled links."""
    own = state.groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts").isNull()).alias("bad_ts"), F.count_if(F.col("role").startswith("?")).alias("bad_role"),
        F.count_if(F.col("blank") & F.col("role").isin("user", "assistant")).alias("blank"), F.count_if(F.col("role") == "user").alias("users"),
        F.count_if((F.col("role") == "user") & ~F.col("leftover")).alias("asked"), F.count_if((F.col("role") == "assistant") & ~F.col("leftover") & F.col("nearest").isNull()).alias("lead"),
        F.count_if("leftover").alias("cyclic"))
    answered = state.filter("role = 'assistant' and not leftover and nearest is not null").select("session", "nearest").distinct().groupBy("session").agg(F.count(F.lit(1)).alias("answered"))
    out = own.join(answered, "session", "left").withColumn("unanswered", F.col("asked") - F.coalesce("answered", F.lit(0)))
    return out.select("session", F.lit(0).cast("bigint").alias("part"), "n", "bad_ts", "bad_role", "blank", "users", "lead", "unanswered", F.lit(None).cast("string").alias("tail"), "cyclic")


def _place_doubled(state: DataFrame) -> DataFrame:
    """``session, part, local, row`` by path, range-partitioned, so that no task sees a whole session."""
    n = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(state.filter("not leftover").select("session", "path", "row").repartitionByRange(n, "session", "path").withColumn("part", F.spark_partition_id().cast("bigint")))
    return placed.select("session", "part", (F.row_number().over(W.partitionBy("session", "part").orderBy("path")) - 1).cast("bigint").alias("local"), "row")


def turns(df: DataFrame, session: str = "session_id", row: str = "row_id", ts: str = "ts_ms", role: str = "role", content: str = "content", reply_to: str | None = None) -> DataFrame:
    """The ordered messages of the sessions that are not broken: ``session_id, position (from 0), row_id, role, content``. ``reply_to`` as in :func:`sessions`."""
    messages, doubled = _prepared(df, session, row, ts, role, content, reply_to, True)
    messages = cut(messages)
    told = cut(_sorted(messages).mapInArrow(_place, _PLACED))
    good = _verdicts(told.filter("local is null").drop("local", "row"), doubled).filter("not broken").select(F.col("session_id").alias("session"))
    placed, whole = told.filter("local is not null").select("session", "part", "local", "row"), messages
    if doubled is not None:
        placed = placed.unionByName(_place_doubled(doubled))
        whole = messages.select("session", "row", "role", "content").unionByName(doubled.select("session", "row", "role", "content"))
    sizes = placed.groupBy("session", "part").agg(F.count(F.lit(1)).alias("k"))
    offset = F.coalesce(F.sum("k").over(W.partitionBy("session").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        placed.join(sizes.withColumn("offset", offset).drop("k"), ["session", "part"]).join(whole.select("session", "row", "role", "content"), ["session", "row"]).join(good, "session", "left_semi")
        .select(F.col("session").alias("session_id"), (F.col("offset") + F.col("local")).alias("position"), F.col("row").alias("row_id"), "role", "content")
    )
