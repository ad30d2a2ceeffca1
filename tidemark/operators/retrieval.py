"""Query understanding, scoring, selection and token-budget packing of retrieval candidates, and log maintenance."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ordered, understanding
from tidemark.runtime import cut, repartition_for

# fixed values of the score formulas
W_DENSE, W_SPARSE, W_NODE = 0.55, 0.35, 0.10
W_TIME, W_BUSINESS = 0.18, 0.22
TOLERANCE_MS, HALF_LIFE_MS = 86_400_000, 604_800_000
DUPLICATE = 0.85
# for similar pairs: tokens whose counts set the order, longest set with signatures of three, pairs settled in one task
COMMON, SHORT, SETTLE = 5_000, 24, 1_000_000


def rewrite_follow_up(turns: DataFrame, order: str = "turn") -> DataFrame:
    """User turns that lean on what went before get the last three user texts put in front, 600 characters at most:
    ``conv_id, turn, text -> + rewritten``. Blank texts are no context and stay as they are."""
    users = turns.filter("role = 'user'")
    said = F.coalesce(F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")) != "", F.lit(False))
    before = F.array_join(F.collect_list(F.regexp_replace("text", r"^\s+|\s+$", "")).over(W.partitionBy("conv_id").orderBy(order).rowsBetween(-understanding.REWRITE_TURNS, -1)), " ")
    whole = F.substring(F.regexp_replace(F.concat_ws(" ", before, "text"), r"^\s+|\s+$", ""), 1, understanding.REWRITE_CHARS)
    spoken = users.filter(said).withColumn("rewritten", F.when(understanding.leans_on_thread(F.col("text")) & (before != ""), whole).otherwise(F.col("text")))
    return spoken.unionByName(users.filter(~said).withColumn("rewritten", F.col("text")))


def text_match(text: Column, terms: list[str]) -> Column:
    """Share of the terms that stand in the text, lower-cased."""
    low = F.lower(text)
    hits = sum((F.when(low.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    return hits / F.lit(max(len(terms), 1))


def time_decay(now_ms: Column, then_ms: Column) -> Column:
    """1 within a day, then exp(-sqrt(excess age / a week))."""
    age = now_ms - then_ms
    return F.when(age <= TOLERANCE_MS, 1.0).otherwise(F.exp(-F.sqrt((age - TOLERANCE_MS) / HALF_LIFE_MS)))


def hybrid(dense: Column, sparse: Column, node: Column, time: Column, business: Column) -> Column:
    """Origin score of dense, sparse and node parts (each 0..1), blended with time and business weight; clamped, 6 places. Nulls are 0."""
    z = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.cast("double"), F.lit(0.0))))
    origin = W_DENSE * z(dense) + W_SPARSE * z(sparse) + W_NODE * z(node)
    return F.round(z((1 - W_TIME - W_BUSINESS) * origin + W_TIME * z(time) + W_BUSINESS * z(business)), 6)


def node_score(dense: Column, sparse: Column, hinted: Column) -> Column:
    """Score of a node: 0.72 dense, 0.28 sparse, 0.08 for an index hint; at least 0.58 for a node that is only hinted at."""
    s = F.least(F.lit(1.0), 0.72 * F.coalesce(dense, F.lit(0.0)) + 0.28 * F.coalesce(sparse, F.lit(0.0)) + F.when(hinted, 0.08).otherwise(0.0))
    return F.round(F.when(dense.isNull() & sparse.isNull() & hinted, 0.58).otherwise(s), 6)


def in_scope(actual: dict[str, Column], wanted: dict[str, object]) -> Column:
    """Only fields that are asked for constrain, and a record without the field passes."""
    out = F.lit(True)
    for field, value in wanted.items():
        out = out & F.coalesce(actual[field] == F.lit(value), F.lit(True))
    return out


def index_filter(terms: Column, groups: list[list[str]]) -> Column:
    """Whether the terms meet the groups: terms of a group are alternatives, one group has to be met, of several any. No group is always met."""
    out = F.lit(not groups)
    for g in groups:
        out = out | F.arrays_overlap(terms, F.array(*map(F.lit, g)))
    return out


def fan_out(candidates: DataFrame, by: list[str], order: list, n: int = 1024) -> DataFrame:
    """The first ``n`` candidates of each group; the group limit applies before the shuffle."""
    return candidates.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def merge_paths(ranked: DataFrame, query: str, item: str, path: str, rank: str, limits: dict[str, int]) -> DataFrame:
    """Each recall path's first candidates up to its quota, items once (at their best rank): ``query, item, path, rank``."""
    quota = F.coalesce(*(F.when(F.col(path) == p, F.lit(k)) for p, k in limits.items()), F.lit(0))
    taken = ranked.filter(F.col(rank) <= quota)
    return taken.groupBy(query, item).agg(F.min_by(F.struct(path, rank), F.struct(rank, path)).alias("r")).select(query, item, F.col("r")[path].alias(path), F.col("r")[rank].alias(rank))


def diversify(ranked: DataFrame, query: str, node: str, rank: str) -> DataFrame:
    """``ranked`` plus ``place``: the first candidate of every node before any second one."""
    turn = F.row_number().over(W.partitionBy(query, node).orderBy(rank))
    rows = ranked.withColumn("_t", F.when(turn == 1, 0).otherwise(1))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy("_t", rank))).drop("_t")


def pack(candidates: DataFrame, query: str, score: str, item: str, tokens: str, budget: int, max_refs: int = 64, min_score: float = 0.0) -> DataFrame:
    """Greedy packing under a token budget, best score first: candidates with ``selected`` and ``reason``.

    A candidate that does not fit is skipped, not the end. Unknown tokens count as 1, null scores as below the minimum; equal scores are
    settled by item. The pass streams sorted rows and holds two numbers per query.
    """
    rows = candidates.withColumn("_tokens", F.greatest(F.lit(1), F.coalesce(F.col(tokens).cast("bigint"), F.lit(1))))
    rows = rows.withColumn("_score", F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")), F.lit(-1.0)))
    types = ", ".join(f"`{c}` {t}" for c, t in candidates.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used, n, started = None, 0, 0, False
        for b in batches:
            chosen, why = [], []
            for q, s, t in zip(*(b.column(c).to_pylist() for c in (query, "_score", "_tokens"))):
                if not started or q != current:
                    current, used, n, started = q, 0, 0, True
                reason = "low_score" if s < min_score else "max_selected_refs" if n >= max_refs else "over_budget" if used + t > budget else "selected"
                if reason == "selected":
                    used += t
                    n += 1
                chosen.append(reason == "selected")
                why.append(reason)
            out = b.drop_columns(["_score", "_tokens"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(chosen, pa.bool_()), pa.array(why, pa.string())], names=[*out.schema.names, "selected", "reason"])

    return repartition_for(rows, query).sortWithinPartitions(query, F.col("_score").desc(), item).mapInArrow(run, f"{types}, selected boolean, reason string")


def compact_latest(log: DataFrame, key: Column, updated: str, seq: str) -> DataFrame:
    """Latest value per identity key, at the place of its first record (``first_seq``): newer update time wins, then the later record.
    Records without a key pass through."""
    rows = log.withColumn("_k", key)
    best = rows.filter("_k is not null").groupBy("_k").agg(F.max_by(F.struct(*log.columns), F.struct(updated, seq)).alias("r"), F.min(seq).alias("first_seq"))
    return best.select(*(F.col("r")[c].alias(c) for c in log.columns), "first_seq").unionByName(rows.filter("_k is null").drop("_k").withColumn("first_seq", F.col(seq)))


def keyed_truth(log: DataFrame, key: str, rank: str, seq: str) -> DataFrame:
    """History of keyed writes with ``accepted`` (its rank is no lower than any before) and ``current`` (the last accepted)."""
    told = ordered.running(log, [key], [seq], F.col(rank), "_top", "max", inclusive=False)
    rows = told.withColumn("accepted", F.col("_top").isNull() | (F.col(rank) >= F.col("_top"))).drop("_top")
    last = rows.filter("accepted").groupBy(F.col(key).alias("_k")).agg(F.max(seq).alias("_last"))
    return rows.join(last, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("current", F.col(seq) == F.col("_last")).drop("_k", "_last")


def visible(records: DataFrame, cutoffs: DataFrame, now_ms: int, scope: list[str]) -> DataFrame:
    """Records that have not expired and did not happen before their scope's retention cut-off."""
    c = cutoffs.groupBy(*scope).agg(F.max("cutoff_ms").alias("_cut"))
    return records.filter(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms)).join(c, scope, "left").filter(F.col("_cut").isNull() | (F.col("occurred_ms") >= F.col("_cut"))).drop("_cut")


def without_forgotten(records: DataFrame, tombstones: DataFrame, key: str, seq: str) -> DataFrame:
    """Records no later tombstone of their key removes; what is written again afterwards lives."""
    t = tombstones.groupBy(key).agg(F.max(seq).alias("_t"))
    return records.join(t, key, "left").filter(F.col("_t").isNull() | (F.col(seq) > F.col("_t"))).drop("_t")


def admit_raw(events: DataFrame, compressed: DataFrame, n: int = 256) -> DataFrame:
    """Nodes that have compressions keep their newest ``n`` raw events; others keep all."""
    node = ["tenant", "node_hash"]
    there = compressed.select(*node).distinct()
    newest = W.partitionBy(*node).orderBy(F.col("ingestion_time_ms").desc_nulls_last(), F.col("delivery_id").desc())
    cut_down = events.join(there, node, "left_semi").withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")
    return events.join(there, node, "left_anti").unionByName(cut_down)


def statistics(rows: DataFrame, by: list[str], value: str, at: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.max_by(value, at).alias("latest"))


def drop_similar(candidates: DataFrame, query: str, rank: str, tokens: str, least: float = DUPLICATE, large: int = 512) -> DataFrame:
    """Candidates in rank order without those whose token set (ARRAY ``tokens``) is too close to one already taken (Jaccard of ``least`` or
    more, above 0 and up to 1). Nothing else is left out; empty and null sets resemble nothing. Of equal ranks any may come first.

    Queries of up to ``large`` candidates are passed over row by row, comparing with the token sets taken so far; in larger ones similar
    pairs are found by a join on signatures of rare tokens, so that no task sees a whole query.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    types = ", ".join(f"`{c}` {t}" for c, t in candidates.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, taken, started = None, [], False
        for b in batches:
            keep = []
            for q, t in zip(b.column(query).to_pylist(), b.column(tokens).to_pylist()):
                if not started or q != current:
                    current, taken, started = q, [], True
                mine = frozenset(t or ())
                ok = not any(len(mine & x) >= least * max(len(mine | x), 1) for x in taken)
                if ok and mine:
                    taken.append(mine)
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_()))

    counts = candidates.groupBy(F.col(query).alias("_big")).count().filter(F.col("count") > large).select("_big")
    big = F.broadcast(counts)  # at most a row per ``large`` candidates
    same = F.col(query).eqNullSafe(F.col("_big"))
    small = repartition_for(candidates.join(big, same, "left_anti"), query).sortWithinPartitions(query, rank).mapInArrow(run, types)
    return small.unionByName(_drop_similar_large(candidates.join(big, same, "left_semi"), query, rank, tokens, least))


def _signatures(common: dict[str, int], least: float):
    """``sig, n, id`` rows of each set: any two different sets of Jaccard ``least`` or more share one.

    Both hold ceil(least * n) tokens of either, so in one fixed order of all tokens, rare ones first, they share k tokens within the first
    n - ceil(least * n) + k of each. k is 3 where the smaller set has up to ``SHORT`` tokens, else 1, as the number of threes grows fast;
    a set too small to share 3 has no other set that close if ``least`` is above 2/3."""
    many = least > 2 / 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, sizes, ids = [], [], []
            for i, q, t in zip(b.column("id").to_pylist(), b.column("q").to_pylist(), b.column("set").to_pylist()):
                n = len(t)
                order = [zlib.crc32(x.encode()) for _, x in sorted((common.get(x, 0), x) for x in map(repr, t))]
                spare = n - math.ceil(least * n - 1e-9)
                mine: set[int] = set()
                if many and least * n <= SHORT + 1e-9:
                    mine.update(hash((q, *c)) for c in combinations(order[: spare + 3], 3))
                if not many or n > SHORT:
                    mine.update(hash((q, x)) for x in order[: spare + 1])
                sigs += mine
                sizes += [n] * len(mine)
                ids += [i] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(ids, pa.int64())], names=["sig", "n", "id"])

    return run


def _drop_similar_large(candidates: DataFrame, query: str, rank: str, tokens: str, least: float) -> DataFrame:
    distinct = F.array_sort(F.array_distinct(tokens))
    filled = F.coalesce(F.size(tokens) > 0, F.lit(False))
    # equal sets: the first one; what drops it would drop the others too
    first = candidates.filter(filled).groupBy(F.col(query).alias("_q"), distinct.alias("set")).agg(F.min_by(F.struct(*candidates.columns), F.struct(rank)).alias("r"))
    sets = cut(first.select("set", "r", F.xxhash64("_q").alias("q"), F.monotonically_increasing_id().alias("id")))
    common = sets.select(F.explode("set").alias("t")).groupBy("t").count().orderBy(F.col("count").desc(), "t").limit(COMMON).collect()
    sigs = sets.select("id", "q", "set").mapInArrow(_signatures({repr(r["t"]): r["count"] for r in common}, least), "sig bigint, n int, id bigint")
    a, b = (sigs.select("sig", *(F.col(c).alias(f"{c}_{x}") for c in ("n", "id"))) for x in "ab")
    near = (F.col("id_a") < F.col("id_b")) & (F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - 1e-9)
    pairs = a.join(b, "sig").filter(near).select("id_a", "id_b").distinct()
    a, b = (sets.select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "set")), F.col("r")[query].alias(f"q_{x}"), F.struct(F.col("r")[rank].alias("rank"), "id").alias(f"at_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    alike = F.col("q_a").eqNullSafe(F.col("q_b")) & (shared >= F.lit(least) * (F.size("set_a") + F.size("set_b") - shared))
    found = pairs.join(a, "id_a").join(b, "id_b").filter(alike)
    edges = cut(found.select(F.least("at_a", "at_b").alias("first"), F.greatest("at_a", "at_b").alias("then")).select(
        F.col("first.id").alias("first"), F.col("then").alias("at"), F.col("then.id").alias("then")))
    gone = _later_of_pairs(edges)
    kept = sets.join(gone, "id", "left_anti").select(*(F.col("r")[c].alias(c) for c in candidates.columns))
    return kept.unionByName(candidates.filter(~filled))


def _later_of_pairs(edges: DataFrame) -> DataFrame:
    """``id`` of the rows a pass in order leaves out: those paired (``first``, ``then``) with an earlier one that is itself taken.

    While the pairs are many, rows that nothing precedes are settled at once, with what they drop; the last ``SETTLE`` are passed over in order."""
    gone = edges.select(F.col("then").alias("id")).limit(0)
    while edges.count() > SETTLE:
        free = edges.join(edges.select(F.col("then").alias("first")).distinct(), "first", "left_anti")
        now = cut(free.select(F.col("then").alias("id")).distinct())
        gone = gone.unionByName(now)
        edges = edges.join(now.withColumnRenamed("id", "first"), "first", "left_anti").join(now.withColumnRenamed("id", "then"), "then", "left_anti")
        edges = cut(edges.select("first", "at", "then"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped: set[int] = set()
        for b in batches:
            dropped.update(then for first, then in zip(b.column("first").to_pylist(), b.column("then").to_pylist()) if first not in dropped)
        yield pa.RecordBatch.from_arrays([pa.array(list(dropped), pa.int64())], names=["id"])

    return gone.unionByName(edges.repartition(1).sortWithinPartitions("at").select("first", "then").mapInArrow(run, "id bigint"))
