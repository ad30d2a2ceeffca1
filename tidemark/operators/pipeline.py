"""From a query to a packed context: candidate scan, index terms, native score, selection under budgets, clamp, retrieval and injection.

A record is ``ref_hash, record_type, tenant, session_id, node_hash, batch_id, text, tokens, ts_ms`` with the kinds ``event_type``, ``entity_type``,
``resource_type`` where it has them. Filters and scores are column expressions over any number of records; only the packer, whose choices depend on
one another, folds over a query's best candidates, of which at most ``MAX_CANDIDATES`` are left when it starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as made

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import understanding
from tidemark.operators.retrieval import W_DENSE, W_NODE, W_SPARSE, in_scope
from tidemark.runtime import repartition_for

# -- fixed values ---------------------------------------------------------------------------------------------------
SERVED = ["context_compression_event", "context_entity", "context_event", "context_segment", "context_summary", "resource_chunk", "skill_section"]
NOT_SERVED = ["context_index", "context_embedding", "resource_manifest", "skill_registry_update"]
PACKED_CLASSES = ["entity", "event", "summary"]
MIN_SCORE, MAX_CANDIDATES, MAX_REFS = 0.20, 512, 64
ENTITY_BOOST, COMPRESSION_BOOST = 0.08, 0.06
#: By continuity with the asking session: worth of a record by its type, and of any other.
CONTINUITY = {
    "same_session": ({"context_event": 0.16, "context_segment": 0.16, "context_summary": 0.12, "context_entity": 0.10}, 0.08),
    "cross_session": ({"context_entity": 0.11, "context_event": 0.06, "context_segment": 0.06, "context_compression_event": 0.06}, 0.0),
}
#: What another session's record is worth more: (record type, question types or None for all, worth); the first that fits.
CROSS_BOOSTS = [
    ("context_entity", ["current_state", "latest", "multi_hop", "profile_memory"], 0.10), ("context_entity", None, 0.06), ("context_event", ["multi_hop", "why_emotion", "fact", "evidence"], 0.01),
    ("context_segment", ["multi_hop", "why_emotion", "fact", "evidence"], 0.01), ("context_compression_event", None, 0.05), ("context_summary", ["broad_exploration"], 0.05), ("context_summary", None, 0.02),
]
#: What a record's type is worth for a kind of question; the first that fits.
TYPE_BOOSTS = [
    ("skill_section", ["procedure", "evidence"], 0.42), ("skill_section", None, 0.34), ("resource_chunk", ["evidence", "fact"], 0.20), ("resource_chunk", None, 0.12),
    ("context_entity", ["current_state", "latest", "profile_memory"], 0.24), ("context_entity", None, 0.12), ("context_event", None, 0.10), ("context_segment", None, 0.10), ("context_summary", ["broad", "exploration"], 0.12),
]
SUMMARY_QUESTIONS = ["broad", "broad_exploration", "exploration", "profile_memory"]
#: Share of the budget that other sessions may take, by kind of question, and its bounds.
CROSS_RATIO = {"profile_memory": 0.30, "current_state": 0.20, "latest": 0.20, "multi_hop": 0.20, "date": 0.20, "broad_exploration": 0.15, "evidence": 0.15}
CROSS_DEFAULT, CROSS_FLOOR, CROSS_FLOOR_FROM = 0.12, 256, 1200


@dataclass
class CrossSession:
    """What other sessions may contribute."""

    enabled: bool = True
    budget: int = 0
    max_sessions: int = 3
    max_candidates: int = 24
    min_score: float = 0.20
    raw_min_score: float = 0.45
    bridges: int = 2  # entities that may go beyond the budget


def cross_session(question_type: str, budget: int, enabled: bool = True) -> CrossSession:
    """The policy for a kind of question and a token budget."""
    profile = question_type == "profile_memory"
    most = min(budget, 12_288 if profile else 8_192, int(budget * (0.35 if profile else 0.20)))
    share = int(budget * min(CROSS_RATIO.get(question_type, CROSS_DEFAULT), 0.35 if profile else 0.20))
    share = max(share, CROSS_FLOOR) if budget >= CROSS_FLOOR_FROM and share else share
    if not enabled or budget <= 0:
        return CrossSession(False, 0, 0, 0, 0.0, 0.0, 0)
    return CrossSession(True, min(share, most), 8 if profile else 3, 48 if profile else 24, bridges=3 if profile else 2)


# -- scan ------------------------------------------------------------------------------------------------------------
def own_terms(records: DataFrame) -> Column:
    """Index terms that a record carries by its kind; empty kinds give none."""
    named = lambda kind, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(F.concat(F.lit(f"{kind}:"), F.col(c)))).otherwise(F.array().cast("array<string>"))
    fixed = lambda *terms: F.array(*map(F.lit, terms))
    t = F.col("record_type")
    return (
        F.when(t == "context_event", F.concat(fixed("source_type:message"), named("event_type", "event_type"))).when(t == "context_entity", named("entity_type", "entity_type"))
        .when(t == "resource_chunk", F.concat(fixed("source_type:resource"), named("resource_type", "resource_type"))).when(t == "skill_section", fixed("source_type:skill", "resource_type:skill"))
        .otherwise(F.array().cast("array<string>")))


def with_index_terms(records: DataFrame, postings: DataFrame, wanted: list[str]) -> DataFrame:
    """``records`` plus ``terms``, those of the ``wanted`` index terms they carry, and ``has_terms``, whether they carry any.

    Postings are ``index_name, batch_id, node_hash, ref_hash``: a term belongs to a batch, and to a ref or, without one, to a node. Per key the postings
    fold to the wanted terms and a flag before the three joins, so no key's list grows with its postings.
    """
    named = postings.filter(F.coalesce(F.col("index_name"), F.lit("")) != "")
    hit = F.when(F.col("index_name").isin(wanted), F.col("index_name"))
    out, parts, flags = records, [own_terms(records)], [F.size(own_terms(records)) > 0]
    for key, rows in (("batch_id", named), ("node_hash", named.filter("ref_hash is null")), ("ref_hash", named)):
        known = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(hit).alias(f"_{key}"))
        out = out.join(known, key, "left")
        parts.append(F.coalesce(f"_{key}", F.array().cast("array<string>")))
        flags.append(F.col(f"_{key}").isNotNull())
    carried = F.array_intersect(F.concat(*parts), F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>"))
    some = flags[0]
    for f in flags[1:]:
        some = some | f
    return out.select(*records.columns, F.array_sort(F.array_distinct(carried)).alias("terms"), some.alias("has_terms"))


def passes_groups(terms: Column, groups: list[list[str]]) -> Column:
    """One group: one of its terms; several: a term of any group; none: always."""
    wanted = sorted({t for g in groups for t in g})
    return F.arrays_overlap(terms, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def scan(records: DataFrame, postings: DataFrame | None = None, types: list[str] | None = None, scope: dict | None = None, nodes: DataFrame | None = None, groups: list[list[str]] = ()) -> DataFrame:
    """``records`` plus ``dropped``: null for a candidate, else the first check it fails: ``type``, ``scope``, ``node``, ``index``, ``not_served``.

    ``scope`` constrains only the fields it names, and a record without the field passes; ``nodes`` (``node_hash``) are the selected ones; a record without any
    index term passes the index filter.
    """
    served = F.when(F.col("record_type").isin(NOT_SERVED), "not_served")
    rows = records
    if nodes is not None:
        rows = rows.join(nodes.select("node_hash").distinct().withColumn("_node", F.lit(True)), "node_hash", "left").select(*records.columns, "_node")
    checks = []
    if types:
        checks.append(F.when(~F.coalesce(F.col("record_type").isin(types), F.lit(False)), "type"))
    if scope:
        checks.append(F.when(~in_scope({c: F.col(c) for c in scope}, scope), "scope"))
    if nodes is not None:
        checks.append(F.when(F.col("_node").isNull() & ~F.col("record_type").isin("context_index", "context_embedding"), "node"))
    if groups and postings is not None:
        rows = with_index_terms(rows, postings, sorted({t for g in groups for t in g}))
        checks.append(F.when(F.col("has_terms") & ~passes_groups(F.col("terms"), list(groups)), "index"))
    return rows.withColumn("dropped", F.coalesce(*checks, served)).select(*records.columns, "dropped")


def scan_counters(scanned: DataFrame) -> DataFrame:
    """``dropped, n``: how many records each check drops, null for the candidates."""
    return scanned.groupBy("dropped").agg(F.count(F.lit(1)).alias("n"))


def selected_by_tree(records: DataFrame, paths: DataFrame, nodes: DataFrame, flat: bool = False) -> DataFrame:
    """Records (``path`` ARRAY, ``node_hash``) whose node is selected, or whose path is a selected path or lies above or below a selected leaf path.

    ``paths`` is ``path, leaf``. Every prefix of a record's path, and of a leaf path, is a join key, so the prefix relation is an equi-join in both
    directions; paths are as long as the tree is deep."""
    if flat:
        return records
    joined = lambda c: F.array_join(c, "/")
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(c)), lambda k: joined(F.slice(c, F.lit(1), k)))
    given = paths.filter(F.size("path") > 0)
    exact = given.select(joined(F.col("path")).alias("_p")).distinct()
    below = given.filter("leaf").select(joined(F.col("path")).alias("_p")).distinct()
    above = given.filter("leaf").select(F.explode(prefixes(F.col("path"))).alias("_p")).distinct()
    keyed = records.withColumn("_id", F.monotonically_increasing_id())
    own = keyed.filter(F.size("path") > 0)
    hits = own.join(exact.unionByName(above).distinct(), joined(F.col("path")) == F.col("_p"), "left_semi").select("_id")
    under = own.select("_id", F.explode(prefixes(F.col("path"))).alias("_q")).join(below, F.col("_q") == F.col("_p"), "left_semi").select("_id")
    at = keyed.join(nodes.select("node_hash").distinct(), "node_hash", "left_semi").select("_id")
    return keyed.join(hits.unionByName(under).unionByName(at).distinct(), "_id", "left_semi").drop("_id")


# -- score -----------------------------------------------------------------------------------------------------------
def continuity(session: Column, asking: str | None, explicit: Column | None = None) -> Column:
    """``same_session``, ``cross_session`` or ``unscoped`` (no session on either side); an explicit mark wins."""
    told = F.lit("unscoped") if not asking else F.when(session == asking, "same_session").when(F.coalesce(session, F.lit("")) != "", "cross_session").otherwise("unscoped")
    return told if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), told)


def _first_fit(table: list[tuple[str, list[str] | None, float]], kind: str) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    seen = set()
    for record_type, kinds, worth in table:
        if record_type not in seen and (kinds is None or kind in kinds):
            seen.add(record_type)
            out = out.when(F.col("record_type") == record_type, F.lit(worth))
    return out.otherwise(0.0)


def native_score(records: DataFrame, query: str, asking: str | None = None) -> DataFrame:
    """``records`` plus ``score`` and ``continuity``: the share of the query's distinct terms in the text, and what type and session add. Records of other types, and
    empty texts, are left out."""
    terms, kind = list(dict.fromkeys(understanding.plan(query).terms)), understanding.kind_of_question(query)
    small = understanding.Text(F.col("text")).small
    hits = F.lit(0.0)
    for t in terms:
        hits = hits + F.when(small.contains(t), 1.0).otherwise(0.0)
    rows = records.filter(F.col("record_type").isin(SERVED) & (F.coalesce(F.col("text"), F.lit("")) != "")).withColumn("continuity", continuity(F.col("session_id"), asking))
    ties = F.lit(0.0)
    for status, (worths, rest) in CONTINUITY.items():
        by_type = F.when(F.lit(False), F.lit(0.0))
        for record_type, worth in worths.items():
            by_type = by_type.when(F.col("record_type") == record_type, F.lit(worth))
        ties = F.when(F.col("continuity") == status, by_type.otherwise(rest)).otherwise(ties)
    cross = F.when(F.col("continuity") == "cross_session", _first_fit(CROSS_BOOSTS, kind)).otherwise(0.0)
    base = F.when(F.col("record_type") == "context_entity", ENTITY_BOOST).when(F.col("record_type") == "context_compression_event", COMPRESSION_BOOST).otherwise(0.0)
    return rows.withColumn("score", F.round(hits / max(len(terms), 1) + base + ties + cross + _first_fit(TYPE_BOOSTS, kind), 6))


def best(scored: DataFrame, min_score: float = MIN_SCORE, n: int = MAX_CANDIDATES) -> DataFrame:
    """The ``n`` best candidates of at least ``min_score``; equal scores by ``ref_hash``. Each task keeps n rows."""
    return scored.filter(F.col("score") >= min_score).orderBy(F.col("score").desc(), "ref_hash").limit(n)


def packing_key(score: Column, boost: Column, tokens: Column, compression: Column, sources: Column, kind: Column) -> list[Column]:
    """Sort columns of the packer: the boosted score, then score per token; a compression of two sources or more counts half as much again for facts, states and hops."""
    boosted = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score + boost))
    dense = F.when(compression & kind.isin("fact", "current_state", "multi_hop") & (sources >= 2), 1.5).otherwise(1.0)
    return [boosted.desc(), (boosted / F.greatest(F.lit(1), tokens) * dense).desc(), score.desc()]


LANES = ["primary_hybrid", "auxiliary_keyword_graph"]


def scan_lanes(records: DataFrame, query: str, path: str = "path", terms: str = "terms", kind: str = "kind", dense: Column | None = None, node: Column | None = None, per_node: int = 1024, at: str = "seq") -> DataFrame:
    """Candidates of any record type in two lanes: ``records..., origin_score, keyword_score, recall_path``. A record enters the primary lane if its hybrid score of text, embedding
    (``dense``) and node is above 0, and the auxiliary lane if its node path, index terms, kind and text together hold a word of the query. Of every node only the latest ``per_node``
    records by ``at`` are looked at."""
    wanted = list(dict.fromkeys(understanding.plan(query).terms))
    newest = W.partitionBy("node_hash").orderBy(F.col(at).desc())
    rows = records.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= per_node).drop("_n")

    def share(text: Column) -> Column:
        small = understanding.Text(text).small
        hits = F.lit(0)
        for t in wanted:
            hits = hits + F.when(small.contains(t), 1).otherwise(0)
        return F.coalesce(hits / max(len(wanted), 1), F.lit(0.0))

    zero = F.lit(0.0)
    clamp01 = lambda c: F.least(F.lit(1.0), F.greatest(zero, F.coalesce(c, zero)))
    words = understanding.terms_of(F.coalesce("text", F.lit("")))
    said = F.size(F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, wanted)))) if wanted else F.lit(0)
    hybrid = F.round(W_DENSE * clamp01(dense if dense is not None else zero) + W_SPARSE * share(F.col("text")) + W_NODE * clamp01(node if node is not None else zero), 6)
    graph = F.round(share(F.concat_ws(" ", F.array_join(path, " "), F.array_join(F.array_sort(terms), " "), kind, "text")), 6)
    told = rows.withColumn("keyword_score", said)
    lanes = [told.withColumn("origin_score", score).withColumn("recall_path", F.lit(lane)) for lane, score in zip(LANES, (hybrid, graph))]
    return lanes[0].unionByName(lanes[1]).filter("origin_score > 0")


# -- pack ------------------------------------------------------------------------------------------------------------
@dataclass
class Budgets:
    """Token budgets of a pack: the whole, by source role and by extraction phase, and tokens kept back for a class until it has them."""

    tokens: int
    max_refs: int = MAX_REFS
    roles: dict[str, int] = made(default_factory=dict)
    phases: dict[str, int] = made(default_factory=dict)
    floors: dict[str, int] = made(default_factory=dict)


#: Reasons in the order in which they are tried.
REASONS = [
    "max_selected_refs", "stale", "over_budget", "class_policy", "summary_policy", "cross_session_disabled", "cross_session_low_score", "cross_session_candidates", "cross_session_sessions",
    "cross_session_budget", "source_role_budget", "extraction_phase_budget", "memory_layer_floor", "duplicate", "selected",
]


class _Pack:
    """What has been taken for one query."""

    def __init__(self, budgets: Budgets, cross: CrossSession, summaries: bool):
        self.b, self.x, self.summaries = budgets, cross, summaries
        self.used = self.n = self.cross_used = self.cross_n = self.bridges = 0
        self.sessions, self.signatures = set(), set()
        self.by_role, self.by_phase, self.by_class = {}, {}, {}

    def judge(self, score, tokens, kind, status, session, signature, role, phase, stale, has_events) -> str:
        b, x = self.b, self.x
        crosses, bridge = status == "cross_session", status == "cross_session" and kind == "entity"
        held_back = sum(max(0, floor - self.by_class.get(c, 0)) for c, floor in b.floors.items() if c != kind)
        tests = (
            ("max_selected_refs", self.n >= b.max_refs), ("stale", bool(stale)), ("over_budget", self.used + tokens > b.tokens), ("class_policy", kind not in PACKED_CLASSES),
            ("summary_policy", kind == "summary" and has_events and not self.summaries), ("cross_session_disabled", crosses and not x.enabled),
            ("cross_session_low_score", crosses and (score < x.min_score or kind == "event" and score < x.raw_min_score)), ("cross_session_candidates", crosses and 0 < x.max_candidates <= self.cross_n),
            ("cross_session_sessions", crosses and session not in self.sessions and 0 < x.max_sessions <= len(self.sessions)),
            ("cross_session_budget", crosses and 0 < x.budget < self.cross_used + tokens and not (bridge and self.bridges < x.bridges)),
            ("source_role_budget", role in b.roles and self.by_role.get(role, 0) + tokens > b.roles[role]), ("extraction_phase_budget", phase in b.phases and self.by_phase.get(phase, 0) + tokens > b.phases[phase]),
            ("memory_layer_floor", held_back > 0 and self.used + tokens > b.tokens - held_back), ("duplicate", signature in self.signatures),
        )
        for name, fails in tests:
            if fails:
                return name
        self.used, self.n = self.used + tokens, self.n + 1
        self.signatures.add(signature)
        for table, key in ((self.by_role, role), (self.by_phase, phase), (self.by_class, kind)):
            table[key] = table.get(key, 0) + tokens
        if crosses:
            self.cross_used, self.cross_n, self.bridges = self.cross_used + tokens, self.cross_n + 1, self.bridges + bridge
            self.sessions.add(session)
        return "selected"


_PACKED = ["score", "tokens", "class", "continuity", "session_id", "signature", "role", "phase", "stale"]


def pack(candidates: DataFrame, query: str, budgets: Budgets, cross: CrossSession, question_type: str = "fact", order: list[Column] | None = None) -> DataFrame:
    """Greedy selection for every value of ``query``: ``candidates`` plus ``reason``, one of ``REASONS``.

    Candidates have ``ref_hash`` and the columns ``score, tokens, class, continuity, session_id, signature, role, phase, stale`` (nulls: no score,
    one token, no class, no session and so on). They come best first (``order``; score, then ref_hash if None); one that does not fit is skipped. Cut the candidates of a query
    before (:func:`best`, ``retrieval.fan_out``): the pass holds a query's running totals, not its rows.
    """
    events = candidates.filter(F.col("class") == "event").select(F.col(query).alias("_q")).distinct().withColumn("_events", F.lit(True))
    rows = candidates.join(events, F.col(query).eqNullSafe(F.col("_q")), "left").drop("_q")
    types = ", ".join(f"`{c}` {t}" for c, t in candidates.dtypes)
    summaries = question_type in SUMMARY_QUESTIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for b in batches:
            why = []
            for q, e, score, tokens, *rest in zip(*(b.column(c).to_pylist() for c in (query, "_events", *_PACKED))):
                if state is None or q != current:
                    current, state = q, _Pack(budgets, cross, summaries)
                why.append(state.judge(-1.0 if score is None else float(score), max(1, int(tokens or 1)), *rest, bool(e)))
            out = b.drop_columns(["_events"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(why, pa.string())], names=[*out.schema.names, "reason"])

    keys = order or [F.col("score").desc_nulls_last()]
    return repartition_for(rows, query).sortWithinPartitions(query, *keys, "ref_hash").mapInArrow(run, f"{types}, reason string")


def clamp(refs: DataFrame, query: str, rank: str, tokens: str, budget: int, reserved: int = 0) -> DataFrame:
    """Ranked refs with ``kept`` under ``budget`` less ``reserved`` tokens: each that still fits is kept, the first one always. Unknown tokens count as 1."""
    room = max(0, budget - max(0, reserved))
    types = ", ".join(f"`{c}` {t}" for c, t in refs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used, started = None, 0, False
        for b in batches:
            kept = []
            for q, t in zip(b.column(query).to_pylist(), b.column(tokens).to_pylist()):
                t = max(1, int(t or 1))
                first = not started or q != current
                if first:
                    current, used, started = q, 0, True
                kept.append(first or used + t <= room)
                used += t * kept[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, pa.bool_())], names=[*b.schema.names, "kept"])

    return repartition_for(refs, query).sortWithinPartitions(query, rank).mapInArrow(run, f"{types}, kept boolean")


def merge_lanes(ranked: DataFrame, query: str, item: list[str], lane: str, rank: str, total: int, auxiliary: int) -> DataFrame:
    """Of two ranked lanes (``primary``, ``auxiliary``) at most ``total`` items of each query, with ``place``: the primary lane's share first, then the auxiliary lane up to
    the total, then what is left of the primary lane. An item of both lanes counts at its first place."""
    quota = max(0, total - max(0, min(auxiliary, total)))
    once = ranked.groupBy(query, *item).agg(F.min(F.when(F.col(lane) == "primary", F.col(rank))).alias("_p"), F.min(F.when(F.col(lane) == "auxiliary", F.col(rank))).alias("_a"))
    # places count distinct items of the primary lane, so the lane's own order is taken again after repeats are gone
    at = F.row_number().over(W.partitionBy(query).orderBy(F.col("_p").asc_nulls_last(), *item))
    turn = F.when(F.col("_p").isNotNull() & (F.col("_at") <= quota), 0).when(F.col("_a").isNotNull(), 1).otherwise(2)
    rows = once.withColumn("_at", at).withColumn("_turn", turn)
    place = F.row_number().over(W.partitionBy(query).orderBy("_turn", F.when(F.col("_turn") == 1, F.col("_a")).otherwise(F.col("_p")), *item))
    return rows.withColumn("place", place).filter(F.col("place") <= total).select(query, *item, "place")


# -- end to end ------------------------------------------------------------------------------------------------------
CLASSES = {"context_event": "event", "context_segment": "event", "context_entity": "entity", "context_summary": "summary", "context_compression_event": "summary"}


def retrieve(records: DataFrame, postings: DataFrame, query: str, scope: dict, asking: str | None, budget: int, max_refs: int = MAX_REFS, filters: bool = False) -> DataFrame:
    """The context for one query: ``ref_hash, class, score, tokens, reason`` of its best candidates, in order of score.

    Understanding, scope, index filter (``filters``), score, the best ``MAX_CANDIDATES``, and the packer under a token budget."""
    p, kind = understanding.plan(query), understanding.kind_of_question(query)
    found = scan(records, postings, SERVED, scope, None, p.filter_groups if filters else []).filter("dropped is null").drop("dropped")
    top = best(native_score(found, query, asking))
    kinds = F.lit("other")
    for record_type, name in CLASSES.items():
        kinds = F.when(F.col("record_type") == record_type, name).otherwise(kinds)
    ready = top.select(
        F.lit(1).alias("query_id"), "ref_hash", "score", F.coalesce(F.col("tokens"), F.lit(1)).cast("bigint").alias("tokens"), kinds.alias("class"), "continuity", "session_id",
        F.sha2(F.concat_ws("|", "record_type", F.lower(F.trim("text"))), 256).alias("signature"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("phase"), F.lit(False).alias("stale"))
    packed = pack(ready, "query_id", Budgets(budget, max_refs), cross_session(kind, budget, bool(asking)), kind)
    return packed.select("ref_hash", "class", "score", "tokens", "reason")


def inject(blocks: DataFrame, query: str, prompts: DataFrame, rank: str, text: str, max_tokens: int) -> DataFrame:
    """``query, prompt, selected_tokens, n_selected, n_blocked``: each prompt (``query, prompt``) with the blocks that fit beside it, in order of ``rank``.

    Tokens are words between white space. A block too large for what is left is passed over. Blocks and prompts meet in one task per query; blocks are
    what a pack has selected, a bounded list.
    """
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    rows = blocks.select(F.col(query), F.struct(F.col(rank).alias("rank"), words(F.col(text)).alias("n"), F.col(text).alias("text")).alias("b")).groupBy(query).agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    start = F.struct(F.greatest(F.lit(max_tokens) - words(F.col("prompt")), F.lit(0)).alias("left"), F.array().cast("array<string>").alias("texts"))
    taken = F.aggregate(
        "blocks", start, lambda s, x: F.when(x["n"] <= s["left"], F.struct((s["left"] - x["n"]).alias("left"), F.concat(s["texts"], F.array(x["text"])).alias("texts"))).otherwise(s))
    out = prompts.join(rows, query, "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(rows.schema["blocks"].dataType))).withColumn("_t", taken)
    body = F.when(F.size("_t.texts") > 0, F.concat(F.col("prompt"), F.lit("\n\n<context>\n"), F.array_join("_t.texts", "\n"), F.lit("\n</context>"))).otherwise(F.col("prompt"))
    room = F.greatest(F.lit(max_tokens) - words(F.col("prompt")), F.lit(0))
    return out.select(query, body.alias("prompt"), (room - F.col("_t.left")).alias("selected_tokens"), F.size("_t.texts").alias("n_selected"), (F.size("blocks") - F.size("_t.texts")).alias("n_blocked"))
