"""Skills: parsed from markdown with front matter, kept in a registry, selected for a query."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import understanding

# fixed values
LISTS = {"triggers": ["triggers", "trigger", "activation"], "allowed_tools": ["allowed_tools", "allowed_tool", "tools", "tooling"], "tags": ["tags", "tag", "categories", "category"], "models": ["models", "model", "providers", "provider"]}
OFF = frozenset("false 0 no disabled off inactive".split())
PRECEDENCE = {"low": 0, "0": 0, "high": 200, "2": 200, "critical": 300, "highest": 300, "3": 300}
NORMAL, SCOPE_BASE, PER_TRIGGER, PER_WORD = 100, 60, 25, 5
SKILL = "source_ref string, skill_name string, description string, version string, owner_scope string, enabled boolean, precedence int, triggers array<string>, allowed_tools array<string>, tags array<string>, models array<string>"


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """(keys and values between two lines of dashes at the start, the rest); list items under a key are joined by commas."""
    lines = text.lstrip("\ufeff").splitlines()
    if not lines or lines[0].strip() != "---":
        return {}, text
    out: dict[str, str] = {}
    key = None
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            return out, "\n".join(lines[i + 1 :])
        if line.lstrip().startswith("- ") and key:
            out[key] = ", ".join(x for x in (out[key], line.lstrip()[2:].strip()) if x)
        elif ":" in line:
            key, _, value = line.partition(":")
            key = key.strip().lower()
            out[key] = value.strip().strip("\"'")
    return {}, text


def _listed(found: dict[str, str], keys: list[str]) -> list[str]:
    values = [v.strip().strip("\"'") for k in keys for v in found.get(k, "").strip("[]").split(",")]
    return list(dict.fromkeys(v for v in values if v))


def parse(docs: DataFrame, uri: str, text: str) -> DataFrame:
    """One row of ``SKILL`` for every text. The name falls back to the file's, the description to the first paragraph; null texts give none."""

    def one(ref: str | None, t: str) -> tuple:
        found, rest = front_matter(t)
        name = found.get("name") or (ref or "").rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0] or "skill"
        first = next((p.strip() for p in rest.split("\n\n") if p.strip() and not p.lstrip().startswith("#")), "")
        state = found.get("enabled", found.get("status", "")).lower()
        on = state not in OFF and ("disabled" not in found or found["disabled"].lower() in OFF)
        owner = found.get("owner_scope") or found.get("owner") or "user"
        rank = PRECEDENCE.get((found.get("precedence") or found.get("priority") or "").lower(), NORMAL)
        return (ref, name, found.get("description") or first, found.get("version", "unknown"), owner, on, rank, *(_listed(found, LISTS[k]) for k in ("triggers", "allowed_tools", "tags", "models")))

    names = [x.split()[0] for x in SKILL.split(", ")]
    texts = pa.list_(pa.string())
    kinds = [pa.string()] * 5 + [pa.bool_(), pa.int32()] + [texts] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(r, t) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col(uri).cast("string"), F.col(text).cast("string")).mapInArrow(run, SKILL)


def registry(log: DataFrame, seq: str = "seq") -> DataFrame:
    """One entry per ``skill_name`` out of a log of entries and partial updates: of every field its last value that is not null, and ``version_changes``,
    how often the version differs from the one before."""
    from pyspark.sql import Window as W

    fields = [c for c in log.columns if c not in ("skill_name", seq)]
    before = F.last("version", ignorenulls=True).over(W.partitionBy("skill_name").orderBy(seq).rowsBetween(W.unboundedPreceding, -1))
    told = log.withColumn("_changed", F.when(F.col("version").isNotNull() & before.isNotNull() & (F.col("version") != before), 1).otherwise(0))
    return told.groupBy("skill_name").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in fields), F.sum("_changed").alias("version_changes"))


def select(entries: DataFrame, query: str, scope_rank: Column, tool: str = "", limit: int = 10, include_disabled: bool = False) -> DataFrame:
    """The registry's best skills for a query: ``entries`` plus ``matched_triggers`` and ``score``, at most ``limit``, best first.

    Left out are disabled skills and those whose allowed tools do not hold ``tool`` (no list allows all). ``scope_rank`` is how near the skill's scope is, 0
    nearest. The score adds precedence, nearness, triggers that the query names and words of the query in name, description and tags."""
    terms, low = understanding.plan(query).terms, query.lower()
    named = lambda t: F.lit(low).contains(F.lower(t))
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("triggers", "allowed_tools", "tags")}

    def hit(trigger: Column) -> Column:
        out = named(trigger)
        for t in terms:
            out = out | F.lower(trigger).contains(t)
        return out

    rows = entries.filter(F.lit(include_disabled) | F.coalesce("enabled", F.lit(True)))
    if tool:
        rows = rows.filter((F.size(lists["allowed_tools"]) == 0) | F.exists(lists["allowed_tools"], lambda a: F.lower(a) == tool.lower()))
    words = F.lit(0)
    for t in terms:
        words = words + F.when(F.lower("skill_name").contains(t) | F.lower(F.coalesce("description", F.lit(""))).contains(t) | F.lower(F.array_join(lists["tags"], "\n")).contains(t), 1).otherwise(0)
    matched = F.filter(lists["triggers"], hit)
    precedence = F.coalesce("precedence", F.lit(NORMAL))
    score = precedence + F.lit(SCOPE_BASE) - scope_rank + F.size(matched) * PER_TRIGGER + words * PER_WORD + 1
    ranked = rows.withColumn("matched_triggers", matched).withColumn("_rank", scope_rank).withColumn("score", score)
    return ranked.orderBy(F.col("score").desc(), precedence.desc(), "_rank", "skill_name").limit(max(limit, 1)).drop("_rank")
