"""Content processing: chunks, keywords, segments, summaries, episodes and posting compaction."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1400, 120
_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most ``size`` characters; past its half a piece prefers to end at a blank line, then at a sentence;
    the next piece starts ``overlap`` characters before that end."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for mark in ("\n\n", ". "):
                k = text.rfind(mark, at + size // 2, end)
                if k > 0:
                    end = k + len(mark)
                    break
        out.append((at, end))
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def units(text: str) -> list[tuple[str, int, int, int]]:
    """(heading path, level, start, end) of the parts under each markdown heading; a text without headings is one unit."""
    path: list[tuple[int, str]] = []
    out, start, at, fenced = [], 0, 0, False

    def close(end: int) -> None:
        if text[start:end].strip():
            out.append((" / ".join(t for _, t in path), path[-1][0] if path else 0, start, end))

    for line in text.splitlines(keepends=True):
        if line.startswith("```"):
            fenced = not fenced
        m = None if fenced else _HEADING.match(line.rstrip("\n"))
        if m:
            close(at)
            start = at
            level = len(m[1])
            path = [p for p in path if p[0] < level] + [(level, m[2].strip())]
        at += len(line)
    close(len(text))
    return out


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, chunk, path, level, start, end, content`` of every document, in order; null and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = 0
                for path, level, s, e in units(t or ""):
                    for x, y in split_text(t[s:e], size, overlap):
                        rows.append((d, n, path, level, s + x, s + y, t[s + x : s + y]))
                        n += 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "chunk", "path", "level", "start", "end", "content"])

    return docs.select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, "doc_id bigint, chunk int, path string, level int, start bigint, `end` bigint, content string")


def keywords(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 12, least: int = 4) -> DataFrame:
    """``doc_id, term, n`` of the most frequent terms of each row's text (letters only, ``least`` or more), ties in alphabetical order. All words of a text
    are in its row, so they are counted there, many rows at a time, and nothing is shuffled. Null and empty texts have no terms; repeated rows give theirs each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                low = pc.utf8_lower(pc.fill_null(batch.column(1).cast(pa.large_string()), ""))
                split = pc.split_pattern_regex(low, "[^a-z]+")
                words = split.flatten()
                owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(split).to_numpy(zero_copy_only=False))
                long = pc.greater_equal(pc.utf8_length(words), least)
                words, owner = words.filter(long), owner[long.to_numpy(zero_copy_only=False)]
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                place = np.empty(len(coded.dictionary), np.int64)
                place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))  # alphabetical
                pairs, counts = np.unique(owner * len(place) + place[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
                doc, word = pairs // len(place), pairs % len(place)
                order = np.lexsort((word, -counts, doc))
                doc, word, counts = doc[order], word[order], counts[order]
                start = np.concatenate([[True], doc[1:] != doc[:-1]])
                rank = np.arange(len(doc)) - np.maximum.accumulate(np.where(start, np.arange(len(doc)), 0))
                top = rank < n
                back = coded.dictionary.take(pa.array(np.argsort(place)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[top])), back.take(pa.array(word[top])).cast(pa.string()), pa.array(counts[top], pa.int64())], names=["doc_id", "term", "n"])

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string"))
    return out.mapInArrow(run, f"doc_id {dict(out.dtypes)['doc_id']}, term string, n bigint").withColumnRenamed("doc_id", doc_id)


#: Words that tell of a change or a time, and what such a sentence is worth beyond its figures and names (fixed values).
FACT_MARKERS = ["now", "changed", "updated", "corrected", "correction", "instead", "no longer", "moved", "switched", "rescheduled", "deadline", "because", "after", "before"]
FACT_DIGITS, FACT_MARKER, LEAD_WORDS, FACT_WORDS, FACTS, RICH_SENTENCES, RICH_WORDS = 3, 2, 18, 32, 7, 3, 180


def sentences(text: Column) -> Column:
    """The sentences of a text, trimmed, blank ones left out; a full stop, question or exclamation mark or line end closes one."""
    return F.filter(F.transform(F.split(text, "[.\\n!?]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def _rest(items: Column) -> Column:
    """All but the first element."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def fact_score(sentence: Column) -> Column:
    """How much a sentence tells: figures, names beyond the first word, and markers of change."""
    names = F.size(F.filter(_rest(F.filter(F.split(sentence, r"\s+"), lambda w: w != "")), lambda w: w.rlike("^[A-Z]")))
    score = F.when(sentence.rlike("[0-9]"), FACT_DIGITS).otherwise(0) + names
    for m in FACT_MARKERS:
        score = score + F.when(F.lower(sentence).contains(m), FACT_MARKER).otherwise(0)
    return score


def lead(text: Column, words: int = LEAD_WORDS, title: Column | None = None) -> Column:
    """L0: the title and the first sentence, ``words`` words together."""
    first = F.coalesce(F.try_element_at(sentences(text), F.lit(1)), F.trim(text))
    return first_words(first if title is None else F.concat(title, F.lit(": "), first), words)


def rich(text: Column) -> Column:
    """Whether a text carries enough for an L1: three sentences or 180 words."""
    return (F.size(sentences(text)) >= RICH_SENTENCES) | (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= RICH_WORDS)


def summary(text: Column, kind: Column, title: Column) -> Column:
    """L1: the lead and the sentences that tell most, each cut to 32 words; null where the text is too thin. The earlier of equal sentences goes first."""
    said = sentences(text)
    scored = F.transform(_rest(said), lambda s, i: F.struct((-fact_score(s)).alias("worth"), i.alias("at"), s.alias("s")))
    told = F.concat(F.slice(said, 1, 1), F.transform(F.slice(F.array_sort(scored), 1, FACTS), lambda x: x["s"]))
    facts = F.array_join(F.transform(told, lambda s: first_words(s, FACT_WORDS)), " | ")
    return F.when(rich(text), F.concat(F.lit("kind="), kind, F.lit("; title="), title, F.lit("; key_facts="), facts))


#: What makes a message worth keeping, and its worth; small talk is worth nothing (fixed values).
FILLER = "hi|hello|hey|thanks|thank you|ok|okay|cool|great|sounds good".split("|")
SALIENT = [
    (r"\b(recursion|base case|merge sort|algorithm|complexity|efficiency|dynamic programming|graph|game)\b", 0.55), (r"\b(prefer|favorite|approved|budget|plan|correction|instead|current|remember|important|moved|moving|located|location|live|lives)\b", 0.45),
    (r"\b(is|means|because|therefore|warning|avoid|must|should|cannot|can|require|requires|required|blocked|blocker)\b", 0.2), (r"\b(\d{2,}|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december)\b", 0.1),
]
SALIENT_BASE, SALIENT_LONG, LONG_WORDS, LEAST_SALIENT, MOST_SEGMENTS = 0.2, 0.15, 8, 0.5, 12
#: Topics by their words, the first that fits (fixed values).
TOPICS = [
    ("recursion", "recursion|recursive|base case|merge sort|call stack"), ("game_algorithm", "game|minimax|alpha beta|pathfinding|npc"), ("preference", "prefer|favorite|likes|loves"),
    ("location", "moved|moving|located|location|live|lives|staying"), ("approval_budget", "approved|approval|budget|cost|purchase"), ("incident_runbook", "incident|runbook|alert|outage|rollback|postmortem"),
    ("task_decision", "decision|decided|owner|owns|deadline|checklist|reviewer|require|requires|required"), ("metric_sla", "metric|latency|p95|p99|qps|sla|error rate"), ("plan_status", "plan|current|status|going to|will"), ("correction", "correction|instead|wrong|changed|updated"),
]
WORD = "[a-z0-9_]+"


def saliency(text: Column) -> Column:
    """How much a message is worth keeping, 0 to 1; 0 for small talk, null and less than eight letters."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    plain = F.trim(F.regexp_replace(low, "[^a-z0-9 ]+", ""))
    score = F.lit(SALIENT_BASE)
    for pattern, worth in SALIENT:
        score = score + F.when(low.rlike(pattern), worth).otherwise(0.0)
    score = score + F.when(F.regexp_count(low, F.lit(WORD)) >= LONG_WORDS, SALIENT_LONG).otherwise(0.0)
    return F.when(plain.isin(FILLER) | (F.length(plain) < 8), 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 6))


def topic(text: Column) -> Column:
    """A message's topic: the first whose words it holds, else its first word of five letters or more, else ``general``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), "")
    for name, words in TOPICS:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words.split("|")]), name)
    return out.otherwise(F.coalesce(F.nullif(F.regexp_extract(low, "([a-z0-9_]{5,})", 1), F.lit("")), F.lit("general")))


def topic_segments(rows: DataFrame, by: str, idx: str, text: str, most: int = MOST_SEGMENTS) -> DataFrame:
    """``by, topic, ranges, n, saliency``: the salient messages of every conversation by topic, as contiguous ranges of their places (``first-last`` joined by commas), the ``most``
    segments of highest mean saliency, then by topic."""
    told = rows.select(by, idx, topic(F.col(text)).alias("topic"), saliency(F.col(text)).alias("_s"))
    runs = segments(told, by, idx, "topic", "_s", LEAST_SALIENT)
    spans = F.array_sort(F.collect_list(F.struct("first", F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")).alias("r"))))
    whole = runs.groupBy(by, "topic").agg(F.array_join(F.transform(spans, lambda x: x["r"]), ",").alias("ranges"), F.sum("n").alias("n"), F.round(F.sum(F.col("saliency") * F.col("n")) / F.sum("n"), 6).alias("saliency"))
    place = F.row_number().over(W.partitionBy(by).orderBy(F.col("saliency").desc(), "topic"))
    return whole.withColumn("_p", place).filter(F.col("_p") <= most).drop("_p")


CHUNK_TOKENS, OVERLAP_TOKENS = 240, 24
_PIECE = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]+")


def token_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """``doc_id, chunk, first_token, n_tokens, content`` of every document with white space compacted: pieces of at most ``size`` words and marks, ending at a sentence past their half where there is one, each
    starting ``overlap`` before the end of the one before. Null and blank texts have none."""

    def pieces(t: str) -> Iterator[tuple[int, int, str]]:
        spans = [m.span() for m in _PIECE.finditer(t)]
        at = 0
        while at < len(spans):
            end = min(len(spans), at + size)
            if end < len(spans):
                stop = next((i for i in range(end - 1, at + size // 2, -1) if t[spans[i - 1][1] : spans[i - 1][1] + 1] in (".", "!", "?", ";") or t[spans[i - 1][0] : spans[i - 1][1]] in (".", "!", "?", ";")), None)
                end = stop or end
            yield at, end - at, t[spans[at][0] : spans[end - 1][1]]
            if end >= len(spans):
                return
            at = max(end - overlap, at + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows = [(d, n, *p) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, p in enumerate(pieces(" ".join((t or "").split())))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "chunk", "first_token", "n_tokens", "content"])

    return docs.select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, "doc_id bigint, chunk int, first_token bigint, n_tokens bigint, content string")


def budgeted_terms(terms: DataFrame, record: str, operation: str, term: str, at: str, priorities: list[str], per_record: int = 10, per_operation: int = 128) -> DataFrame:
    """``terms`` with ``kept``: of every record its first ``per_record`` distinct terms by priority (the place of the term's prefix in ``priorities``, then ``at``), and of every operation at most ``per_operation``
    of those, in order of record and place. A term repeated in its record counts once, at its first place."""
    rank = F.lit(len(priorities))
    for i, p in reversed(list(enumerate(priorities))):
        rank = F.when(F.col(term).startswith(p), i).otherwise(rank)
    once = terms.filter(F.coalesce(term, F.lit("")) != "").groupBy(operation, record, term).agg(F.min(at).alias(at))
    own = once.withColumn("_r", F.row_number().over(W.partitionBy(operation, record).orderBy(rank, at, term)))
    fits = own.filter(F.col("_r") <= per_record).withColumn("_o", F.row_number().over(W.partitionBy(operation).orderBy(record, "_r")))
    return own.select(operation, record, term, at).join(fits.filter(F.col("_o") <= per_operation).select(operation, record, term, F.lit(True).alias("_k")), [operation, record, term], "left").select(
        operation, record, term, at, F.coalesce("_k", F.lit(False)).alias("kept"))


def segments(rows: DataFrame, by: str, idx: str, topic: str, saliency: str, least: float = 0.0) -> DataFrame:
    """Contiguous runs of one topic: ``by, topic, first, last, n, saliency`` (mean), rows below ``least`` left out beforehand."""
    w = W.partitionBy(by, topic).orderBy(idx)
    runs = rows.filter(F.col(saliency) >= least).withColumn("_g", F.col(idx) - F.row_number().over(w))
    return runs.groupBy(by, topic, "_g").agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count(F.lit(1)).alias("n"), F.avg(saliency).alias("saliency")).drop("_g")


def episodes(rows: DataFrame, session: str, ts: str, role: str, tool: str, order: list[str] = ()) -> DataFrame:
    """``session, episode, signature``: every user turn opens an episode; its signature is the sequence of tools used until the next,
    repeats in a row once. Episodes without tools are left out."""
    w = W.partitionBy(session).orderBy(ts, *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    told = rows.withColumn("episode", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(w))
    steps = told.filter(F.col(tool).isNotNull() & (F.col("episode") > 0)).groupBy(session, "episode").agg(F.array_sort(F.collect_list(F.struct(ts, *order, tool))).alias("s"))
    seq = steps.withColumn("s", F.transform("s", lambda x: x[tool]))
    return seq.select(session, "episode", F.array_join(F.filter("s", lambda x, i: (i == 0) | (x != F.col("s")[i - 1])), ">").alias("signature"))


def skills(found: DataFrame, session: str, support: int = 3, steps: int = 2, most: int = 64) -> DataFrame:
    """Signatures with enough steps and support: ``signature, support, sessions``, the most supported first."""
    rows = found.groupBy("signature").agg(F.count(F.lit(1)).alias("support"), F.count_distinct(session).alias("sessions"))
    return rows.filter((F.col("support") >= support) & (F.size(F.split("signature", ">")) >= steps)).orderBy(F.col("support").desc(), "signature").limit(most)


def compact_postings(postings: DataFrame, by: list[str], at: str, ref: str, bucket_ms: int = 60_000, chunk: int = 512) -> DataFrame:
    """Postings grouped by key and time bucket into chunks of at most ``chunk`` distinct refs: ``by, bucket_ms, part, refs``.
    The part of a ref follows from its rank, so no group is gathered whole."""
    rows = postings.select(*by, (F.col(at) - F.pmod(F.col(at), F.lit(bucket_ms))).alias("bucket_ms"), ref).distinct()
    part = F.floor((F.row_number().over(W.partitionBy(*by, "bucket_ms").orderBy(ref)) - 1) / chunk).cast("int")
    return rows.withColumn("part", part).groupBy(*by, "bucket_ms", "part").agg(F.array_sort(F.collect_list(ref)).alias("refs"))


WORST = 0.45
_PATCH = re.compile(r"<<+ SEARCH\n(.*?)\n?==+\n(.*?)\n?>>+ REPLACE", re.S)


def parse_patch(block: str) -> list[tuple[str, str]]:
    """(search, replacement) of every SEARCH/REPLACE block of a patch."""
    return [(m[1], m[2]) for m in _PATCH.finditer(block)]


def patch_entity(text: str, search: str, replacement: str, worst: float = WORST) -> str | None:
    """``text`` with the span nearest to ``search`` replaced: an exact one, else the run of as many words with the least edit distance relative
    to its length, at most ``worst``; None if nothing is near. Distances are cut off at what could still be the best."""
    if search in text:
        return text.replace(search, replacement, 1)
    words = list(re.finditer(r"\S+", text))
    k = len(search.split())
    best, near = None, worst
    for i in range(len(words) - k + 1 if k else 0):
        s, e = words[i].start(), words[i + k - 1].end()
        size = max(len(search), e - s, 1)
        if abs(len(search) - (e - s)) > near * size:
            continue
        d = _distance(text[s:e], search, int(near * size)) / size
        if d <= near and (best is None or d < best[0]):
            best, near = (d, s, e), d
    return text[: best[1]] + replacement + text[best[2] :] if best else None


def patched(rows: DataFrame, text: str, search: str, replacement: str) -> DataFrame:
    """``rows`` with ``patched``: exact spans are replaced by expression; only texts without one are looked through for a near span, a batch at a time."""
    exact = F.col(text).contains(search)
    done = rows.filter(exact).withColumn("patched", F.concat(F.substring_index(text, search, 1), F.lit(replacement), F.expr(f"substring(`{text}`, length(substring_index(`{text}`, '{search}', 1)) + {len(search)} + 1)")))
    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if t is None else patch_entity(t, search, replacement) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "patched"])

    return done.unionByName(rows.filter(~F.coalesce(exact, F.lit(False))).mapInArrow(run, f"{types}, patched string"))


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or any number above ``most`` where it is above; only a band of that width is filled."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i if i <= most else most + 1
        for j in range(lo, hi + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]
