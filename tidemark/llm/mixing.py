"""A training mix with a target share of tokens per source, by capped water-filling.

Sizes are tokens of a public tokenizer, counted over every document. Each source may be used at most its cap of repetitions; a source that
cannot fill its share is clamped at its cap and what is missing is spread over the others in proportion to their weights, until nothing exceeds
a cap. A source used 2.3 times takes each of its documents twice and a seeded 0.3 of its tokens a third time. Which documents these are is
decided by a seeded hash of the id against a threshold, found from a histogram of hash slices, so a source with a third of all documents is
never sorted in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import cut

TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: How the public vocabulary's byte-pair encoding splits a text before merging (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICES = 65_536


def token_counts(df: DataFrame, text: str, name: str = "tokens", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``text`` replaced by BIGINT ``name``: its tokens under a ranked byte-pair vocabulary; 0 for null and empty texts."""
    at = df.columns.index(text)
    kinds = [(c if i != at else name, t if i != at else "bigint") for i, (c, t) in enumerate(df.dtypes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(f"{folder}/{vocabulary}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array([len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names=[c for c, _ in kinds])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kinds))


def folded(source: Column) -> Column:
    """One spelling of a source name: trimmed, lower case, words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def water_fill(total: float, weights: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Amounts that sum to ``total`` (or to all caps, if less), in proportion to the weights but for the sources clamped at their caps."""
    out = {k: 0.0 for k in weights}
    free = {k: w for k, w in weights.items() if w > 0 and caps.get(k, 0) > 0}
    left = min(total, sum(caps[k] for k in free))
    while free:
        scale = left / sum(free.values())
        over = [k for k, w in free.items() if w * scale >= caps[k]]
        if not over:
            return out | {k: w * scale for k, w in free.items()}
        for k in over:
            out[k] = caps[k]
            left -= caps[k]
            del free[k]
        left = max(left, 0.0)
    return out


def largest_exact(weights: dict[str, float], caps: dict[str, float]) -> float:
    """The largest total at which no source that has documents is clamped."""
    there = {k: w for k, w in weights.items() if w > 0 and caps.get(k, 0) > 0}
    return min((caps[k] / w for k, w in there.items()), default=0.0) * sum(there.values())


def plan(sizes: dict[str, float], targets: list[tuple[str, float, int]], total: float | None = None, stretch: float = 1.0) -> dict[str, dict]:
    """Per source: target share, amount of tokens, repetitions. ``total`` None takes :func:`largest_exact`, where every source present
    reaches its share (shares of sources without documents are spread over the rest), times ``stretch``; above 1, the scarcest sources
    stay at their caps and the others fill up."""
    weights = {s: w or 0.0 for s, w, _ in targets}
    caps = {s: sizes.get(s, 0) * max(m or 0, 0) for s, _, m in targets}
    amounts = water_fill(largest_exact(weights, caps) * stretch if total is None else total, weights, caps)
    return {s: {"target": weights[s], "amount": amounts[s], "times": amounts[s] / sizes[s] if sizes.get(s) else 0.0} for s in weights}


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, total: float | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, stretch: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): ``doc_id, source, tokens, repeats`` of every document used, and ``source, target_share, available_tokens, used_tokens,
    actual_share, times`` of every target source.

    ``targets`` has source, target_share and max_repeats, one row per source (it is collected: the list of sources to mix is small by nature,
    and more than 100,000 raise an error). Documents of null or unlisted sources are not used; sources are compared in one spelling;
    rows repeated for an id are separate documents; empty texts have no tokens and are not used. A null share or cap counts as 0.
    ``total`` and ``stretch`` are those of :func:`plan`.
    """
    spark = docs.sparkSession
    rows = targets.groupBy(folded(F.col("source")).alias("source")).agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("m")).filter("source is not null").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 target sources")
    listed = F.broadcast(spark.createDataFrame([(r["source"],) for r in rows], "source string"))
    used = docs.select(F.col(doc_id).alias("doc_id"), folded(F.col(source)).alias("source"), F.col(text).alias("text")).join(listed, "source", "left_semi")
    counted = cut(token_counts(used.select("doc_id", "source", "text"), "text", folder=folder, vocabulary=vocabulary).filter("tokens > 0")
                  .withColumn("u", F.xxhash64(F.col("doc_id"), F.lit(seed))).withColumn("slice", F.shiftrightunsigned("u", 48)))
    slices = cut(counted.groupBy("source", "slice").agg(F.sum("tokens").alias("t")))
    sizes = {r["source"]: float(r["t"]) for r in slices.groupBy("source").agg(F.sum("t").alias("t")).collect()}  # a row per target source
    planned = plan(sizes, [(r["source"], r["w"], r["m"]) for r in rows], total, stretch)
    whole = {s: min(int(p["times"] + 1e-9), 2**31 - 1) for s, p in planned.items()}
    facts = F.broadcast(spark.createDataFrame(
        [(s, whole[s], max(0.0, (p["times"] - whole[s]) * sizes.get(s, 0.0))) for s, p in planned.items()], "source string, whole int, extra double"))
    # the slice of hash values in which a source's extra tokens run out; within it, documents by hash
    upto = F.sum("t").over(W.partitionBy("source").orderBy("slice"))
    edge = slices.join(facts, "source").withColumn("upto", upto).filter((F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("t") <= F.col("extra")))
    edge = F.broadcast(edge.select("source", F.col("slice").alias("edge"), (F.col("extra") - (F.col("upto") - F.col("t"))).alias("room")))  # a row per source
    placed = counted.join(facts, "source").join(edge, "source", "left")
    inside = F.sum("tokens").over(W.partitionBy("source", "slice").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    at_edge = placed.filter("slice = edge").withColumn("more", (inside <= F.col("room")).cast("int"))
    away = placed.filter("edge is null or slice <> edge").withColumn("more", F.when(F.col("edge").isNull() | (F.col("slice") < F.col("edge")), F.lit(1)).otherwise(0))
    away = away.withColumn("more", F.when(F.col("extra") > 0, F.col("more")).otherwise(0))
    chosen = away.unionByName(at_edge).withColumn("repeats", F.col("whole") + F.col("more")).filter("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    known = spark.createDataFrame([(s, p["target"], int(sizes.get(s, 0))) for s, p in planned.items()], "source string, target_share double, available_tokens bigint")
    taken = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"))
    shares = known.join(taken, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    everything = W.partitionBy(F.lit(1))  # a row per target source
    shares = shares.withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.sum("used_tokens").over(everything), F.lit(0.0)))
    return chosen, shares.withColumn("times", F.when(F.col("available_tokens") > 0, F.col("used_tokens") / F.col("available_tokens")).otherwise(0.0))
