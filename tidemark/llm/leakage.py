"""Evaluation passages inside training documents, by winnowing.

Texts become sequences of words (runs of letters and digits, lower case). Every k-gram of words is hashed; of every window
of w consecutive hashes the least is kept as a fingerprint. Two texts that share k + w - 1 words in a row share a whole window
and so its least hash: with k + w - 1 = ``span`` no shared span of that length is missed. Fingerprints of both sides are joined and every
hit is extended over equal words to both sides, which drops chance collisions and spans that are too short.

Where the items' fingerprints are few (``broadcast_words`` bounds the items' words, checked before anything is sent), documents
are fingerprinted, matched and extended in one pass without a shuffle. Otherwise fingerprints are shuffle-joined on the hash, and
only documents with hits are read again for the extension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

SPAN, GRAM = 12, 6
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in order, number of words of each text). A null text has no words."""
    texts = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
    parts = pc.split_pattern_regex(pc.fill_null(pc.utf8_lower(texts), ""), r"[^\p{L}\p{N}]+")
    flat = parts.flatten()
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ids = flat.dictionary_encode()
    hashes = pd.util.hash_array(ids.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(ids.dictionary) else np.empty(0, np.uint64)
    hashed = hashes[ids.indices.to_numpy(zero_copy_only=False)]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    kept = np.concatenate([[0], np.cumsum(real)])
    return hashed[real], np.diff(kept[bounds])


def grams(w: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k-gram that starts at each word, whether it lies within one text)."""
    n = len(w)
    h = np.zeros(n, np.uint64)
    ends = np.repeat(np.cumsum(counts), counts)
    valid = np.arange(n) + k <= ends
    with np.errstate(over="ignore"):
        for j in range(k):
            shifted = np.zeros(n, np.uint64)
            shifted[: max(n - j, 0)] = w[j:]
            h = _mix(h * _M + shifted + np.uint64(j + 1))
    return h, valid


def fingerprints(h: np.ndarray, valid: np.ndarray, counts: np.ndarray, w: int) -> np.ndarray:
    """Positions kept by winnowing: the (rightmost) least hash of every window of w hashes within one text; a text with fewer
    hashes than w is one window."""
    n = len(h)
    if not n:
        return np.empty(0, np.int64)
    doc_end = np.repeat(np.cumsum(counts), counts)
    doc_start = np.repeat(np.cumsum(counts) - counts, counts)
    k_tail = np.add.reduceat(~valid, np.flatnonzero(np.concatenate([[True], doc_start[1:] != doc_start[:-1]])))
    last = doc_end - np.repeat(k_tail, counts[counts > 0])  # end of the valid hashes of each text
    big = np.where(valid, h, np.uint64(2**64 - 1))
    best = np.arange(n)
    low = big.copy()
    for j in range(1, w):
        other = np.full(n, np.uint64(2**64 - 1))
        other[: max(n - j, 0)] = big[j:]
        take = (np.arange(n) + j < last) & (other <= low)
        low = np.where(take, other, low)
        best = np.where(take, np.arange(n) + j, best)
    whole = (np.arange(n) + w <= last) | ((np.arange(n) == doc_start) & valid)  # full windows, or the first of a short text
    return np.unique(best[whole])


def _extend(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """Length of the longest run of equal words around a[i] = b[j]."""
    back, m = 0, min(i, j)
    while back < m and a[i - back - 1] == b[j - back - 1]:
        back += 1
    on, m = 0, min(len(a) - i, len(b) - j)
    while on < m and a[i + on] == b[j + on]:
        on += 1
    return back + on


def _prints(k: int, w: int):
    """mapInArrow over (id, text): (h, id, pos) of every fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, counts = words(batch.column(1))
            h, valid = grams(hashed, counts, k)
            at = fingerprints(h, valid, counts, w)
            owner = np.repeat(np.arange(len(counts)), counts)[at]
            pos = at - (np.cumsum(counts) - counts)[owner]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[owner], pa.int64()), pa.array(pos, pa.int64())], names=["h", "id", "pos"])

    return run


def _match(items: dict, span: int, k: int, w: int):
    """mapInArrow over (id, text): (id, item) of all documents against a bounded set of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(items["h"], kind="stable")
        keys, who, where = items["h"][order], items["who"][order], items["pos"][order]
        for batch in batches:
            hashed, counts = words(batch.column(1))
            h, valid = grams(hashed, counts, k)
            at = fingerprints(h, valid, counts, w)
            lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            hit = np.flatnonzero(hi > lo)
            starts = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(counts)), counts)
            found = set()
            for x in hit:
                d = int(owner[at[x]])
                mine = hashed[starts[d] : starts[d] + counts[d]]
                for y in range(lo[x], hi[x]):
                    item = int(who[y])
                    if (d, item) not in found and _extend(mine, items["words"][item], int(at[x] - starts[d]), int(where[y])) >= span:
                        found.add((d, item))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(ids[d]) for d, _ in pairs], pa.int64()), pa.array([int(items["ids"][i]) for _, i in pairs], pa.int64())], names=["doc_id", "item_id"])

    return run


def _confirm(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, na = words(batch.column(3))
            b, nb = words(batch.column(4))
            sa, sb = np.cumsum(na) - na, np.cumsum(nb) - nb
            i, j = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            good = [any(_extend(a[sa[r] : sa[r] + na[r]], b[sb[r] : sb[r] + nb[r]], x, y) >= span for x, y in zip(i[r], j[r])) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0).field("doc_id").filter(pa.array(good)), batch.column(0).field("item_id").filter(pa.array(good))], names=["doc_id", "item_id"])

    return run


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", span: int = SPAN, gram: int = GRAM, broadcast_words: int = 2_000_000) -> DataFrame:
    """Distinct ``doc_id, item_id`` with at least ``span`` words in a row common to both texts.

    Ids are BIGINT; rows without an id are left out. Null, empty and too short texts leak nothing. Repeated rows of an id count as
    further texts of it. Other columns are ignored. There is no cap on hits: a passage in a third of all documents is reported for each.
    """
    spark, w = docs.sparkSession, span - gram + 1
    d = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    e = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    size = e.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= 4 * broadcast_words:  # a word takes at least two bytes with its separator
        rows = e.toArrow().combine_chunks()
        hashed, counts = words(rows["text"].combine_chunks())
        h, valid = grams(hashed, counts, gram)
        at = fingerprints(h, valid, counts, w)
        owner = np.repeat(np.arange(len(counts)), counts)[at]
        starts = np.cumsum(counts) - counts
        known = {"h": h[at], "who": owner, "pos": at - starts[owner], "ids": rows["id"].to_numpy(zero_copy_only=False), "words": [hashed[s : s + c] for s, c in zip(starts, counts)]}
        return d.mapInArrow(_match(known, span, gram, w), "doc_id bigint, item_id bigint").distinct()
    made = "h bigint, id bigint, pos bigint"
    # texts of one id are told apart by a row number of their own
    dk = cut(d.withColumn("k", F.monotonically_increasing_id()))
    ek = cut(e.withColumn("k", F.monotonically_increasing_id()))
    df = dk.select("k", "text").mapInArrow(_prints(gram, w), made).select("h", F.col("id").alias("dk"), F.col("pos").alias("i"))
    ef = ek.select("k", "text").mapInArrow(_prints(gram, w), made).select("h", F.col("id").alias("ek"), F.col("pos").alias("j"))
    # hits of a pair are gathered by blocks of both texts, so that no list grows with them; any hit leads to the whole span around it
    blocks = [F.floor(F.col(c) / BLOCK).alias(f"{c}_block") for c in "ij"]
    hits = df.join(ef, "h").groupBy("dk", "ek", *blocks).agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j"))
    both = (
        hits.join(dk.select(F.col("k").alias("dk"), F.col("id").alias("doc_id"), F.col("text").alias("a")), "dk")
        .join(ek.select(F.col("k").alias("ek"), F.col("id").alias("item_id"), F.col("text").alias("b")), "ek")
        .select(F.struct("doc_id", "item_id").alias("ids"), "i", "j", "a", "b")
    )
    return both.mapInArrow(_confirm(span), "doc_id bigint, item_id bigint").distinct()


#: Words of either text in one block of hits.
BLOCK = 1024


def report(found: DataFrame) -> DataFrame:
    """How many documents each leaked item stands in: ``item_id, n_docs``."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
