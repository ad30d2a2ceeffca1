"""Reading level of documents, from the surprisal of interpolated n-gram models.

Labelled examples train four word models (bigrams interpolated with unigrams): of easy prose, of hard prose, of prose that could be
rated and of texts that could not (logs, other languages). A document is read whole, sentence by sentence; the difference of mean
surprisal under the easy and the hard model places each sentence, and the difference under the last two tells prose from the rest, or, if it is small, nothing. The
document's score is the mean of the middle half of its prose sentences, so one quoted passage does not move it, and isotonic regression on labelled
documents held out from the models maps the score to the graded scale. A document whose words are not mostly in prose sentences has no level.

All labelled documents train the models, counted by Spark, and all rated ones make the map, each scored by the models without its own words. Scoring covers every
document. Models of up to ``MAX_PAIRS`` word pairs are sent with the task, and scoring is one pass over the table without a shuffle; larger ones stay tables, to which
the words of the documents are joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

#: Most labelled documents whose numbers are sent to the tasks; beyond it documents and labels are shuffle-joined.
MAX_IDS = 1_000_000
#: Most word pairs of models that are sent to the tasks.
MAX_PAIRS = 2_000_000
#: Largest size of the texts of a sample together, in bytes; what would go beyond it is left out of the sample. Only for callers that ask for a sample.
MAX_BYTES = 64_000_000
_CLASSES = ("easy", "middle", "hard", "other")
#: The models, and the classes of labelled documents that train each.
_MODELS = {"easy": ("easy",), "hard": ("hard",), "prose": ("easy", "middle", "hard"), "other": ("other",)}
_WEIGHT, _FLOOR = 5.0, 0.5  # of the unigrams among the bigrams; of a word that a model has not seen
_LEAST_WORDS = 3  # a shorter sentence says nothing
_CLEAR = 1.0  # nor does one that prose and the rest give with less difference a word, such as a passage found in both


def sentences(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all words in order, words per sentence, sentences per text). Markup tags and digits' values are dropped; case is folded."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    t = pc.replace_substring_regex(t, r"<[^<>\n]*>", " ")
    t = pc.replace_substring_regex(pc.utf8_lower(t), r"[0-9]+", " 0 ")
    s = pc.split_pattern_regex(t, r"[.!?]+\s+|\n+")
    per_text = pc.list_value_length(s).to_numpy(zero_copy_only=False).astype(np.int64)
    w = pc.split_pattern_regex(s.flatten(), r"[^\p{L}\p{N}]+")
    flat = w.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64))])
    kept = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)), np.diff(kept[bounds]), per_text


def _ids(words: pa.Array, vocab: pa.Array) -> np.ndarray:
    """Number of each word in the vocabulary from 2 on; 1 for words that are not in it (0 is the start of a sentence)."""
    if not len(words):
        return np.empty(0, np.int64)
    d = words.dictionary_encode()
    known = pc.fill_null(pc.index_in(d.dictionary, value_set=vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(known < 0, 1, known + 2)[d.indices.to_numpy(zero_copy_only=False)]


def _before(ids: np.ndarray, per_sentence: np.ndarray) -> np.ndarray:
    prev = np.concatenate([[0], ids[:-1]]) if len(ids) else ids
    starts = (np.cumsum(per_sentence) - per_sentence)[per_sentence > 0]
    prev[starts] = 0
    return prev


def _own(owner: np.ndarray, classes: np.ndarray, **values: np.ndarray) -> dict[str, np.ndarray]:
    """Per word: the class and the length of its text, and how often its text has each of the word's ``values``."""
    own = {"class": classes[owner], "total": np.bincount(owner, minlength=len(classes))[owner] if len(owner) else owner}
    for name, v in values.items():
        _, place, count = np.unique(owner * (v.max(initial=0) + 1) + v, return_inverse=True, return_counts=True)
        own[name] = count[place]
    return own


class Models:
    """The four interpolated models over one vocabulary, from the counts of every pair of neighbouring words by class (``prev`` is empty at the start of a sentence)."""

    def __init__(self, counts: pa.Table):
        counts = counts.combine_chunks()
        prev, word = (pc.cast(counts[k].combine_chunks(), pa.large_string()) for k in ("prev", "word"))
        self.vocab = pc.unique(word)
        self.size = len(self.vocab) + 2
        ids = _ids(word, self.vocab)
        before = np.where(pc.equal(prev, "").to_numpy(zero_copy_only=False), 0, _ids(prev, self.vocab))
        key = before * self.size + ids
        order = np.argsort(key)
        self.pairs = key[order]
        by_class = {c: counts[c].to_numpy().astype(float) for c in _CLASSES}
        self.n, self.u, self.h, self.total = {}, {}, {}, {}
        for m, classes in _MODELS.items():
            n = sum(by_class[c] for c in classes)
            self.n[m] = np.append(n[order], 0.0)
            self.u[m] = np.bincount(ids, n, self.size) + _FLOOR
            self.h[m] = np.bincount(before, n, self.size)
            self.total[m] = self.u[m].sum()

    def surprisal(self, which: str, ids: np.ndarray, prev: np.ndarray, at: np.ndarray, own: dict | None) -> np.ndarray:
        """Of each word; with ``own`` as if the word's text had not been among those that the models were fitted on."""
        n, u, h, total = self.n[which][at], self.u[which][ids], self.h[which][prev], self.total[which]
        if own is not None:
            mine = np.isin(own["class"], [_CLASSES.index(c) for c in _MODELS[which]])
            n, u, h, total = n - mine * own["n"], u - mine * own["u"], h - mine * own["h"], total - mine * own["total"]
        return -np.log((n + _WEIGHT * u / total) / (h + _WEIGHT))

    def lookup(self, ids: np.ndarray, prev: np.ndarray) -> np.ndarray:
        """Place of each word pair in the tables; the last, empty place for pairs no model knows."""
        k = prev * self.size + ids
        at = np.searchsorted(self.pairs, k)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == k, at, len(self.pairs)) if len(self.pairs) else np.zeros(len(k), np.int64)

    def score(self, texts: pa.Array, classes: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Per text: sentences of prose, share of words in prose among those in sentences that tell, and the quartiles and midmean of the prose sentences' scores (NaN without any).

        ``classes`` are those of texts that the models were fitted on; each is then scored by the models without its own words."""
        words, per_sentence, per_text = sentences(texts)
        n_texts = len(per_text)
        ids = _ids(words, self.vocab)
        prev = _before(ids, per_sentence)
        at = self.lookup(ids, prev)
        bounds = np.concatenate([[0], np.cumsum(per_sentence)])
        own = None if classes is None else _own(np.repeat(np.repeat(np.arange(n_texts), per_text), per_sentence), classes, n=at, u=ids, h=prev)

        def mean(a: str, b: str) -> np.ndarray:
            total = np.concatenate([[0.0], np.cumsum(self.surprisal(a, ids, prev, at, own) - self.surprisal(b, ids, prev, at, own))])
            return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(per_sentence, 1)

        hard, prose = mean("easy", "hard"), mean("other", "prose")
        owner = np.repeat(np.arange(n_texts), per_text)
        clear = (per_sentence >= _LEAST_WORDS) & (np.abs(prose) > _CLEAR)
        good = clear & (prose > 0)
        size = np.bincount(owner[clear], per_sentence[clear], n_texts)
        share = np.bincount(owner[good], per_sentence[good], n_texts) / np.maximum(size, 1)
        o, h = owner[good], hard[good]
        order = np.lexsort((h, o))
        h = h[order]
        count = np.bincount(o, minlength=n_texts)
        first = np.cumsum(count) - count
        out = {"n_sentences": count, "prose_share": share}
        for name, q in (("low", 0.25), ("middle", 0.5), ("high", 0.75)):
            value = np.full(n_texts, np.nan)
            some = count > 0
            x = q * (count[some] - 1)
            lo = np.floor(x).astype(np.int64)
            a = h[first[some] + lo]
            b = h[first[some] + np.minimum(lo + 1, count[some] - 1)]
            value[some] = a + (b - a) * (x - lo)
            out[name] = value
        # the mean of the middle half: as deaf to a few foreign sentences as the median, but it sees a mixture of two kinds
        total = np.concatenate([[0.0], np.cumsum(h)])
        start, stop = first + count // 4, first + count - count // 4
        out["score"] = np.where(count > 0, (total[stop] - total[start]) / np.maximum(stop - start, 1), np.nan)
        return out


def pooled(blocks: Iterable[tuple[float, float, float, float]]) -> list[list[float]]:
    """Blocks of (sum, count, least x, largest x) in order of x, with neighbours pooled until the means rise. Pooling parts first gives the same."""
    out: list[list[float]] = []
    for block in blocks:
        out.append(list(block))
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            s, n, _, hi = out.pop()
            out[-1][0] += s
            out[-1][1] += n
            out[-1][3] = hi
    return out


def _knots(blocks: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    xs = np.array([v for b in blocks for v in ((b[2], b[3]) if b[3] > b[2] else (b[2],))])
    ys = np.array([b[0] / b[1] for b in blocks for _ in range(2 if b[3] > b[2] else 1)])
    return xs, ys


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares monotone fit of y on x (pool adjacent violators), to be interpolated linearly."""
    order = np.argsort(x, kind="stable")
    return _knots(pooled((b, 1, a, a) for a, b in zip(x[order], y[order])))


def isotonic_of(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The same for the columns ``score, y`` of a table: slices of the scores are pooled by the tasks, and what is left of them by the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("s", "n", "lo", "hi"))))
        blocks = pooled(rows)
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*blocks)], names=["s", "n", "lo", "hi"])

    x = F.col("score")
    one = cut(points.groupBy(x).agg(F.sum("y").alias("s"), F.count("y").cast("double").alias("n")).select("s", "n", x.alias("lo"), x.alias("hi")))
    left = one.repartitionByRange("lo").sortWithinPartitions("lo").mapInArrow(run, "s double, n double, lo double, hi double").collect()
    return _knots(pooled(sorted(map(tuple, left), key=lambda b: b[2])))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, level: str, limit: int) -> tuple[list[str], list[float | None]]:
    """Texts and mean levels of at most ``limit`` labelled documents, the lowest by hash of their id, one text each and ``MAX_BYTES`` together."""
    means = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.avg(level).alias("y"))
    n = means.count()
    if n > 4 * limit:  # the lowest hashes lie below this bound; it only spares every task from sending `limit` candidates to the driver
        low = means.filter(F.xxhash64("id") < int(-(2.0**63) + 2.0**64 * 2 * limit / n))
        means = low if low.count() >= limit else means
    chosen = means.orderBy(F.xxhash64("id"), "id").limit(limit)
    said = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id")
    # one text of an id, the shortest; at most ``limit`` rows, whose sizes are known before any text is fetched
    one = cut(said.groupBy("id").agg(F.min(F.struct(F.octet_length("t").alias("n"), "t")).alias("s"), F.first("y").alias("y")))
    fits, total = [], 0
    for r in sorted(one.select("id", "s.n").collect(), key=lambda r: (hash((r["id"] * 0x9E3779B97F4A7C15) % 2**61), r["id"])):
        if total + r["n"] <= MAX_BYTES:
            total += r["n"]
            fits.append(r["id"])
    rows = one.filter(F.col("id").isin(fits)).select("id", F.col("s.t").alias("t"), "y").collect()
    rows.sort(key=lambda r: (hash((r["id"] * 0x9E3779B97F4A7C15) % 2**61), r["id"], r["t"]))
    return [r["t"] for r in rows], [r["y"] for r in rows]


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, level: str) -> DataFrame:
    """``t, y`` of every labelled document: its text (the shortest, if its id has several) and its mean level, null for a text that cannot be rated."""
    means = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.avg(level).alias("y"))
    said = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"))
    said = said.join(F.broadcast(means) if means.count() <= MAX_IDS else means, "id")
    return said.groupBy("id").agg(F.min(F.struct(F.octet_length("t").alias("n"), "t")).alias("s"), F.first("y").alias("y")).select("s.t", "y")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            yield whole.slice(at, 2000)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, word and word before it by their place in the names, words per sentence, sentences per text); the first name is empty, for the start of a sentence."""
    words, per_sentence, per_text = sentences(texts)
    vocab = pc.unique(words)
    ids = _ids(words, vocab)
    return pa.concat_arrays([pa.array(["", ""], words.type), vocab]), ids, _before(ids, per_sentence), per_sentence, per_text


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        names, ids, prev, per_sentence, per_text = _words(batch.column(0))
        of = np.repeat(np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), per_text), per_sentence)
        key, n = np.unique((prev * len(names) + ids) * len(_CLASSES) + of, return_counts=True)
        pair, c = np.divmod(key, len(_CLASSES))
        before, word = np.divmod(pair, len(names))
        cols = [names.take(pa.array(v)).cast(pa.string()) for v in (before, word)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(c, pa.int32()), pa.array(n, pa.int64())], names=["prev", "word", "c", "n"])


_SCORED = "n_sentences bigint, prose_share double, low double, score double, high double"
_NAMES = [c.split()[0] for c in _SCORED.split(", ")]


def _placed(batch: pa.RecordBatch, knots: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    """With the level of each text, if there is a map."""
    if knots is None:
        return batch
    score, share = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(float) for k in ("score", "prose_share"))
    value = np.where((share > 0.5) & ~np.isnan(score), np.interp(score, *knots), np.nan)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, from_pandas=True), *batch.columns[1:]], names=["k", "level", *_NAMES])


def _scored(rows: DataFrame, models: Models, kind: str, knots: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``k`` of every row (of type ``kind``), its ``level`` if there is a map, and the scores of its text ``t``; with a class ``c``, without its own words."""
    own, level = "c" in rows.columns, "" if knots is None else "level double, "

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            s = models.score(b.column(1), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) if own else None)
            yield _placed(pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[k], from_pandas=True) for k in _NAMES)], names=["k", *_NAMES]), knots)

    return rows.select("k", "t", *["c"] * own).mapInArrow(run, f"k {kind}, {level}{_SCORED}")


def _scored_by_join(rows: DataFrame, pairs: DataFrame, kind: str, knots: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The same with the models left in Spark: each word of the texts is joined to the counts of its pair, of itself and of the word before it."""
    own = "c" in rows.columns
    mine = ["class", "total", "n", "u", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            names, ids, prev, per_sentence, per_text = _words(b.column(2))
            owner = np.repeat(np.repeat(np.arange(b.num_rows), per_text), per_sentence)
            cols = [owner, np.repeat(np.arange(len(per_sentence)), per_sentence)]
            if own:
                o = _own(owner, b.column(3).to_numpy(zero_copy_only=False).astype(np.int64), n=prev * len(names) + ids, u=ids, h=prev)
                cols += [o[k] for k in mine]
            silent = np.setdiff1d(np.arange(b.num_rows), owner)  # a text without words has a row without a word
            cols = [np.concatenate([c, silent if i == 0 else np.zeros(len(silent), np.int64)]) for i, c in enumerate(cols)]
            said = [pa.concat_arrays([names.take(pa.array(v)).cast(pa.string()), pa.nulls(len(silent), pa.string())]) for v in (prev, ids)]
            who = pa.array(cols[0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(who), b.column(1).take(who), pa.array(cols[1], pa.int64()), *said, *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["row", "k", "sentence", "prev", "word", *(["own_" + k for k in mine] if own else [])])

    schema = f"row bigint, k {kind}, sentence bigint, prev string, word string" + "".join(f", own_{k} bigint" for k in mine) * own
    said = rows.select(F.monotonically_increasing_id().alias("row"), "k", "t", *["c"] * own).mapInArrow(run, schema)
    sums = lambda by, to: pairs.groupBy(by).agg(*(F.sum(c).alias(f"{to}_{c}") for c in _CLASSES))
    words = cut(sums("word", "u"))
    whole = words.agg(F.count("*").alias("size"), *(F.sum(f"u_{c}").alias(c) for c in _CLASSES)).first()
    joined = said.join(pairs.select("prev", "word", *(F.col(c).alias(f"n_{c}") for c in _CLASSES)), ["prev", "word"], "left").join(words, "word", "left").join(sums("prev", "h"), "prev", "left")

    def surprisal(which: str) -> Column:
        classes = _MODELS[which]
        is_mine = F.col("own_class").isin([_CLASSES.index(c) for c in classes]).cast("int") if own else None
        count = lambda k: sum((F.coalesce(f"{k}_{c}", F.lit(0)) for c in classes), F.lit(0.0)) - (is_mine * F.col(f"own_{k}") if own else 0)
        total = F.lit(sum(whole[c] for c in classes) + _FLOOR * (whole["size"] + 2)) - (is_mine * F.col("own_total") if own else 0)
        return -F.log((count("n") + _WEIGHT * (count("u") + _FLOOR) / total) / (count("h") + _WEIGHT))

    joined = joined.select("row", "k", "sentence", "word", (surprisal("easy") - surprisal("hard")).alias("hard"), (surprisal("other") - surprisal("prose")).alias("prose"))
    each = joined.groupBy("row", "k", "sentence").agg(F.count("word").alias("n"), F.avg("hard").alias("hard"), F.avg("prose").alias("prose"))
    clear = (F.col("n") >= _LEAST_WORDS) & (F.abs("prose") > _CLEAR)
    good = clear & (F.col("prose") > 0)
    texts = each.groupBy("row", "k").agg(
        F.sum(F.when(clear, F.col("n")).otherwise(0)).alias("size"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("good"), F.sort_array(F.collect_list(F.when(good, F.col("hard")))).alias("hs"))
    m = F.size("hs")

    def quartile(q: float) -> Column:
        x = q * (m - 1)
        a = F.get("hs", F.floor(x).cast("int"))
        return a + (F.get("hs", F.least(F.floor(x).cast("int") + 1, m - 1)) - a) * (x - F.floor(x))

    quarter = F.floor(m / 4).cast("int")
    half = F.slice("hs", quarter + 1, F.greatest(m - 2 * quarter, F.lit(0)))
    score = F.when(m > 0, F.aggregate(half, F.lit(0.0), lambda s, v: s + v) / F.size(half))
    some = lambda c: F.when(m > 0, c)
    out = texts.select("k", m.cast("bigint").alias("n_sentences"), (F.col("good") / F.greatest("size", F.lit(1))).alias("prose_share"),
                        some(quartile(0.25)).alias("low"), score.alias("score"), some(quartile(0.75)).alias("high"))
    return out if knots is None else out.mapInArrow(lambda batches: (_placed(b, knots) for b in batches), f"k {kind}, level double, {_SCORED}")


def _scorer(models: Models | DataFrame):
    return _scored if isinstance(models, Models) else _scored_by_join


def fit(known: DataFrame, easy: float = 2.5, hard: float = 3.5):
    """(models, or the table of their counts if that is large; knots of the map) from ``t, y``; None if the examples lack easy or hard prose."""
    y = F.col("y")
    rated = y.isNotNull() & ~F.isnan("y")
    known = cut(known.select(y.cast("double").alias("k"), "t", F.when(~rated, 3).when(y <= easy, 0).when(y >= hard, 2).otherwise(1).alias("c")))
    if not {0, 2} <= {r["c"] for r in known.select("c").distinct().collect()}:
        return None
    counts = known.select("t", "c").mapInArrow(_counted, "prev string, word string, c int, n bigint").groupBy("prev", "word")
    pairs = cut(counts.agg(*(F.sum(F.when(F.col("c") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(_CLASSES))))
    models = Models(pairs.toArrow()) if pairs.count() <= MAX_PAIRS else pairs
    scored = _scorer(models)(known.filter(F.col("c") != 3), models, "double")
    xs, ys = isotonic_of(scored.filter("score IS NOT NULL AND prose_share > 0.5").select("score", F.col("k").alias("y")))
    return (models, xs, ys) if len(xs) else None


def levels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", level: str = "reading_level", max_labelled: int | None = None) -> DataFrame:
    """``doc_id, level, n_sentences, prose_share, low, score, high`` of every document.

    ``level`` is DOUBLE on the scale of the labels, null for a document whose words are not mostly in rateable prose (null and empty texts
    among them); low and high are the quartiles of the sentences' surprisal differences, score is the mean of what lies between. Several ratings of a document are
    averaged; a null rating marks a text that cannot be rated. All labelled documents are used, one text an id; only a caller that gives ``max_labelled`` gets
    models and map of a sample. Without examples of both easy and hard prose no document gets a level.
    Repeated rows of a document give a row each; ids may be null; other columns are ignored.
    """
    if max_labelled is None:
        known = labelled(docs, labels, doc_id, text, level)
    else:
        known = docs.sparkSession.createDataFrame(list(zip(*labelled_sample(docs, labels, doc_id, text, level, max_labelled))), "t string, y double")
    fitted = fit(known)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    if fitted is None:
        nothing = F.lit(None).cast("double")
        return rows.select(F.col("k").alias("doc_id"), nothing.alias("level"), F.lit(0).cast("bigint").alias("n_sentences"), F.lit(0.0).alias("prose_share"), *(nothing.alias(k) for k in ("low", "score", "high")))
    models, *knots = fitted
    return _scorer(models)(rows, models, "bigint", tuple(knots)).withColumnRenamed("k", "doc_id")
