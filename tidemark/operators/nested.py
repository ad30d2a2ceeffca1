"""Flat child tables out of nested JSON payloads, by vectorised structural indexing.

All payloads of an Arrow batch are indexed as one byte buffer. Whole-array steps give (1) the quotes that are not
escaped, (2) the in-string mask as the parity of their running count, (3) the structural bytes ``{ } [ ] : ,`` outside
strings and (4) the nesting depth of each as a prefix sum. A span of JSON is then a pair of positions in that index,
its members are the structural bytes of depth + 1 inside it, and the walk down to the children only follows spans;
values that are no child are skipped without being parsed. Strings that hold JSON are indexed in a second round
of the same procedure.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "seq bigint, child string, child_key string, parent_key string, value string"

#: (field of the payload, tables made from it)
_ROOTS = ("envelope", "memory_layer_budget", "selected_refs")


_SPACE, _OTHER, _MARK, _QUOTE, _SLASH = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[ord(c) for c in " \t\r\n"]] = _SPACE
_CLASS[[ord(c) for c in "{}[],:"]] = _MARK
_CLASS[ord('"')], _CLASS[ord("\\")] = _QUOTE, _SLASH
_ESCAPES = np.zeros(256, bool)
_ESCAPES[[ord(c) for c in '"\\/bfnrtu']] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_SCALAR = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")

# token codes, and what may follow what within an object or an array
_TOKENS = "{}[],:sxk"  # s a string, x a number or word, k a string that is a key
_CODE = np.zeros(256, np.uint8)
for _c in "{}[],:":
    _CODE[ord(_c)] = _TOKENS.index(_c)
_STRING, _WORD, _KEY = 6, 7, 8
_FOLLOWS = np.zeros((3, 9, 9), bool)  # container (0 none, 1 object, 2 array), token, next token
for _k, _pairs in ((1, ["{k}", ",k", ":sx{[", "k:", "s,}", "x,}", "},}", "],}"]), (2, ["[sx{[]", ",sx{[", "s,]", "x,]", "},]", "],]"])):
    for _p in _pairs:
        for _n in _p[1:]:
            _FOLLOWS[_k, _TOKENS.index(_p[0]), _TOKENS.index(_n)] = True


class StructuralIndex:
    """Positions, kinds and depths of the structural bytes of a buffer of concatenated documents, and which of these are whole JSON."""

    def __init__(self, docs: list[bytes]):
        self.data = b"\n".join(docs)
        buf = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        ends = np.cumsum(lengths + 1) - 1
        self.starts = ends - lengths
        self.ends = ends
        bad = np.zeros(len(docs) + 1, bool)
        kinds = _CLASS[buf]
        # a byte after an odd run of backslashes is escaped
        quote = np.flatnonzero(kinds == _QUOTE)
        slash = np.flatnonzero(kinds == _SLASH)
        escape = slash[:0]
        if len(slash):
            heads = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
            nth = np.arange(len(slash)) - np.repeat(heads, np.diff(np.append(heads, len(slash))))
            escape = slash[nth % 2 == 0]
            after = np.minimum(np.searchsorted(escape, quote - 1), len(escape) - 1)
            quote = quote[escape[after] != quote - 1]
        # parity of the running count of quotes, restarted at each document so that a broken one spoils no other
        first_quote = np.searchsorted(quote, self.starts)
        counts = np.diff(np.append(first_quote, len(quote)))
        bad[:-1] |= counts % 2 == 1

        toggle = np.zeros(len(buf) + 1, np.uint8)
        toggle[quote] = 1
        toggle[ends[bad[:-1]]] = 1
        inside = (np.cumsum(toggle, dtype=np.uint8) & 1).view(bool)[:-1]  # the bitmap of what lies in strings
        self.pos = np.flatnonzero((kinds == _MARK) & ~inside)
        doc = np.searchsorted(ends, self.pos)
        self.kind = buf[self.pos]
        opening = (self.kind == 123) | (self.kind == 91)
        closing = (self.kind == 125) | (self.kind == 93)
        step = opening.astype(np.int64) - closing
        depth = np.cumsum(step)
        first = np.searchsorted(self.pos, self.starts)
        at_start = np.concatenate([[0], depth])[first]
        level = depth - at_start[doc]  # open containers after each byte
        self.depth = level - opening  # of the container a byte opens, closes or divides
        # the partner of every opening byte: the next closing byte of its depth
        self.partner = np.full(len(self.pos), -1, np.int64)
        order = np.lexsort((np.arange(len(self.pos)), self.depth - (step == 0), doc))
        o = order[step[order] != 0]
        if len(o):
            pair = (step[o[:-1]] > 0) & (step[o[1:]] < 0) & (doc[o[:-1]] == doc[o[1:]]) & (self.depth[o[:-1]] == self.depth[o[1:]])
            self.partner[o[:-1][pair]] = o[1:][pair]
        self._check(buf, kinds, quote, first_quote, escape, inside, doc, opening, level, bad)
        self.whole = ~bad[:-1]
        # separators by depth: the members of a container are found by one slice
        self.sep = {}
        seps = np.flatnonzero(step == 0)
        sep_depth = self.depth[seps]
        by_depth = np.argsort(sep_depth, kind="stable")
        depths, first = np.unique(sep_depth[by_depth], return_index=True)
        for d, v in zip(depths, np.split(seps[by_depth], first[1:])):
            self.sep[int(d)] = v
        self._freeze()

    def _check(self, buf, kinds, quote, first_quote, escape, in_string, doc, opening, level, bad) -> None:
        """Marks in ``bad`` the documents that are not one whole JSON value."""
        n = len(buf)
        # escapes stand in strings and are known; a u has four hexadecimal digits
        if len(escape):
            follow = buf[np.minimum(escape + 1, n - 1)]
            wrong = ~in_string[escape] | ~_ESCAPES[follow]
            u = escape[follow == 117]
            bad[np.searchsorted(self.ends, escape[wrong])] = True
            four = np.minimum(u[:, None] + np.arange(2, 6), n - 1)
            bad[np.searchsorted(self.ends, u[~_HEX[buf[four]].all(1)])] = True
        bad[np.searchsorted(self.ends, np.flatnonzero((buf < 32) & in_string))] = True
        # runs of other bytes outside strings are numbers and words
        other = np.flatnonzero((kinds == _OTHER) & ~in_string)
        heads = np.flatnonzero(np.diff(other, prepend=-2) != 1)
        tails = np.append(heads[1:], len(other)) - 1 if len(other) else heads
        word = other[heads]
        word_doc = np.searchsorted(self.ends, word)
        spans = [self.data[a : b + 1] for a, b in zip(word.tolist(), other[tails].tolist())]
        good = {x: _SCALAR.fullmatch(x) is not None for x in set(spans)}
        bad[word_doc[~np.fromiter(map(good.__getitem__, spans), bool, len(spans))]] = True
        # the container in which the gap after each structural byte lies: of the bytes with that depth, the last that opened one
        order = np.lexsort((np.arange(len(self.pos)), level, doc))
        opened = np.maximum.accumulate(np.where(opening[order], np.arange(len(order)), -1)) if len(order) else order
        holder = np.where(opened >= 0, order[np.maximum(opened, 0)], -1)
        fits = (holder >= 0) & (level[order] > 0) & (doc[holder] == doc[order]) & (level[holder] == level[order])
        inside = np.zeros(len(self.pos), np.uint8)
        inside[order] = np.where(fits, np.where(self.kind[holder] == 123, 1, 2), 0)
        # all tokens in order, strings by their opening quote
        doc_of_quote = np.searchsorted(self.ends, quote)
        even = (np.arange(len(quote)) - first_quote[doc_of_quote]) % 2 == 0
        text, text_doc = quote[even], doc_of_quote[even]
        where = np.concatenate([self.pos, text, word])
        by = np.argsort(where, kind="stable")
        code = np.concatenate([_CODE[self.kind], np.full(len(text), _STRING, np.uint8), np.full(len(word), _WORD, np.uint8)])[by]
        owner = np.concatenate([doc, text_doc, word_doc])[by]
        context = np.concatenate([inside, np.full(len(text) + len(word), 255, np.uint8)])[by]
        known = np.maximum.accumulate(np.where(context != 255, np.arange(len(by)), -1)) if len(by) else by
        same = (known >= 0) & (owner[np.maximum(known, 0)] == owner)
        context = np.where(same, context[np.maximum(known, 0)], 0)
        start = np.ones(len(by), bool)
        start[1:] = owner[1:] != owner[:-1]
        key = np.zeros(len(by), bool)
        key[1:] = (code[1:] == _STRING) & ~start[1:] & (context[:-1] == 1) & ((code[:-1] == 0) | (code[:-1] == 4))
        code = np.where(key, _KEY, code)
        follows = start[1:] | _FOLLOWS[context[:-1], code[:-1], code[1:]]
        bad[owner[1:][~follows]] = True
        bad[owner[start & ~np.isin(code, (0, 2, _STRING, _WORD))]] = True
        last = np.ones(len(by), bool)
        last[:-1] = start[1:]
        bad[owner[last & (context != 0)]] = True
        empty = np.ones(len(bad), bool)
        empty[owner] = False
        bad |= empty

    def _freeze(self) -> None:
        """Plain lists for the walk, which looks single entries up."""
        self.sep = {d: v.tolist() for d, v in self.sep.items()}
        self.pos, self.kind, self.depth, self.partner = self.pos.tolist(), self.kind.tobytes(), self.depth.tolist(), self.partner.tolist()

    def members(self, opening: int) -> list[tuple[int, int, int]]:
        """(start, end, colon) byte spans of the members of the container that index entry ``opening`` opens; colon
        is the position of the key's colon, -1 in an array."""
        closing = self.partner[opening]
        start, end = self.pos[opening] + 1, self.pos[closing]
        seps = self.sep.get(self.depth[opening] + 1, ())
        out, colon, kind, pos = [], -1, self.kind, self.pos
        for i in seps[bisect_left(seps, opening) : bisect_left(seps, closing)]:
            if kind[i] == 58:
                colon = pos[i]
            else:
                out.append((start, pos[i], colon))
                start = pos[i] + 1
        if out or self.data[start:end].strip():
            out.append((start, end, colon))
        return out

    def opening(self, start: int, end: int) -> int | None:
        """The index entry of the container that fills the span, or None for a scalar."""
        i = bisect_left(self.pos, start)
        return i if i < len(self.pos) and self.pos[i] < end and self.kind[i] in (123, 91) else None

    def text(self, start: int, end: int) -> bytes:
        return self.data[start:end].strip()

    def null(self, start: int, end: int) -> bool:
        return (end - start < 64 or self.opening(start, end) is None) and self.data[start:end].strip() == b"null"

    def fields(self, opening: int) -> dict[str, tuple[int, int]]:
        """Keys and value spans of an object; of a repeated key the last counts."""
        data, out = self.data, {}
        for a, b, c in self.members(opening):
            raw = data[a:c].strip()
            out[raw[1:-1].decode("utf-8", "surrogatepass") if b"\\" not in raw else _key(raw)] = (c + 1, b)
        return out

    def field(self, opening: int, name: bytes) -> tuple[int, int] | None:
        """The value span of one key of an object, None if it has none; spans that cannot hold the key are not looked into."""
        a, b = self.pos[opening], self.pos[self.partner[opening]]
        if self.data.find(name, a, b) < 0 and self.data.find(b"\\", a, b) < 0:
            return None
        return self.fields(opening).get(name.decode())


def _key(raw: bytes) -> str:
    if b"\\" not in raw:
        return raw[1:-1].decode("utf-8", "surrogatepass")
    return json.loads(raw).encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # half a surrogate pair is no character


def _elements(ix: StructuralIndex, span: tuple[int, int]) -> list[tuple[int, tuple[int, int]]]:
    """(position, span) of the elements of a list that are not null; a single value is a list of one."""
    opening = ix.opening(*span)
    if opening is None or ix.kind[opening] != 91:
        return [] if ix.null(*span) else [(0, span)]
    return [(i, (a, b)) for i, (a, b, _) in enumerate(ix.members(opening)) if not ix.null(a, b)]


def _walk(ix: StructuralIndex, root: str, span: tuple[int, int]) -> Iterator[tuple[str, str, str, tuple[int, int]]]:
    """(child, child_key, parent_key, span of the value) rows under one root."""

    def fields(s: tuple[int, int]) -> dict[str, tuple[int, int]]:
        opening = ix.opening(*s)
        return ix.fields(opening) if opening is not None and ix.kind[opening] == 123 else {}

    def field(s: tuple[int, int], name: bytes) -> tuple[int, int] | None:
        opening = ix.opening(*s)
        return ix.field(opening, name) if opening is not None and ix.kind[opening] == 123 else None

    if root == "envelope":
        if messages := field(span, b"messages"):
            for i, m in _elements(ix, messages):
                yield "message", f"{i}", "", m
                if attachments := field(m, b"attachments"):
                    for j, a in _elements(ix, attachments):
                        yield "attachment", f"{i}/{j}", f"{i}", a
    elif root == "memory_layer_budget":
        for bucket, b in fields(span).items():
            for label, v in fields(b).items():
                if not ix.null(*v):
                    yield "budget", f"{bucket}/{label}", bucket, v
    else:
        for i, r in _elements(ix, span):
            yield "ref", f"{i}", "", r
            if terms := field(r, b"matched_index_terms"):
                for j, t in _elements(ix, terms):
                    yield "term", f"{i}/{j}", f"{i}", t


def _shred(seqs: list, payloads: list[str], values: bool = True) -> list[tuple]:
    keep = [(s, p.encode("utf-8", "surrogatepass")) for s, p in zip(seqs, payloads) if p is not None]
    out: list[tuple] = []
    inner: list[tuple[int, str, bytes]] = []  # strings that hold JSON
    if not keep:
        return out

    def rows(ix, seq, root, span):
        if values:
            return [(seq, c, k, p, ix.text(*v)) for c, k, p, v in _walk(ix, root, span)]
        return [(seq, c, k, p) for c, k, p, _ in _walk(ix, root, span)]

    ix = StructuralIndex([p for _, p in keep])
    for k in np.flatnonzero(ix.whole).tolist():
        seq, opening = keep[k][0], ix.opening(int(ix.starts[k]), int(ix.ends[k]))
        if opening is None or ix.kind[opening] != 123:
            continue
        top = ix.fields(opening)
        for root in _ROOTS:
            if (span := top.get(root)) is None:
                continue
            if ix.opening(*span) is None and (value := ix.text(*span))[:1] == b'"':
                inner.append((seq, root, json.loads(value).encode("utf-8", "surrogatepass")))
            else:
                out += rows(ix, seq, root, span)
    if inner:
        ix = StructuralIndex([d for _, _, d in inner])
        for k in np.flatnonzero(ix.whole).tolist():
            seq, root, _ = inner[k]
            out += rows(ix, seq, root, (int(ix.starts[k]), int(ix.ends[k])))
    return out


def children(df: DataFrame, key: str = "seq", payload: str = "payload", values: bool = True) -> DataFrame:
    """All child rows of the payloads: ``seq, child, child_key, parent_key, value`` (value is the child's JSON text, left out without ``values``).

    ``child`` is message, attachment, budget, ref or term; ``child_key`` its place (positions from 0), ``parent_key``
    the place of its parent within the record, empty for children of the record itself. A payload that is null, unreadable or
    not one whole JSON object has no children (depth of nesting is no matter); null elements are no children but are counted by positions; a single value
    where a list belongs is a list of one; a string that holds JSON in place of a root is read as that JSON. Of a repeated key
    the last counts. Half a surrogate pair in a label comes out as U+FFFD. NaN and Infinity are no JSON. Rows are independent, so there is no shuffle; rows sent twice give their children twice. ``key`` may be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("seq", pa.int64()), ("child", pa.string()), ("child_key", pa.string()), ("parent_key", pa.string()), *[("value", pa.string())] * values])
        for batch in batches:
            seqs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(seqs):  # slices of about 4 MB of text, so that the index of a batch of very long payloads stays small
                size, stop = 0, at
                while stop < len(seqs) and (stop == at or size < 4_000_000):
                    size += len(texts[stop] or "")
                    stop += 1
                rows = _shred(seqs[at:stop], texts[at:stop], values)
                at = stop
                if rows:
                    cols = list(zip(*rows))
                    if values:
                        cols[4] = [v.decode("utf-8", "replace") for v in cols[4]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return df.select(df[key].cast("bigint"), df[payload].cast("string")).mapInArrow(run, SCHEMA if values else SCHEMA.removesuffix(", value string"))


def child_table(df: DataFrame, child: str, key: str = "seq", payload: str = "payload") -> DataFrame:
    """One flat table of :func:`children`: the rows of one kind, without the ``child`` column."""
    return children(df, key, payload).filter(f"child = '{child}'").drop("child")
