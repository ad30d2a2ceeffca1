"""Token counts, normalisation and small text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whitespace_tokens(text: Column) -> Column:
    """Words between white space, at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\s+"), lambda t: t != "")))


def byte_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4).cast("int"))


def word_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, lower-cased first."""
    return F.regexp_count(F.lower(text), F.lit("[a-z0-9_]+"))


def compact(text: Column, limit: int | None = None) -> Column:
    """White space runs as single spaces, trimmed; cut to ``limit`` characters with an ellipsis at the end."""
    c = F.trim(F.regexp_replace(text, r"\s+", " "))
    return c if limit is None else F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def redact_tokens(text: Column) -> Column:
    """White-space tokens with an @ and a dot become [redacted-email], those with eight or more digits [redacted-id]; single spaces between."""
    digits = lambda t: F.length(F.regexp_replace(t, "[^0-9]", ""))
    mark = lambda t: F.when(t.contains("@") & t.contains("."), F.lit("[redacted-email]")).when(digits(t) >= 8, F.lit("[redacted-id]")).otherwise(t)
    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), mark), " ")


def glob(pattern: str) -> str:
    """A key pattern (* ? [..]) as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i + 1 : j]
            out.append("[" + ("^" + body[1:] if body[:1] in "^!" else body).replace("\\", "\\\\") + "]")
            i = j
        else:
            out.append({"*": ".*", "?": "."}.get(c) or ("\\" + c if not c.isalnum() and c != "_" else c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def byte_range(value: Column, start: int, end: int) -> Column:
    """Bytes (BINARY) of the UTF-8 text from ``start`` to ``end`` inclusive; negative positions count from the end."""
    raw = value.cast("binary")
    n = F.octet_length(raw)
    a = F.greatest(F.lit(0), (n + start) if start < 0 else F.lit(start))
    b = F.least(n - 1, (n + end) if end < 0 else F.lit(end))
    return F.when((a > b) | (n == 0), F.lit(b"")).otherwise(F.substring(raw, a + 1, b - a + 1))


def overwrite_at(value: Column, offset: int, patch: str) -> Column:
    """Bytes (BINARY) of the text with ``patch`` written over them at byte ``offset``; a gap is filled with zero bytes."""
    raw, new = value.cast("binary"), patch.encode()
    if not new:
        return raw
    padded = F.concat(raw, F.repeat(F.lit("\0"), F.greatest(F.lit(0), F.lit(offset) - F.octet_length(raw))).cast("binary"))
    return F.concat(F.substring(padded, F.lit(1), F.lit(offset)), F.lit(new), F.substring(padded, F.lit(offset + len(new) + 1), F.lit(2**31 - 1)))
