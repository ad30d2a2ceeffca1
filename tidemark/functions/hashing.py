"""Hash functions that ids and routing depend on, vectorised over Arrow batches.

They work on unsigned 64-bit arithmetic, which SQL expressions under ANSI overflow rules cannot express; results are BIGINT bit patterns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# fixed values
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
CRC64_JONES_POLY = 0xAD93D23594C935A9
CRC32C_POLY = 0x82F63B78


class _Bytes:
    """The bytes of many strings as one buffer, longest first, so that the strings that still have a byte at a position are a prefix. Memory is the
    strings' own size, whatever their lengths."""

    def __init__(self, values: pd.Series):
        self.null = values.isna().to_numpy()
        raw = [b"" if n else v.encode() for v, n in zip(values, self.null)]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.order = np.argsort(-lengths, kind="stable")
        self.data = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
        starts = np.cumsum(lengths) - lengths
        self.starts, lengths = starts[self.order], lengths[self.order]
        longest = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(longest), "left")  # strings longer than each position

    def fold(self, h: np.ndarray, step) -> np.ndarray:
        """``step(state, byte)`` over the bytes of every string; ``h`` has a row per string."""
        h = h[self.order].copy()
        with np.errstate(over="ignore"):
            for j, k in enumerate(self.active.tolist()):
                b = self.data[self.starts[:k] + j].astype(np.uint64)
                h[:k] = step(h[:k], b if h.ndim == 1 else b[:, None])
        out = np.empty_like(h)
        out[self.order] = h
        return out


def _signed(h: np.ndarray, null: np.ndarray) -> pd.Series:
    return pd.Series(h.view(np.int64)).astype("Int64").mask(null)


def _fnv_step(h: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (h ^ b) * np.uint64(FNV_PRIME)


def fnv1a64(values: pd.Series) -> np.ndarray:
    return _Bytes(values).fold(np.full(len(values), FNV_OFFSET, np.uint64), _fnv_step)


def _reflected_table(poly: int, bits: int) -> np.ndarray:
    mask = (1 << bits) - 1
    back = int(f"{poly:0{bits}b}"[::-1], 2) if bits == 64 else poly
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ back if n & 1 else n >> 1
        out.append(n & mask)
    return np.array(out, np.uint64)


def _crc(values: pd.Series, table: np.ndarray, start: int) -> np.ndarray:
    return _Bytes(values).fold(np.full(len(values), start, np.uint64), lambda h, b: table[((h ^ b) & np.uint64(255)).astype(np.int64)] ^ (h >> np.uint64(8)))


def crc64_jones(values: pd.Series) -> np.ndarray:
    return _crc(values, _reflected_table(CRC64_JONES_POLY, 64), 0)


def crc32c(values: pd.Series) -> np.ndarray:
    return _crc(values, _reflected_table(CRC32C_POLY, 32), 0xFFFFFFFF) ^ np.uint64(0xFFFFFFFF)


def splitmix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@pandas_udf(T.LongType())
def fnv1a(values: pd.Series) -> pd.Series:
    return _signed(fnv1a64(values), values.isna().to_numpy())


@pandas_udf(T.LongType())
def crc64(values: pd.Series) -> pd.Series:
    return _signed(crc64_jones(values), values.isna().to_numpy())


@pandas_udf(T.LongType())
def crc32_castagnoli(values: pd.Series) -> pd.Series:
    return _signed(crc32c(values), values.isna().to_numpy())


#: Numbers of a deterministic embedding, and how a hash becomes one (fixed values).
DIMENSIONS, SPREAD, HALF = 16, 20_001, 10_000


def embeddings(values: pd.Series, model: str) -> np.ndarray:
    """A row per text: hashes of ``model:i:text`` for i from 0, each brought to -1..1, at unit length; in single precision."""
    heads = fnv1a64(pd.Series([f"{model}:{i}:" for i in range(DIMENSIONS)]))
    h = _Bytes(values).fold(np.tile(heads, (len(values), 1)), _fnv_step)
    parts = ((h % np.uint64(SPREAD)).astype(np.float32) - np.float32(HALF)) / np.float32(HALF)
    norm = np.sqrt((parts * parts).sum(1, dtype=np.float32, keepdims=True))
    return np.divide(parts, norm, out=parts, where=norm > 0)


def deterministic_embedding(text: str, model: str = "local"):
    """The embedding column of ``text`` under ``model``; equal texts get equal vectors, null stays null."""

    @pandas_udf(T.ArrayType(T.FloatType()))
    def embed(values: pd.Series) -> pd.Series:
        return pd.Series([None if n else list(p) for n, p in zip(values.isna(), embeddings(values, model))])

    return embed(text)
