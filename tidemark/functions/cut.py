"""Texts to words, whole arrays of them at a time, for tasks that look at every word of a corpus."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_CODES, _ROW = 0x110000, 1024


@lru_cache(maxsize=8)
def members(pattern: str) -> bytes:
    """The code points that a pattern (one character of a class, or more) matches, as packed bits. Spark's own expression says which, so what is cut by
    :func:`runs` are the words that the expression cuts."""
    rows = [(a, "".join(map(chr, range(a, a + _ROW)))) for a in range(0, _CODES, _ROW) if not 0xD800 <= a < 0xE000]
    other = SparkSession.active().createDataFrame(rows, "a int, chars string").select("a", F.regexp_replace("chars", pattern, "").alias("other")).collect()
    inside = np.zeros(_CODES, bool)
    for r in other:
        inside[r["a"] : r["a"] + _ROW] = True
        inside[[ord(c) for c in r["other"]]] = False
    return np.packbits(inside).tobytes()


def table(packed: bytes) -> np.ndarray:
    """A bool for each code point."""
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends. A null text is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(texts: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The longest runs of the code points of a table in each of the (valid) texts, one after the other, and how many each text has."""
    data, at = flat(texts)
    within = (inside[:256] & (np.arange(256) < 128))[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        n = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x7F >> n)
        for k in (1, 2, 3):
            code = np.where(n > k, code << 6 | data[np.minimum(lead + k, len(data) - 1)] & 0x3F, code)
        kept = inside[code]
        for k in range(4):
            within[lead[kept & (n > k)] + k] = True
    begins, ends = within.copy(), within.copy()
    begins[1:] &= ~within[:-1]
    ends[:-1] &= ~within[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # no run goes on in the next text
    begins[edges], ends[edges - 1] = within[edges], within[edges - 1]
    begin = np.flatnonzero(begins)
    offsets = np.concatenate(([0], np.cumsum(np.flatnonzero(ends) + 1 - begin)))
    found = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[within]))
    return found, np.diff(np.searchsorted(begin, at))
