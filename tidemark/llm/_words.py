"""Words and their 64-bit hashes for whole batches of texts, as numpy passes over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.ones(1, dtype=np.uint64)

#: ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and all that is not ASCII.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Texts(NamedTuple):
    """Rows ``first .. first+len(offsets)-1`` of a batch: their bytes, lower-cased for A-Z, and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, lower: bool = True, max_bytes: int = 1 << 21) -> Iterator[Texts]:
    """Whole rows, about ``max_bytes`` at a time, so that memory follows the longest text and not the batch. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        part = data[offsets[row] : offsets[stop]]
        yield Texts(row, _LOWER[part] if lower else part, offsets[row : stop + 1] - offsets[row])
        row = stop


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        size = 1 << max(8, int(n - 1).bit_length())
        full = np.full(size, _MULT, dtype=np.uint64)
        full[0] = 1
        _POWER = np.cumprod(full, dtype=np.uint64)
    return _POWER


def words(texts: Texts, is_word: np.ndarray, hashed: bool = True) -> Words:
    """The words of each text in order; ``hash`` depends on a word's bytes alone."""
    data, offsets = texts.data, texts.offsets
    empty = np.zeros(0, np.int64)
    if not len(data):
        return Words(empty, empty, empty, np.zeros(0, np.uint64))
    inside = is_word[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    if not hashed or not len(start):
        return Words(start, end, doc, np.zeros(0, np.uint64))
    length = end - start
    at = np.flatnonzero(inside)
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    within = np.arange(len(at)) - np.repeat(begin, length)
    value = _BYTE[data[at]] * _powers(int(length.max()))[within]
    return Words(start, end, doc, mix(np.add.reduceat(value, begin)))


def word_hash(word: str) -> np.uint64:
    """The hash that :func:`words` gives to this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return mix(np.add.reduce(_BYTE[data] * _powers(len(data))[: len(data)], keepdims=True))[0]


def shingle_sets(texts: Texts, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; a shorter text has its whole sequence as one."""
    w = words(texts, SPACE_WORDS)
    n = len(texts.offsets) - 1
    bounds = np.searchsorted(w.doc, np.arange(n + 1))
    if len(w.hash) >= width:
        full = np.zeros(len(w.hash) - width + 1, np.uint64)
        for j in range(width):
            full += w.hash[j : len(w.hash) - width + 1 + j] * _SHINGLE[j]
        full = mix(full)
    out = []
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.add.reduce(w.hash[a:b] * _SHINGLE[: b - a], keepdims=True) + _SHINGLE[width + (b - a)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
