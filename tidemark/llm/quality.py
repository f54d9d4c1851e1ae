"""Quality rules judged by an isolation forest.

Each document gets plain rule counts over its whole text. Ratios of all of them (independent of length), on a logarithmic scale, go through an isolation forest:
random splits isolate odd documents early, so a short mean path means an anomaly. By the method, a tree is made of few rows, so that bad documents that are alike don't
hide each other, and there are many trees; each draws rows of its own from the whole table, labelled or not. The threshold comes from all labelled rows: it is the
lowest score that at most ``max_false_rejects`` of the good ones exceed. Scoring is one pass without a shuffle; the threshold takes one more, which shuffles scores alone.

Defined results: a null, empty or blank text has no words and fails the base rules; a text of any length is read whole; repeated
rows are judged each; without rows or labels the threshold is 1 and only the base rules reject; an empty table gives an empty
table; :func:`keep` returns the columns it got, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._sample import sample
from tidemark.llm._store import bounded_batches, discard, materialize
from tidemark.llm._words import _MULT, SPACE_WORDS, Texts, mix, slices, words

MIN_WORDS = 50
TREES, TREE_ROWS = 800, 24
#: Rows that are drawn for the trees: theirs, and some more for those that the base rules reject.
FIT_ROWS = TREES * TREE_ROWS * 3 // 2
MAX_FALSE_REJECTS = 0.003

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbols", "upper", "punctuation", "same_as_last", "rough_words", "mean_word", "dup_lines", "repeat_words"]
#: Differences of ratios that are far smaller than this don't count.
LEAST = 0.001
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double"


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_SYMBOLS = _table("#*$%&|<>")
_UPPER, _DIGITS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_LETTERS = _UPPER | _table("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
_PUNCTUATION = ~(_LETTERS | _DIGITS | ~SPACE_WORDS | (np.arange(256) < 0x20))
_LINES = np.ones(256, bool)
_LINES[0x0A] = False


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Rule counts and ratios (a column each) of these texts, whose letters are as they were written."""
    data, offsets = texts.data, texts.offsets
    n = len(offsets) - 1
    inside = SPACE_WORDS[data]
    heads = (data & 0xC0) != 0x80
    w = words(texts, SPACE_WORDS)
    n_words = np.bincount(w.doc, minlength=n)
    word_chars = _per_doc(inside & heads, offsets)
    chars = _per_doc(heads, offsets)
    symbols = _per_doc(_SYMBOLS[data], offsets)

    lines = words(texts, _LINES)
    filled = np.add.reduceat(inside, lines.start, dtype=np.int64) > 0 if len(lines.start) else np.zeros(0, bool)
    keys = mix(lines.hash[filled] + lines.doc[filled].astype(np.uint64) * _MULT)
    _, first = np.unique(keys, return_index=True)
    n_lines = np.bincount(lines.doc[filled], minlength=n)
    dup_lines = n_lines - np.bincount(lines.doc[filled][first], minlength=n)

    repeated = np.zeros(len(w.hash), bool)
    if len(w.hash) >= 3:
        a, b, c = w.hash[:-2], w.hash[1:-1], w.hash[2:]
        whole = np.flatnonzero(w.doc[:-2] == w.doc[2:])
        m = _MULT
        key = mix(mix(mix(a) + b * m) + c * m + w.doc[:-2].astype(np.uint64))[whole]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        at = whole[count[inverse] > 1]
        for j in range(3):
            repeated[at + j] = True
    n_repeat = np.bincount(w.doc, repeated, minlength=n).astype(np.int64)

    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    letters = _per_doc(_LETTERS[data], offsets)
    plain = np.zeros(len(w.hash), bool)
    if len(w.start):
        total = np.concatenate(([0], np.cumsum(_LETTERS[data] | (data == 0x2C) | (data == 0x2E), dtype=np.int64)))
        plain = total[w.end] - total[w.start] == w.end - w.start
    over = lambda x, y: x / np.maximum(y, 1)
    share = lambda flags: over(np.bincount(w.doc, flags, minlength=n), n_words)
    ratios = [over(symbols, chars), over(_per_doc(_UPPER[data], offsets), letters), over(_per_doc(_PUNCTUATION[data], offsets), chars), share(same), share(~plain)]
    ratios += [over(word_chars, n_words), over(dup_lines, n_lines), over(n_repeat, n_words)]
    return np.stack([n_words, word_chars, symbols, dup_lines, n_repeat], 1).astype(np.int64), np.stack(ratios, 1).astype(np.float64)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])


def scaled(ratios: np.ndarray) -> np.ndarray:
    """What the forest splits: a share that doubles is as far away whether it is small or large."""
    return np.log(ratios + LEAST)


class Forest(NamedTuple):
    """Trees as arrays (tree, node): the split, the children, and at leaves the path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    norm: float


def _path(n: float) -> float:
    """The mean path length of an unsuccessful search among ``n`` points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def fit_forest(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(rows))
    limit = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (limit + 1)
    feature, value = np.zeros((trees, nodes), np.int32), np.full((trees, nodes), np.inf)
    left, depth = np.zeros((trees, nodes), np.int32), np.zeros((trees, nodes))
    # With rows enough for all trees, none is in two of them.
    dealt = rng.permutation(len(rows)) if len(rows) >= trees * size else None
    for t in range(trees):
        todo, used = [(0, rng.choice(len(rows), size, replace=False) if dealt is None else dealt[t * size : (t + 1) * size], 0)], 1
        while todo:
            node, part, d = todo.pop()
            x = rows[part]
            spread = np.flatnonzero(x.max(0) > x.min(0)) if len(part) > 1 else []
            if d >= limit or not len(spread):
                depth[t, node], left[t, node] = d + _path(len(part)), node
                continue
            f = int(rng.choice(spread))
            cut = rng.uniform(x[:, f].min(), x[:, f].max())
            feature[t, node], value[t, node], left[t, node] = f, cut, used
            todo += [(used, part[x[:, f] <= cut], d + 1), (used + 1, part[x[:, f] > cut], d + 1)]
            used += 2
    return Forest(feature, value, left, depth, max(_path(size), 1e-9))


def anomaly(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """Between 0 and 1; the higher, the easier a row is to isolate."""
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for t in range(len(forest.depth)):
        at = np.zeros(len(rows), np.int64)
        while True:
            go = forest.left[t, at] + (rows[every, forest.feature[t, at]] > forest.value[t, at])
            if (go == at).all():
                break
            at = go
        total += forest.depth[t, at]
    return 2.0 ** (-total / len(forest.depth) / forest.norm)


class Judge(NamedTuple):
    forest: Forest | None
    threshold: float


def calibrate(scores: np.ndarray, good: np.ndarray, max_false_rejects: float = MAX_FALSE_REJECTS) -> float:
    """The lowest threshold, so the one that catches most bad rows, with at most that share of good rows above it."""
    if not len(scores) or not good.any() or good.all():
        return 1.0
    ordered = np.sort(scores[good])
    return float(ordered[min(len(ordered) - 1, int(np.ceil(len(ordered) * (1 - max_false_rejects))) - 1)])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_false_rejects: float = MAX_FALSE_REJECTS) -> Judge:
    bounded_batches(docs.sparkSession)
    drawn, _ = sample(docs, docs.select("doc_id", F.lit(0).alias("label")), fit_rows, "label", 1)
    drawn = _measured(drawn, "label").select("doc_id", *COUNTS, *RATIOS).toPandas()
    drawn = drawn.sort_values(["doc_id", *COUNTS])  # one order, so one forest, for each set of rows
    rows = drawn[~base_failed(drawn[COUNTS].to_numpy())][RATIOS].to_numpy()
    if len(rows) < 2:
        return Judge(None, 1.0)
    judge = Judge(fit_forest(scaled(rows)), 1.0)
    return judge._replace(threshold=_threshold(docs, labels, judge, max_false_rejects))


def _threshold(docs: DataFrame, labels: DataFrame, judge: Judge, max_false_rejects: float) -> float:
    """What :func:`calibrate` gives for all labelled rows. Scores meet labels; no text is shuffled."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    if known.isEmpty():
        return 1.0
    seen = score(docs, judge).where(~F.col("base_failed")).select("doc_id", "anomaly").join(known, "doc_id").select("label", "anomaly")
    seen = materialize(seen)
    n_good, n_bad = seen.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)).first()
    if not n_good or not n_bad:
        found = 1.0
    else:
        above = n_good - min(n_good, math.ceil(n_good * (1 - max_false_rejects)))
        found = float(seen.where("label = 1").orderBy(F.desc("anomaly")).offset(above).limit(1).first()["anomaly"])
    discard(seen)
    return found


def _measured(docs: DataFrame, *extra: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(t) for t in slices(batch.column("text"), lower=False)]
            counts = np.concatenate([a for a, _ in parts]) if parts else np.zeros((0, 5), np.int64)
            ratios = np.concatenate([b for _, b in parts]) if parts else np.zeros((0, len(RATIOS)))
            cols = [pa.array(c) for c in counts.T] + [pa.array(c) for c in ratios.T]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(x) for x in extra), *cols], ["doc_id", *extra, *COUNTS, *RATIOS])

    fields = ["doc_id long", *(f"{x} int" for x in extra), *(f"{x} long" for x in COUNTS), *(f"{x} double" for x in RATIOS)]
    return docs.select("doc_id", "text", *extra).mapInArrow(run, ", ".join(fields))


def _verdict(column: pa.Array, judge: Judge) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = [measure(t) for t in slices(column, lower=False)]
    counts = np.concatenate([a for a, _ in parts]) if parts else np.zeros((0, 5), np.int64)
    ratios = np.concatenate([b for _, b in parts]) if parts else np.zeros((0, len(RATIOS)))
    failed = base_failed(counts)
    odd = anomaly(judge.forest, scaled(ratios)) if judge.forest is not None and len(ratios) else np.zeros(len(ratios))
    return counts, failed, ~failed & (odd <= judge.threshold), odd


def score(docs: DataFrame, judge: Judge) -> DataFrame:
    """The rule counts and the verdict for each row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, kept, odd = _verdict(batch.column(1), judge)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts.T), pa.array(failed), pa.array(kept), pa.array(odd)], ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, judge: Judge) -> DataFrame:
    """The rows of ``docs`` that the rules and the forest keep, with all their columns."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_verdict(batch.column(at), judge)[2]))

    return docs.mapInArrow(run, docs.schema)
