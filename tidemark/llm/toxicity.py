"""Toxicity by a linear-chain conditional random field over words.

Training labels are per document, so tokens are labelled first: word forms and word beginnings that stand in toxic documents, once
or several times, far more often than in clean ones (counted per document over a bounded sample of labelled rows) mark the toxic
tokens of toxic documents; all other tokens are clean. A two-state chain is trained on these token sequences. Training and scoring see the same whole
texts: forward and backward messages pass runs of words without features by powers of one 2x2 matrix, whose
derivatives give the gradient, so the cost follows the words that have features. Marginals give spans; a logistic map of their
maximum, sums and density, fitted on the same rows, gives the document's score.

Defined results: null and empty texts get the score of a text without any feature; a text of any length is read whole; repeated
rows are scored each; a null doc_id is never held out and never learned from; without labelled rows of both kinds all scores
are 0; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._sample import sample
from tidemark.llm._store import bounded_batches, discard, materialize
from tidemark.llm._words import _BYTE, ALNUM_WORDS, Texts, Words, _powers, mix, slices, words

#: Labelled rows that are learned from, at most, of either kind.
TOXIC_ROWS, CLEAN_ROWS = 3_000, 9_000
#: Features kept, at most; times that one's share in toxic documents exceeds that in clean ones; and how unlikely that is by chance, as
#: the logarithm of a bound: 8 is about four toxic documents and no clean one.
MAX_FEATURES, MIN_LIFT, MIN_EVIDENCE = 4_000, 8.0, 8.0
PREFIXES = (4, 5, 6)
HELD_OUT_OF, HELD_OUT = 4, 2
TOXIC_AT = 0.3
SPAN_AT = 0.5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,p:double>>"


def features(texts: Texts) -> tuple[Words, list[np.ndarray]]:
    """The words of these texts, and for each kind of feature its hash per word."""
    w = words(texts, ALNUM_WORDS)
    if not len(w.start):
        return w, [w.hash] * (1 + len(PREFIXES))
    length = w.end - w.start
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    within = np.arange(int(length.sum())) - np.repeat(begin, length)
    value = _BYTE[texts.data[np.repeat(w.start, length) + within]] * _powers(int(length.max()))[within]
    kinds = [w.hash]
    for k in PREFIXES:
        kinds.append(mix(np.add.reduceat(np.where(within < k, value, np.uint64(0)), begin) + np.uint64(k * 7919)))
    return w, kinds


class Model(NamedTuple):
    """``known`` sorted feature hashes with their weights, the chain's bias and transitions, and the map to scores."""

    known: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    score: np.ndarray


def active(known: np.ndarray, kinds: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words that have a known feature; for each kind which words and which feature."""
    hits, any_hit = [], np.zeros(len(kinds[0]), bool)
    for h in kinds:
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        rows = np.flatnonzero(known[at] == h) if len(known) else np.zeros(0, np.int64)
        hits.append((rows, at[rows]))
        any_hit[rows] = True
    return np.flatnonzero(any_hit), hits


def marginals(emit: np.ndarray, gaps: np.ndarray, bias: float, moves: np.ndarray) -> np.ndarray:
    """P(toxic) of the words with features. ``emit``: their scores; ``gaps``: plain words before each and after the last."""
    step = np.exp(moves) * np.array([1.0, np.exp(bias)])  # from row to column over a plain word
    powers: dict[int, np.ndarray] = {}

    def over(n: int) -> np.ndarray:
        if n not in powers:
            m, base, k = np.eye(2), step / step.max(), n
            while k:
                m = m @ base if k & 1 else m
                base = base @ base
                base, m, k = base / base.max(), m / m.max(), k >> 1
            powers[n] = m
        return powers[n]

    n, turn = len(emit), np.exp(moves)
    weight = np.stack([np.ones(n), np.exp(np.minimum(emit, 50))], 1)
    ahead, back = np.zeros((n, 2)), np.ones((n, 2))
    a = np.array([1.0, 0.0])
    for i in range(n):
        a = (a @ over(int(gaps[i]))) @ turn * weight[i]
        a = a / a.sum()
        ahead[i] = a
    b = over(int(gaps[n])) @ np.ones(2)
    for i in range(n - 1, -1, -1):
        back[i] = b / b.sum()
        b = over(int(gaps[i])) @ (turn @ (weight[i] * back[i]))
    both = ahead * back
    return both[:, 1] / both.sum(1)


def summarize(p: np.ndarray, n_words: int) -> tuple[float, float, float, float]:
    """What a document's score is made of: its highest marginal, their sum, how many mark a span, and their share of all words."""
    return (float(p.max()), float(np.log1p(p.sum())), float(np.log1p((p >= SPAN_AT).sum())), min(100 * float(p.sum()) / (n_words + 20), 5.0)) if len(p) else (0.0,) * 4


class Chains(NamedTuple):
    """Sequences with about as many words with features, padded to the same number: what is at the end of one that
    is shorter is not ``live``. ``gap``: index of the length of the run of plain words before each, and of the last."""

    state: np.ndarray
    live: np.ndarray
    gap: np.ndarray
    last: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    feats: np.ndarray


def chains(sequences: list[tuple[np.ndarray, list[list[int]], np.ndarray]]) -> tuple[list[Chains], np.ndarray]:
    """``sequences`` (gaps, features of each word, states) in batches of like length, and the lengths of gaps."""
    lengths = np.unique(np.concatenate([g for g, _, _ in sequences]))
    classes: dict[int, list] = {}
    for one in sequences:
        classes.setdefault(len(one[2]).bit_length(), []).append(one)
    out = []
    for own in classes.values():
        n, width = len(own), max(len(y) for _, _, y in own)
        state, live, gap = np.zeros((n, width), np.int64), np.zeros((n, width), bool), np.zeros((n, width), np.int64)
        last = np.searchsorted(lengths, [g[-1] for g, _, _ in own])
        places: list[tuple[int, int, int]] = []
        for i, (gaps, features_, y) in enumerate(own):
            state[i, : len(y)], live[i, : len(y)], gap[i, : len(y)] = y, True, np.searchsorted(lengths, gaps[:-1])
            places += [(i, j, f) for j, fs in enumerate(features_) for f in fs]
        rows, cols, feats = np.array(places, np.int64).reshape(-1, 3).T
        out.append(Chains(state, live, gap, last, rows, cols, feats))
    return out, lengths


def runs(step: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each length g the g-th power of ``step``, and for each of its entries (a, b) the sum over k of step^k E_ab step^(g-1-k): both
    from the powers of a block matrix. All are scaled alike for each length."""
    size = np.abs(np.linalg.eigvals(step)).max()
    block = np.zeros((4, 4, 4))
    for e in range(4):
        block[e, :2, :2] = block[e, 2:, 2:] = step / size
        block[e, e // 2, 2 + e % 2] = 1
    total = np.tile(np.eye(4), (len(lengths), 4, 1, 1))
    left = lengths.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        total[odd] = total[odd] @ block
        block, left = block @ block, left >> 1
    # The corner of the block has one factor less of ``step``, and so one less of the scale.
    return total[:, 0, :2, :2], total[:, :, :2, 2:] / size


def likelihood(batches: list[Chains], lengths: np.ndarray, w: np.ndarray, bias: float, moves: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """The logarithm of the likelihood of all states, and its derivatives by the weights, the bias and the transitions."""
    turn = np.exp(moves)
    step = turn * np.array([1.0, np.exp(bias)])
    size = np.abs(np.linalg.eigvals(step)).max()
    over, parts = runs(step, lengths)
    total, grad_w, grad_b, grad_m = 0.0, np.zeros(len(w)), 0.0, np.zeros((2, 2))
    for c in batches:
        n, width = c.state.shape
        emit = np.full((n, width), bias)
        np.add.at(emit, (c.rows, c.cols), w[c.feats])
        emit = np.clip(emit, -50, 50)
        weight = np.stack([np.ones_like(emit), np.exp(emit)], 2)
        come, ahead = np.zeros((n, width, 2)), np.zeros((n, width, 2))  # before a run of plain words, and behind the word after it
        a, log_z = np.tile([1.0, 0.0], (n, 1)), np.zeros(n)
        for j in range(width):
            come[:, j] = a
            new = np.einsum("ni,nij,jk,nk->nk", a, over[c.gap[:, j]], turn, weight[:, j], optimize=True)
            scale = new.sum(1, keepdims=True)
            on = c.live[:, j]
            a = np.where(on[:, None], new / scale, a)
            log_z += np.where(on, np.log(scale[:, 0]), 0)
            ahead[:, j] = a
        b = over[c.last].sum(2)
        at_end = (a * b).sum(1)
        log_z += np.log(at_end) + np.log(size) * (np.where(c.live, lengths[c.gap], 0).sum(1) + lengths[c.last])
        # Transitions within the last run: whence, and into the first or second state.
        crossed = np.einsum("ni,neij,n->e", a, parts[c.last], 1 / at_end, optimize=True).reshape(2, 2) * step
        p, seen = np.zeros((n, width)), np.zeros((2, 2))
        for j in range(width - 1, -1, -1):
            on = c.live[:, j]
            p[:, j] = np.where(on, ahead[:, j, 1] * b[:, 1] / (ahead[:, j] * b).sum(1), 0)
            here = weight[:, j] * b
            entry = here @ turn.T  # before the word, behind the run
            reach = np.einsum("ni,nij->nj", come[:, j], over[c.gap[:, j]])
            z = (reach * entry).sum(1)
            share = on / z
            seen += np.einsum("ni,nj,n->ij", reach, here, share) * turn
            crossed += np.einsum("ni,neij,nj,n->e", come[:, j], parts[c.gap[:, j]], entry, share, optimize=True).reshape(2, 2) * step
            new = np.einsum("nij,nj->ni", over[c.gap[:, j]], entry)
            b = np.where(on[:, None], new / new.sum(1, keepdims=True), b)
        # What the states themselves have: runs of plain words are clean throughout.
        plain = np.where(c.live, lengths[c.gap], 0)
        before = np.concatenate([np.zeros((n, 1), np.int64), c.state[:, :-1]], 1)
        end = np.where(c.live.any(1), c.state[np.arange(n), np.maximum(c.live.sum(1) - 1, 0)], 0) if width else np.zeros(n, np.int64)
        own = np.zeros((2, 2))
        np.add.at(own, (before[c.live], np.where(plain > 0, 0, c.state)[c.live]), 1)
        np.add.at(own, (np.zeros(int((plain > 0).sum()), int), c.state[plain > 0]), 1)
        own[0, 0] += np.maximum(plain - 1, 0).sum() + np.maximum(lengths[c.last] - 1, 0).sum()
        np.add.at(own, (end[lengths[c.last] > 0], np.zeros(int((lengths[c.last] > 0).sum()), int)), 1)
        total += (emit * c.state).sum() + (own * moves).sum() - log_z.sum()
        gap = (c.state - p) * c.live
        grad_w += np.bincount(c.feats, gap[c.rows, c.cols], len(w))
        grad_b += gap.sum() - crossed[:, 1].sum()
        grad_m += own - seen - crossed
    return total, grad_w, grad_b, grad_m


def train_chain(sequences: list[tuple[np.ndarray, list[list[int]], np.ndarray]], n_features: int, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient ascent on the likelihood of the states in whole texts, with steps that shorten as gradients add up."""
    w, bias, moves = np.zeros(n_features), -2.0, np.zeros((2, 2))
    batches, lengths = chains(sequences)
    scale = 10 / max(1, sum(len(y) for _, _, y in sequences))
    step_w, step_b, step_m = np.full(n_features, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(rounds):
        _, grad_w, grad_b, grad_m = likelihood(batches, lengths, w, bias, moves)
        grad_w, grad_b, grad_m = grad_w * scale - 1e-3 * w, grad_b * scale, grad_m * scale - 1e-3 * moves
        step_w, step_b, step_m = step_w + grad_w**2, step_b + grad_b**2, step_m + grad_m**2
        w, bias, moves = w + 0.5 * grad_w / np.sqrt(step_w), bias + 0.5 * grad_b / np.sqrt(step_b), moves + 0.5 * grad_m / np.sqrt(step_m)
    return w, float(bias), moves


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (bias first) by Newton steps with a small ridge."""
    z = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [1e-3 * weight.sum()] * x.shape[1]) * 1e-2
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        move = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def held_out():
    """Whether a row is kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT_OF)) == HELD_OUT, F.lit(False))


def _sequences(texts: Texts, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, dict[int, list[int]]]]:
    """For each text its words with features by position, and those features."""
    w, kinds = features(texts)
    at, hits = active(known, kinds)
    own: dict[int, list[int]] = {int(i): [] for i in at}
    for rows, which in hits:
        for i, f in zip(rows, which, strict=True):
            own[int(i)].append(int(f))
    bounds = np.searchsorted(w.doc, np.arange(len(texts.offsets)))
    cut = np.searchsorted(at, bounds)
    for d in range(len(texts.offsets) - 1):
        yield int(bounds[d + 1] - bounds[d]), at[cut[d] : cut[d + 1]] - bounds[d], {int(i - bounds[d]): own[int(i)] for i in at[cut[d] : cut[d + 1]]}


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model | None:
    """Learn from a bounded sample of the labelled rows that aren't held out."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn, counts = sample(docs, known, {1: toxic_rows, 0: clean_rows}, "toxic")
    if not counts.get(0) or not counts.get(1):
        return None
    drawn = materialize(drawn.select("text", "toxic"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for texts in slices(batch.column("text")):
                w, kinds = features(texts)
                sets, of, often = [], [], []
                bounds = np.searchsorted(w.doc, np.arange(len(texts.offsets)))
                for d in range(len(texts.offsets) - 1):
                    own, times = np.unique(np.concatenate([k[bounds[d] : bounds[d + 1]] for k in kinds]), return_counts=True)
                    sets.append(own)
                    often.append(times > 1)
                    of.append(np.full(len(own), toxic[texts.first + d], np.int32))
                f, t = np.concatenate(sets).view(np.int64), np.concatenate(of)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(t), pa.array(np.concatenate(often).astype(np.int32))], ["feature", "toxic", "twice"])

    n = {r["toxic"]: r["n"] for r in drawn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    twice = F.col("twice")
    sums = [F.sum("toxic").alias("a1"), F.sum(1 - F.col("toxic")).alias("b1"), F.sum(twice * F.col("toxic")).alias("a2"), F.sum(twice * (1 - F.col("toxic"))).alias("b2")]
    table = drawn.mapInArrow(each, "feature long, toxic int, twice int").groupBy("feature").agg(*sums)
    base = n[1] / (n[0] + n[1])

    def strong(a: Column, b: Column) -> Column:
        """How unlikely it is that so many of the documents with a feature are toxic; null where it isn't strong enough."""
        lift = (a / n[1]) / ((b + 0.5) / n[0])
        x = a / F.greatest(a + b, F.lit(1))
        evidence = (a + b) * (x * F.log(x / base) + F.when(b > 0, (1 - x) * F.log((1 - x) / (1 - base))).otherwise(0.0))
        return F.when((a > 0) & (lift >= MIN_LIFT) & (evidence >= MIN_EVIDENCE), evidence)

    # Once, or several times in a document: whichever says more. The strongest are kept, MAX_FEATURES at most.
    rank = F.greatest(strong(F.col("a1"), F.col("b1")), strong(F.col("a2"), F.col("b2")))
    best = table.select("feature", rank.alias("rank")).where("rank is not null").orderBy(F.desc("rank"), "feature").limit(MAX_FEATURES)
    chosen = np.array([r["feature"] for r in best.select("feature").collect()], np.int64).view(np.uint64)
    if not len(chosen):
        return None
    chosen = np.sort(chosen)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, at, own = [], [], []
            for texts in slices(batch.column("text")):
                for size, places, of in _sequences(texts, chosen):
                    n_words.append(size)
                    at.append(places.tolist())
                    own.append([of[int(i)] for i in places])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n_words, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.list_(pa.int32())))], ["toxic", "n", "at", "own"])

    rows = sorted((r["toxic"], r["n"], list(r["at"]), [list(x) for x in r["own"]]) for r in drawn.mapInArrow(compact, "toxic int, n long, at array<long>, own array<array<int>>").collect())
    discard(drawn)
    sequences = [(np.diff([-1, *at, size]) - 1, own, np.full(len(at), toxic)) for toxic, size, at, own in rows]
    w, bias, moves = train_chain(sequences, len(chosen))
    x, y = [], []
    for toxic, size, at, own in rows:
        x.append(summarize(_marginals(size, np.array(at, int), own, w, bias, moves), size))
        y.append(toxic)
    x, y = np.array(x), np.array(y, float)
    prior = {t: counts[t] / n[t] for t in (0, 1)}
    return Model(chosen, w, bias, moves, logistic(x, y, np.where(y == 1, prior[1], prior[0]) / ((counts[0] + counts[1]) / len(y))))


def _marginals(size: int, at: np.ndarray, own: list[list[int]], w: np.ndarray, bias: float, moves: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.zeros(0)
    gaps = np.diff(np.concatenate(([-1], at, [size]))) - 1
    return marginals(np.array([bias + w[fs].sum() for fs in own]), gaps, bias, moves)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """The score of each whole text of ``docs`` (doc_id, text), and the spans (in code points) that are likely toxic."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            if model is not None:
                plain = 1 / (1 + np.exp(-model.score[0]))
                scores[:] = plain
                for texts in slices(batch.column("text")):
                    starts, ends = None, None
                    for d, (size, at, of) in enumerate(_sequences(texts, model.known)):
                        if not len(at):
                            continue
                        p = _marginals(size, at, [of[int(i)] for i in at], model.weights, model.bias, model.moves)
                        scores[texts.first + d] = 1 / (1 + np.exp(-(model.score[0] + model.score[1:] @ np.array(summarize(p, size)))))
                        marked = np.flatnonzero(p >= SPAN_AT)
                        if len(marked):
                            if starts is None:
                                w = words(texts, ALNUM_WORDS, hashed=False)
                                starts, ends, first = w.start, w.end, np.searchsorted(w.doc, np.arange(len(texts.offsets)))
                            low = texts.offsets[d]
                            chars = np.cumsum((texts.data[low : texts.offsets[d + 1]] & 0xC0) != 0x80)
                            upto = lambda b: int(chars[b - low - 1]) if b > low else 0  # noqa: B023, E731
                            spans[texts.first + d] = [{"start": upto(starts[first[d] + at[i]]), "end": upto(ends[first[d] + at[i]]), "p": float(p[i])} for i in marked]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= TOXIC_AT).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "held_out", "score", "predicted", "spans"]
            )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)
