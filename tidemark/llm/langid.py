"""Language identification by hierarchical discrimination.

A text's letters become shares of hashed byte n-grams. Linear support vector machines, one against one, first choose the language
family; within it, machines for each pair of its languages vote. Every value of lang is learned. With more than ``MOST_FAMILIES`` of
them, groups of alike languages take the place of families, so that the machines grow with the power 1.5 of the languages
and not with their square. Training takes a bounded sample of labelled ids per language (``FIT_ROWS`` in all, but about
``LANGUAGE_ROWS`` of each language at least); prediction is one pass over whole texts without a shuffle, and sees the text alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a text of any length is read whole; repeated rows
are predicted each; a null doc_id is never held out and never learned from; without labelled rows all is ``und``; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._sample import sample
from tidemark.llm._store import bounded_batches
from tidemark.llm._words import Texts, slices

DIM = 4096
FIT_ROWS = 2_400
#: Rows of a language at least, where it has them; the most languages that are told apart by the families below.
LANGUAGE_ROWS, MOST_FAMILIES = 20, 120
HELD_OUT_OF = 5
UNKNOWN = "und"
#: Families of common languages; a language that is not named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ne", "ur", "gu", "pa"),
    "semitic": ("ar", "he", "mt", "am"),
}
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[0x80:] = True


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.split("-")[0].lower() in members), lang)


def featurize(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the hashed n-grams per text, and whether a text has a letter."""
    n = len(texts.offsets) - 1
    letter = _LETTER[texts.data]
    # One blank stands for all between two words; the first byte of a text is kept so that texts never touch.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    data = np.where(letter, texts.data, 0x20)[keep].astype(np.uint32)
    at = np.flatnonzero(keep)
    doc = np.searchsorted(texts.offsets, at, "right") - 1
    grams = np.zeros((n, DIM))
    for width in (1, 2, 3, 4):
        if len(data) < width:
            break
        code = data[: len(data) - width + 1].copy()
        for j in range(1, width):
            code = code * np.uint32(257) + data[j : len(data) - width + 1 + j]
        own = doc[: len(code)]
        whole = own == doc[width - 1 :]
        cell = (code * np.uint32(2654435761) >> np.uint32(20)) if width > 1 else code
        cell = (cell + np.uint32(width * 997)) % np.uint32(DIM)
        grams += np.bincount((own * DIM + cell)[whole], minlength=n * DIM).reshape(n, DIM)
    total = grams.sum(1, keepdims=True)
    ascii_letter = np.zeros(n, bool)
    ascii_letter[doc[(data >= 97) & (data < 123)]] = True
    for i in np.flatnonzero(~ascii_letter):
        part = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
        ascii_letter[i] = bool((part >= 0x80).any()) and any(map(str.isalpha, part.tobytes().decode("utf-8", "replace")))
    return grams / np.maximum(total, 1), ascii_letter


def _small(texts: Texts, rows: int = 256) -> Iterator[Texts]:
    """The same in groups of few rows, as features are dense."""
    for a in range(0, len(texts.offsets) - 1, rows):
        offsets = texts.offsets[a : a + rows + 1]
        yield Texts(texts.first + a, texts.data[offsets[0] : offsets[-1]], offsets - offsets[0])


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 30, seed: int = 3) -> np.ndarray:
    """A linear machine with squared hinge loss by dual coordinate descent; ``y`` is -1 or 1, both weigh the same in total."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    c = np.where(y > 0, len(y) / 2 / max((y > 0).sum(), 1), len(y) / 2 / max((y < 0).sum(), 1)) * cost
    q = (x * x).sum(1) + 0.5 / c
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def families_of(x: np.ndarray, langs: np.ndarray) -> dict[str, list[str]]:
    """The languages of each family; of many languages, groups of equal size: neighbours by family, then along the main direction
    of their mean features."""
    names = sorted(set(langs))
    families: dict[str, list[str]] = {}
    if len(names) <= MOST_FAMILIES:
        for lang in names:
            families.setdefault(family_of(lang), []).append(lang)
        return families
    mean = np.stack([x[langs == lang].mean(0) for lang in names])
    mean -= mean.mean(0)
    along = mean @ np.linalg.svd(mean, full_matrices=False)[2][0]
    named = [f if (f := family_of(lang)) in FAMILIES else "" for lang in names]
    order = sorted(range(len(names)), key=lambda i: (named[i], along[i], names[i]))
    for k, part in enumerate(np.array_split(order, int(np.ceil(np.sqrt(len(names)))))):
        families[f"group {k}"] = sorted(names[i] for i in part)
    return families


class Model(NamedTuple):
    """Machines as columns of ``weights``; each tells its first name from its second."""

    weights: np.ndarray
    bias: np.ndarray
    family_pairs: list[tuple[str, str]]
    pairs: list[tuple[str, str]]
    families: dict[str, list[str]]


def train(x: np.ndarray, langs: np.ndarray) -> Model:
    """``x``: shares of n-grams, ``langs``: the language of each row."""
    mean, scale = x.mean(0), 1 / (x.std(0) + 1e-3)
    z = np.concatenate([(x - mean) * scale / np.sqrt(DIM), np.ones((len(x), 1))], 1)
    families = families_of(x, langs)
    own = {lang: f for f, members in families.items() for lang in members}
    family = np.array([own[v] for v in langs])
    family_pairs = list(combinations(sorted(families), 2))
    pairs = [p for f in sorted(families) for p in combinations(families[f], 2)]
    columns = []
    for names, chosen in ((family, family_pairs), (langs, pairs)):
        for a, b in chosen:
            rows = (names == a) | (names == b)
            columns.append(svm(z[rows], np.where(names[rows] == a, 1.0, -1.0)))
    w = np.array(columns).reshape(len(columns), DIM + 1)
    plain = w[:, :DIM] * scale / np.sqrt(DIM)
    return Model(plain.T.copy(), w[:, DIM] - plain @ mean, family_pairs, pairs, families)


def _vote(margin: np.ndarray, pairs: list[tuple[str, str]], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The winner by sum of clipped margins, and how sure its closest contest is."""
    place = {n: i for i, n in enumerate(names)}
    total, least = np.zeros((len(margin), len(names))), np.full((len(margin), len(names)), 30.0)
    for j, (a, b) in enumerate(pairs):
        m = margin[:, j]
        total[:, place[a]] += np.clip(m, -1, 1)
        total[:, place[b]] -= np.clip(m, -1, 1)
        least[:, place[a]] = np.minimum(least[:, place[a]], m)
        least[:, place[b]] = np.minimum(least[:, place[b]], -m)
    won = total.argmax(1)
    return won, 1 / (1 + np.exp(-3 * least[np.arange(len(margin)), won]))


def predict(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    margin = x @ model.weights + model.bias
    names = sorted(model.families)
    n = len(model.family_pairs)
    family, sure = _vote(margin[:, :n], model.family_pairs, names)
    lang, score = np.full(len(x), UNKNOWN, dtype=object), sure.copy()
    for i, f in enumerate(names):
        rows = np.flatnonzero(family == i)
        if len(rows):
            own = [j for j, (a, b) in enumerate(model.pairs) if a in model.families[f]]
            won, inner = _vote(margin[rows][:, [n + j for j in own]], [model.pairs[j] for j in own], model.families[f])
            lang[rows] = np.array(model.families[f], dtype=object)[won]
            score[rows] *= inner
    return lang, np.clip(score, 0, 1)


def held_out():
    """Whether a row is kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT_OF)) == 0, F.lit(False))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Learn from text and lang of the rows that aren't held out; a bounded sample of each language."""
    bounded_batches(docs.sparkSession)
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    n = known.select("lang").distinct().count()
    if not n:
        return None
    drawn, _ = sample(docs.where(F.col("lang").isNotNull()), known, int(max(fit_rows // n, LANGUAGE_ROWS)), "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in (s for t in slices(batch.column("text")) for s in _small(t)):
                x, letters = featurize(texts)
                n = len(letters)
                cols = [batch.column(c).slice(texts.first, n) for c in ("doc_id", "lang")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(letters), pa.array([v.astype("<f4").tobytes() for v in x], pa.binary())], ["doc_id", "lang", "letters", "x"])

    rows = drawn.mapInArrow(run, "doc_id long, lang string, letters boolean, x binary").where("letters").toPandas()
    if not len(rows):
        return None
    x = np.frombuffer(b"".join(rows["x"]), "<f4").reshape(-1, DIM)
    order = np.lexsort((x[:, 0], rows["doc_id"].to_numpy()))
    return train(x[order].astype(np.float64), rows["lang"].to_numpy()[order].astype(str))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The language of each whole text of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            for texts in (s for t in slices(batch.column("text")) for s in _small(t)):
                x, letters = featurize(texts)
                rows = np.flatnonzero(letters)
                if model is not None and len(rows):
                    lang[texts.first + rows], score[texts.first + rows] = predict(model, x[rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)
