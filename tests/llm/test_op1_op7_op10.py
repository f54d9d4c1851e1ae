import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, SPACE, ascii_lower, docs, edge_rows
from tidemark.llm import _words as W
from tidemark.llm import langid, quality, toxicity
from tidemark.llm._sample import sample


def read(spark, table, sf=SF):
    return spark.read.parquet(f"{sf}/{table}.parquet")


@pytest.fixture(scope="module")
def language(spark):
    return langid.fit(read(spark, "documents"))


def test_language_held_out(spark, language):
    d = read(spark, "documents")
    got = langid.identify(d, language).toPandas().set_index("doc_id")
    own = d.select("doc_id", "lang").toPandas().set_index("doc_id").join(got)
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in own.index])
    assert (own.held_out.to_numpy() == held).all() and 0.1 < held.mean() < 0.3
    assert (own[held].lang == own[held].lang_pred).mean() > 0.98
    assert own.score.between(0, 1).all()


def test_language_edges(spark, language):
    got = langid.identify(docs(spark, edge_rows()), language).collect()
    assert len(got) == len(edge_rows())
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 8)) and by[5]["lang_pred"] != "und" and not by[None]["held_out"]
    empty = docs(spark, edge_rows()).where("false")
    assert langid.identify(empty, language).count() == 0 and langid.fit(empty) is None
    assert {r["lang_pred"] for r in langid.identify(docs(spark, [(1, "abc", "en", "a")]), None).collect()} == {"und"}


def test_more_languages_than_families(spark):
    rng = np.random.default_rng(6)
    names = [f"x{i}" for i in range(124)] + ["en", "de", "fr"]
    words = {n: ["".join(map(chr, rng.integers(97, 123, 4))) for _ in range(12)] for n in names}
    # The last are the rarest.
    rows = [(n, " ".join(rng.choice(words[n], 40))) for k, n in enumerate(names) for _ in range(8 if k < 110 else 7)]
    d = docs(spark, [(i, t, n, None) for i, (n, t) in enumerate(rows)])
    model = langid.fit(d)
    assert sorted(lang for f in model.families.values() for lang in f) == sorted(names)
    assert model.weights.shape[1] < len(names) ** 1.5
    got = {r["doc_id"]: r for r in langid.identify(d, model).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == rows[i][0] for i in held]) > 0.95
    assert {rows[i][0] for i in got if got[i]["lang_pred"] == rows[i][0]} == set(names)


def plain_language(model, text):
    """Shares of n-grams, margins and votes, one by one."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    letter = [97 <= b < 123 or b >= 0x80 for b in data]
    if not any(c.isalpha() for c in text or ""):
        return "und"
    kept = bytes(b if on else 0x20 for i, (b, on) in enumerate(zip(data, letter, strict=True)) if on or i == 0 or letter[i - 1])
    grams = np.zeros(langid.DIM)
    for width in (1, 2, 3, 4):
        for i in range(len(kept) - width + 1):
            code = 0
            for b in kept[i : i + width]:
                code = (code * 257 + b) % 2**32
            cell = code if width == 1 else (code * 2654435761 % 2**32) >> 20
            grams[(cell + width * 997) % langid.DIM] += 1
    margin = grams / grams.sum() @ model.weights + model.bias

    def winner(names, pairs, at):
        votes = dict.fromkeys(names, 0.0)
        for k, (a, b) in enumerate(pairs):
            m = float(np.clip(margin[at + k], -1, 1)) if isinstance(at, int) else float(np.clip(margin[at[k]], -1, 1))
            votes[a] += m
            votes[b] -= m
        return max(names, key=lambda n: (votes[n], -names.index(n)))

    family = winner(sorted(model.families), model.family_pairs, 0)
    own = [k for k, (a, _) in enumerate(model.pairs) if a in model.families[family]]
    return winner(model.families[family], [model.pairs[k] for k in own], [len(model.family_pairs) + k for k in own])


def test_language_equals_plain_votes(spark, language):
    d = read(spark, "documents", "/root/testdata/sf0.001").select("doc_id", "text").union(docs(spark, edge_rows()[:5] + edge_rows()[6:]).select("doc_id", "text"))
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(d, language).collect()}
    assert got == {i: plain_language(language, t) for i, t in text.items()} and len(set(got.values())) > 3


def test_families():
    assert langid.family_of("de") == langid.family_of("en") == "germanic" and langid.family_of("fr-CA") == "romance" and langid.family_of("xx") == "xx"


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(20):
        moves, bias = rng.normal(size=(2, 2)), float(rng.normal())
        gaps = rng.integers(0, 3, 4)
        emit = rng.normal(size=3) * 2
        line = [*[bias] * gaps[0], emit[0], *[bias] * gaps[1], emit[1], *[bias] * gaps[2], emit[2], *[bias] * gaps[3]]
        at = [gaps[0], gaps[0] + 1 + gaps[1], gaps[0] + 2 + gaps[1] + gaps[2]]
        total, one = 0.0, np.zeros(3)
        for states in product((0, 1), repeat=len(line)):
            w = np.exp(sum(moves[a, b] for a, b in zip((0, *states), states, strict=False)) + sum(e * s for e, s in zip(line, states, strict=True)))
            total += w
            one += w * np.array([states[i] for i in at])
        assert toxicity.marginals(emit, gaps, bias, moves) == pytest.approx(one / total)


def test_likelihood_equals_enumeration():
    rng = np.random.default_rng(2)
    sequences = []
    for k in (0, 1, 2, 3, 3):
        sequences.append((rng.integers(0, 3, k + 1), [[int(f) for f in rng.permutation(4)[: rng.integers(1, 3)]] for _ in range(k)], rng.integers(0, 2, k)))
    w, bias, moves = rng.normal(size=4), -0.7, rng.normal(size=(2, 2))

    def plain(w, bias, moves):
        total = 0.0
        for gaps, fs, y in sequences:
            line, real = [], []
            for j, g in enumerate(gaps):
                line += [bias] * g
                real += [0] * g
                if j < len(fs):
                    line.append(bias + w[fs[j]].sum())
                    real.append(int(y[j]))
            score = lambda s, line=line: sum(moves[a, b] for a, b in zip((0, *s), s, strict=False)) + sum(e * v for e, v in zip(line, s, strict=True))
            total += score(real) - np.log(sum(np.exp(score(s)) for s in product((0, 1), repeat=len(line))))
        return total

    got, by_w, by_b, by_m = toxicity.likelihood(*toxicity.chains(sequences), w, bias, moves)
    assert got == pytest.approx(plain(w, bias, moves))
    e = 1e-5
    assert by_b == pytest.approx((plain(w, bias + e, moves) - plain(w, bias - e, moves)) / 2 / e, abs=1e-6)
    for i in range(4):
        at = np.eye(4)[i] * e
        assert by_w[i] == pytest.approx((plain(w + at, bias, moves) - plain(w - at, bias, moves)) / 2 / e, abs=1e-6)
        at = at.reshape(2, 2)
        assert by_m.ravel()[i] == pytest.approx((plain(w, bias, moves + at) - plain(w, bias, moves - at)) / 2 / e, abs=1e-6)


def test_sample_is_bounded(spark):
    """40 ids of 150 rows, some with several texts, and a null id: one row an id, at most as many as asked for."""
    rows = [(None if i == 40 else i, f"text {k % 2 if i < 5 else 0}", "ab"[i % 2]) for i in range(41) for k in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(5)
    got, counts = sample(d, d, 12, "kind")
    got = [tuple(r) for r in got.collect()]
    assert counts == {"a": 20, "b": 20} and Counter(k for _, _, k in got) == {"a": 12, "b": 12} and len({i for i, _, _ in got}) == 24
    assert sorted(got) == sorted(tuple(r) for r in sample(d.repartition(3), d.repartition(2), 12, "kind")[0].collect())
    every, _ = sample(d, d, {"a": 1000}, "kind")
    assert sorted(r["doc_id"] for r in every.collect()) == list(range(0, 40, 2))
    assert sample(d.where("false"), d.where("false"), 5, "kind")[0].count() == 0


def test_few_toxic_documents_raise_no_alarms(spark):
    d, labels = read(spark, "documents"), read(spark, "labels")
    got = toxicity.score(d, toxicity.fit(d, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (got[got.toxic == 1].predicted == 1).mean() >= 0.6 and not (got[got.toxic == 0].predicted == 1).any()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = read(spark, "documents", sf), read(spark, "labels", sf)
    model = toxicity.fit(d, labels)
    got = toxicity.score(d, model).join(labels, "doc_id").where("held_out").toPandas()
    toxic = got.toxic == 1
    assert toxic.sum() > 50
    rank = got.score.rank()
    auc = (rank[toxic].mean() - (toxic.sum() + 1) / 2) / (~toxic).sum()
    caught = (got[toxic].predicted == 1).mean()
    assert auc > 0.95 and caught >= 0.93 and (got[~toxic].predicted == 1).mean() < 0.01 and ((got.score >= 0.3) == (got.predicted == 1)).all()
    texts = {r["doc_id"]: r["text"] for r in d.join(F.broadcast(spark.createDataFrame(got[got.predicted == 1][["doc_id"]])), "doc_id").select("doc_id", "text").collect()}
    marked = Counter(texts[r.doc_id][s["start"] : s["end"]].lower() for r in got[got.predicted == 1].itertuples() for s in r.spans)
    assert marked["idiot"] and all(w == w.strip() for w in marked)
    edge = toxicity.score(docs(spark, edge_rows()), model).collect()
    assert len(edge) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in edge)
    by = {r["doc_id"]: r["score"] for r in edge}
    assert by[1] == by[2] == by[3]


def plain_toxicity(model, text):
    """Every word in turn: features by themselves, forward and backward over all words."""
    found = re.findall(rb"[0-9a-z\x80-\xff]+", ascii_lower(text or "").encode())
    known = {int(h): i for i, h in enumerate(model.known)}
    emit, marked = [], []
    with np.errstate(over="ignore"):
        for w in found:
            data = np.frombuffer(w, np.uint8)
            value = W._BYTE[data] * W._powers(len(data))[: len(data)]
            hashes = [W.mix(np.add.reduce(value, keepdims=True))[0]] + [W.mix(np.add.reduce(value[:k], keepdims=True) + np.uint64(k * 7919))[0] for k in toxicity.PREFIXES]
            own = [known[int(h)] for h in hashes if int(h) in known]
            emit.append(model.bias + sum(model.weights[i] for i in own))
            marked.append(bool(own))
    turn = np.exp(model.moves)
    a, ahead = np.array([1.0, 0.0]), []
    for e in emit:
        a = a @ turn * [1, np.exp(e)]
        a = a / a.sum()
        ahead.append(a)
    b, back = np.ones(2), []
    for e in reversed(emit):
        back.append(b)
        b = turn @ ([1, np.exp(e)] * b)
        b = b / b.sum()
    p = np.array([x[1] * y[1] / (x @ y) for x, y, m in zip(ahead, reversed(back), marked, strict=True) if m])
    parts = toxicity.summarize(p, len(found))
    return 1 / (1 + np.exp(-(model.score[0] + model.score[1:] @ np.array(parts))))


def test_scores_equal_plain_chains(spark):
    d, labels = read(spark, "documents"), read(spark, "labels")
    model = toxicity.fit(d, labels)
    rows = [*edge_rows()[:5], (8, "You idiot, idiot! " + "plain words " * 40 + "moron", None, None), (9, "trash", None, None)]
    some = read(spark, "documents", "/root/testdata/sf0.001").select("doc_id", "text").union(docs(spark, rows).selectExpr("doc_id + 100000", "text"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(some, model).collect()}
    for r in some.collect():
        assert got[r["doc_id"]] == pytest.approx(plain_toxicity(model, r["text"]))
    assert len({round(v, 6) for v in got.values()}) > 3


def test_toxicity_without_labels(spark):
    e = docs(spark, edge_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(e, none) is None and {r["score"] for r in toxicity.score(e, None).collect()} == {0.0}
    assert toxicity.score(e.where("false"), None).count() == 0


def counts(text):
    w, lines = SPACE.findall(text or ""), (text or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dup, len(inside)


def test_rule_counts(spark):
    d = read(spark, "documents").select("doc_id", "text")
    labels = read(spark, "labels")
    judge = quality.fit(d, labels)
    rows = {r["doc_id"]: r for r in quality.score(d, judge).collect()}
    for r in d.collect():
        own = rows[r["doc_id"]]
        n = counts(r["text"])
        assert (own["n_words"], own["word_chars"], own["n_symbols"], own["n_dup_lines"], own["n_repeat_words"]) == n
        assert own["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (own["base_failed"] and own["kept"])
    known = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if not rows[r["doc_id"]]["base_failed"]]
    assert sum(not r["kept"] for r, q in known if q == 1) <= 0.01 * sum(q == 1 for _, q in known)
    assert sum(not r["kept"] for r, q in known if q == 0) >= 0.9 * sum(q == 0 for _, q in known)


def plain_ratios(text):
    data = (text or "").encode()
    n_words, word_chars, symbols, dup, repeat = counts(text)
    w = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    letters = sum(chr(b).isascii() and chr(b).isalpha() or b >= 0x80 for b in data)
    punctuation = sum(0x20 < b < 0x80 and not chr(b).isalnum() for b in data)
    rough = sum(not all(b >= 0x80 or chr(b).isalpha() or b in b",." for b in x.encode()) for x in w)
    over = lambda a, b: a / max(b, 1)
    return [
        over(symbols, len(text or "")), over(sum(65 <= b <= 90 for b in data), letters), over(punctuation, len(text or "")), over(sum(a == b for a, b in zip(w, w[1:], strict=False)), n_words),
        over(rough, n_words), over(word_chars, n_words), over(dup, len(lines)), over(repeat, n_words),
    ]


def plain_anomaly(forest, row):
    total = 0.0
    for t in range(len(forest.depth)):
        at = 0
        while forest.left[t, at] != at:
            at = forest.left[t, at] + int(row[forest.feature[t, at]] > forest.value[t, at])
        total += forest.depth[t, at]
    return 2 ** (-total / len(forest.depth) / forest.norm)


def test_verdicts_equal_plain_walks(spark):
    """Ratios, their scale, walks through all trees and the threshold, one document at a time."""
    d = read(spark, "documents", "/root/testdata/sf0.001").select("doc_id", "text")
    judge = quality.fit(read(spark, "documents"), read(spark, "labels"))
    rows = {r["doc_id"]: r for r in quality.score(d, judge).collect()}
    for r in d.collect():
        n = counts(r["text"])
        odd = plain_anomaly(judge.forest, quality.scaled(np.array([plain_ratios(r["text"])]))[0])
        assert rows[r["doc_id"]]["anomaly"] == pytest.approx(odd)
        assert rows[r["doc_id"]]["kept"] == (not (n[0] < 50 or 100 * n[4] > 50 * n[0]) and odd <= judge.threshold)


def test_leaves_hold_path_lengths():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (60, 3)).astype(float)
    forest = quality.fit_forest(x, trees=5, tree_rows=60)
    limit = int(np.ceil(np.log2(60)))
    for t in range(5):
        at, depth = np.zeros(60, int), np.zeros(60, int)
        for i in range(60):
            while forest.left[t, at[i]] != at[i]:
                at[i] = forest.left[t, at[i]] + int(x[i, forest.feature[t, at[i]]] > forest.value[t, at[i]])
                depth[i] += 1
        for leaf in set(at):
            inside = at == leaf
            assert forest.depth[t, leaf] == pytest.approx(depth[inside][0] + quality._path(int(inside.sum())))
            assert depth[inside][0] == limit or len(np.unique(x[inside], axis=0)) == 1  # cut until alike, or as deep as trees go


def test_forest_isolates_what_no_range_tells():
    """A row that is high in all ratios at once, and in none outside of what others have."""
    many = 0.1 * np.exp(0.5 * np.random.default_rng(3).normal(size=(4000, 8)))
    odd = np.quantile(many, 0.985, axis=0, keepdims=True)
    rows = quality.scaled(np.concatenate([many, odd]))
    scores = quality.anomaly(quality.fit_forest(rows), rows)
    assert ((odd > many.min(0)) & (odd < many.max(0))).all()
    assert scores[-1] > np.quantile(scores[:-1], 0.998)


def test_forest_held_out():
    """On labelled rows that neither fitted the threshold nor the forest, and not by a range of each ratio."""
    import pyarrow.parquet as pq

    from tidemark.llm._words import slices

    sf = SF.replace("0.01", "0.1")
    d = pq.read_table(f"{sf}/documents.parquet").select(["doc_id", "text"])
    quality_of = dict(zip(*(pq.read_table(f"{sf}/labels.parquet")[c].to_pylist() for c in ("doc_id", "quality")), strict=True))
    parts = [quality.measure(t) for t in slices(d["text"].combine_chunks(), lower=False)]
    counts, ratios = (np.concatenate(x) for x in zip(*parts, strict=True))
    passed = ~quality.base_failed(counts)
    label = np.array([-1 if quality_of.get(i) is None else quality_of[i] for i in d["doc_id"].to_pylist()])[passed]
    ratios = ratios[passed]
    missed, caught = [], []
    for fold in (0, 1):
        fitting = np.arange(len(ratios)) % 2 == fold
        forest = quality.fit_forest(quality.scaled(ratios[fitting]))
        scores = quality.anomaly(forest, quality.scaled(ratios))
        known = fitting & (label >= 0)
        rejected = scores > quality.calibrate(scores[known], label[known] == 1)
        held = ~fitting
        missed.append(rejected[held & (label == 1)].mean())
        caught.append(rejected[held & (label == 0)].mean())
        good = ratios[known & (label == 1)]
        outside = ((ratios < good.min(0)) | (ratios > good.max(0))).any(1)
        assert (rejected != outside).sum() > 20
    assert np.mean(missed) <= 0.004 and np.mean(caught) >= 0.9, (missed, caught)


def test_rule_edges(spark):
    e = docs(spark, edge_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judge = quality.fit(e, none)
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.score(e, judge).collect())
    assert got == sorted((str(i), *counts(t)) for i, t, _, _ in edge_rows())
    assert judge.threshold == 1.0 and quality.fit(e.where("false"), none).forest is None
    kept = quality.keep(e, judge)
    assert kept.columns == e.columns and quality.keep(e.where("false"), judge).count() == 0


def test_calibration():
    good = np.array([True] * 100 + [False] * 3)
    scores = np.concatenate([np.linspace(0.3, 0.5, 100), [0.8, 0.9, 0.4]])
    t = quality.calibrate(scores, good, 0.0)
    assert 0.5 <= t < 0.8 and quality.calibrate(scores[:100], good[:100]) == 1.0


def test_threshold_comes_from_all_labelled_rows(spark, monkeypatch):
    """That of all good rows, however many, and not of those that a limit leaves."""
    d, labels = read(spark, "documents"), read(spark, "labels")
    judge = quality.fit(d, labels, fit_rows=100)
    rows = quality.score(d, judge).where("not base_failed").join(labels, "doc_id").select("quality", "anomaly").where("quality is not null").toPandas()
    assert judge.threshold == quality.calibrate(rows["anomaly"].to_numpy(), rows["quality"].to_numpy() == 1)
    assert not hasattr(quality, "LABEL_ROWS")
    rejects = quality.fit(d, labels, fit_rows=100, max_false_rejects=0.25).threshold
    assert rejects == quality.calibrate(rows["anomaly"].to_numpy(), rows["quality"].to_numpy() == 1, 0.25) < judge.threshold
    x = np.random.default_rng(1).normal(size=(5 * 8, 3))
    drawn = []
    monkeypatch.setattr(quality, "_path", lambda n: drawn.append(n) or 0.0)
    quality.fit_forest(x, trees=5, tree_rows=8)
    assert sum(drawn) == 40 + 8  # each row in one tree; the last is the norm
