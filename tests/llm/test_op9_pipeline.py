import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import OWN, docs, edge_rows, hashed, shingles
from tidemark.llm import line_dedup, quality
from tidemark.llm import ngram_join as J


def plain_classes(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    post = defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j in {j for t in s for j in post[t]}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
        for t in s:
            post[t].append(i)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(low.get(find(i)))) for i, r in enumerate(rows))


def corpus(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    fresh = lambda n: [r.choice(words) for _ in range(n)]
    out = []
    passage = fresh(60)
    for g in range(12):
        base = fresh(r.choice([6, 20, 60, 300]))
        for _ in range(r.choice([1, 2, 3, 40, 90])):
            t = list(base)
            for _ in range(r.randrange(0, max(1, len(t) // 25) + 1)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
    out += [" ".join(fresh(30) + passage + fresh(r.randrange(5, 60))) for _ in range(150)]
    out += [" ".join(fresh(n)) for n in (1, 2, 3, 4, 5) for _ in range(2)] + ["A b c", "a B c", "x"] * 2
    out += [out[-40]] * 150
    r.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("block", "bucket", "large"), [(4096, 400_000, 4), (16, 500, 4), (4096, 3000, 0.2)])
def test_classes(spark, monkeypatch, block, bucket, large):
    """As it runs; with long lists in many blocks; with all buckets of tokens split by node."""
    monkeypatch.setattr(J, "LARGE", large)
    rows = corpus()
    got = J.classes(docs(spark, [(i, t, None, None) for i, t in rows]).repartition(5), block, bucket).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain_classes(rows)


def test_edges(spark):
    rows = [*edge_rows(), (9, "ONE", None, None), (0, "one", None, None), (None, "no id", None, None), (None, None, None, None), (7, "other text entirely under the same id", None, None)]
    got = J.classes(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain_classes(rows)
    none = docs(spark, rows).where("false")
    assert J.classes(none).count() == 0 and J.keep_one(none).count() == 0
    kept = J.keep_one(docs(spark, rows))
    assert all(r[n] == v for r in kept.collect() for n, v in OWN.items())
    assert kept.columns == none.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "5", "6", "7", "8", "0", "None", "None", "None"])


@pytest.mark.parametrize("rare", [0, 2, 64])
def test_similar_sets_share_a_signature(monkeypatch, rare):
    """Whatever the frequencies are: two sets at the threshold always meet."""
    monkeypatch.setattr(J, "RARE", rare)
    r = np.random.default_rng(rare)
    often = lambda tokens: 2 + (tokens >> np.uint64(3)) % np.uint64(200)  # noqa: E731  any global function of the token will do
    for _ in range(400):
        n = int(r.integers(1, 400))
        common = int(n * r.uniform(0.86, 1))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.permutation(len(a))[:common]], r.integers(0, 2**63, n - common, dtype=np.uint64)]))
        if not J.linked(a, b):
            continue
        pa_, pb = (np.sort(x)[: int(J.prefix_size(len(x)))] for x in (a, b))
        shared = np.intersect1d(pa_, pb)
        assert len(shared) >= max(J.overlap(len(a)), J.overlap(len(b))) or len(shared) >= min(J._spare(len(a)), J._spare(len(b))) + 1
        # Some other node may have further tokens of either: more shared tokens must not part the two.
        sa = np.union1d(shared, pa_[r.random(len(pa_)) < 0.3])
        sb = np.union1d(shared, pb[r.random(len(pb)) < 0.3])
        assert len(np.intersect1d(J.signatures(len(a), sa, often(sa)), J.signatures(len(b), sb, often(sb))))


def test_bitmaps_never_part_links():
    r = np.random.default_rng(9)
    for _ in range(200):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(n * r.uniform(0.5, 1))], r.integers(0, 2**63, int(r.integers(0, 40)), dtype=np.uint64)]))
        x, y = (np.frombuffer(J._bitmap(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        apart = int(np.bitwise_count(J._fold(x, size) ^ J._fold(y, size)).sum())
        assert apart <= len(np.setxor1d(a, b)) and (not J.linked(a, b) or J._may_link(apart, len(a) + len(b)))


def test_linked_at_the_threshold():
    a = np.arange(100, dtype=np.uint64)
    assert J.linked(a, a[:75]) and not J.linked(a, a[:74]) and not J.linked(a[:0], a[:0])
    assert len(hashed(["a b c"])[0]) == 1


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "mixing", "packing"]
    d = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [d]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    assert all(x.columns == d.columns for x in seen[1:5])
    rows = [[tuple(r) for r in x.collect()] for x in seen]
    judge = quality.fit(d, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.score(d, judge).where("kept").collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r[0] in kept) and len(rows[1]) < len(rows[0])
    c = duckdb.connect()
    c.register("documents", seen[1].toPandas())
    assert sorted((r[0], r[1]) for r in rows[2]) == sorted((r[0], r[1]) for r in c.execute(line_dedup.ORACLE_SQL).fetchall())
    assert sorted(r[0] for r in rows[2]) == sorted(r[0] for r in rows[1])
    classes = {int(i): c for i, _, c in plain_classes([(r[0], r[1]) for r in rows[2]])}
    assert sorted(r[0] for r in rows[3]) == sorted(i for i, c in classes.items() if str(i) == c)
    assert set(rows[4]) <= set(rows[3]) <= set(rows[2])
    copies = defaultdict(int)
    for r in rows[4]:
        copies[r[0]] += 1
    assert max(copies.values()) <= 3
    pieces = defaultdict(int)
    for r in rows[5]:
        pieces[r[0]] += r[1] == 0
    assert dict(pieces) == dict(copies)
    encoder, wanted = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in rows[4]:
        ids = [*encoder.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 2048):
            wanted[r[0], a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()), len(ids)] += 1
    assert Counter(tuple(r[:5]) for r in rows[5]) == wanted
    assert corpus_pipeline.run(spark, sf).count() == len(rows[5])


def test_pipeline_on_nothing(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, "/root/testdata/sf0.001")
        assert d.count() == 0
