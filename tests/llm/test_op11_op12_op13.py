import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import SF, ascii_lower, docs, edge_rows
from tidemark.llm import bpe, fim, merkle
from tidemark.llm.queries import op11_merkle_manifest, op12_fill_in_middle, op13_byte_bpe


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, arity=8):
    """The top of a tree over these digests, and for each of them its runs and places from the lowest on."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for k, i in enumerate(at):
            paths[k].append((runs[i // arity], i % arity))
        at = [i // arity for i in at]
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


def manifest_of(rows, arity=8):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        low = None if text is None else ascii_lower(text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        h = leaf_of(doc_id, source, lang, n_chars, text)
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, h, leaf_of(doc_id, source, lang, n_chars, low) if hit else h))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: tree([r[2] for r in sorted(groups[g])], arity) for g in names}
    root, above = tree([below[g][0] for g in names], arity)
    out = Counter()
    for g, path in zip(names, above, strict=True):
        for (known, doc_id, h, folded), own in zip(sorted(groups[g]), below[g][1], strict=True):
            siblings = ""
            for run, slot in own + path:
                siblings += "".join(run[:slot] + run[slot + 1 :])
                folded = sha("".join([*run[:slot], folded, *run[slot + 1 :]]))
            out[doc_id if known else None, h, below[g][0], root, sha(siblings), folded, folded == root] += 1
    return out


def manifests(df, **kw):
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in merkle.manifest(df, **kw).collect())


def with_chars(rows):
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.mark.parametrize(("arity", "step", "block"), [(8, 7, 4), (2, 1, 1), (3, 2, 2)])
def test_manifest_equals_brute_force(spark, arity, step, block):
    rows = [(i * 7 % 400, f"Text {i % 90} ABC", "en" if i % 3 else "de", "s") for i in range(300)]
    rows += [*edge_rows(), *[(77, "often Repeated", "en", "x")] * 200, (3, "Ünï É", "ünï", None), (4, "a single leaf", "fr", ""), (None, None, None, None), (None, "b", None, "b")]
    d = docs(spark, rows).repartition(7)
    assert manifests(d, arity=arity, step=step, block=block) == manifest_of(with_chars(rows), arity)


def test_manifest_of_many_groups_and_of_one(spark):
    rows = [(i, f"T{i}", f"g{i % 70}", "s") for i in range(300)]
    assert manifests(docs(spark, rows)) == manifest_of(with_chars(rows))
    one = [(5, "A", "en", "s")]
    assert manifests(docs(spark, one)) == manifest_of(with_chars(one))
    assert next(iter(manifest_of(with_chars(one))))[4] == sha("")
    assert merkle.manifest(docs(spark, rows).where("false")).collect() == []


def test_partial_parents_wait_for_all_children():
    digests = {i: bytes([i]) * 32 for i in range(20)}
    whole = merkle.Open(8)
    for i, d in digests.items():
        whole.add("g", 20, 0, i, d)
    assert not whole.partial and [r[0] for r in whole.out] == ["link", "link", "link", "link", "top"]
    halves = [merkle.Open(8), merkle.Open(8)]
    for i, d in digests.items():
        halves[i % 2].add("g", 20, 0, i, d)  # no parent is complete in either half
    for h in halves:
        h.flush()
        assert {r[0] for r in h.out} == {"open"}
    met = merkle.Open(8)
    for _, grp, n, level, index, slots, run in [r for h in halves for r in h.out]:
        met.merge(grp, n, level, index, slots, run)
    assert sorted(met.out) == sorted(whole.out)


def test_frontier_of_few_open_parents(spark):
    d = spark.range(20_000).selectExpr("id AS doc_id", "'en' AS lang", "'s' AS source", "1L AS n_chars", "concat('t', id) AS text")
    ranked = merkle.rank(merkle.leaves(d).selectExpr("grp", "doc_id", "leaf AS digest", "tampered"), ["doc_id", "digest"])
    assert ranked.selectExpr("count(DISTINCT pos) = 20000 AND max(pos) = 19999 AND bool_and(n = 20000)").first()[0]
    assert ranked.selectExpr("bool_and(pos = doc_id)").first()[0]
    nodes = merkle.combine(ranked)
    assert {(r["kind"], r["count"]) for r in nodes.groupBy("kind").count().collect()} == {("link", 2500 + 313 + 40 + 5 + 1), ("top", 1)}


def test_manifest_query(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in op11_merkle_manifest(spark, SF).collect())
    assert got == manifest_of([tuple(r) for r in d.collect()])
    assert {v for *_, v in got} == {True, False}


# Fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def cut_of(doc_id, text, percent=50):
    text = text or ""
    u = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return doc_id, len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (doc_id, len(u), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")))


@pytest.mark.parametrize("percent", [50, 100])
def test_middles_equal_brute_force(spark, percent):
    rows = [*edge_rows(), *[(70, "copies of one text " * 9, "en", "a")] * 400, (12, "has <M> in it", "en", "a"), (13, "ends with <S", "en", "a"), (14, " \t lead and trail \n\n", "en", "a"), (15, "x", "en", "a"), (16, "🙂 é b\x1c c\x85d", "en", "a")]
    rows += [(100 + i, "\n".join(f"w{j} <v> " for j in range(i)), "en", "a") for i in range(60)]
    made = fim.transform(docs(spark, rows), cut_percent=percent)
    got = made.withColumn("back", fim.restore("output", "form")).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(cut_of(r[0], r[1], percent) for r in rows)
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((r[0], r[1] or "") for r in rows)
    assert fim.transform(docs(spark, rows).where("false")).collect() == []
    assert fim.transform(docs(spark, [(1, None, None, None)])).collect()[0]["form"] == "plain"


def test_middles_in_small_partitions(spark):
    rows = [(i, "word and  more words " * (1 + i % 40), "en", "a") for i in range(300)]
    got = fim.transform(docs(spark, rows), cut_percent=100, unit_bytes=5_000).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(cut_of(r[0], r[1], 100) for r in rows)


def test_middles_query(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [cut_of(r["doc_id"], r["text"]) for r in d]
    got = op12_fill_in_middle(spark, SF).collect()
    assert Counter(tuple(r) for r in got) == Counter((*w[:5], sha(w[5]), sha(r["text"] or "")) for w, r in zip(want, d, strict=True))


# Byte-level BPE


@pytest.fixture(scope="module")
def own():
    return bpe.vocabulary(bpe.TOKENIZER, bpe.kinds())


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(bpe.TOKENIZER), special_tokens={})


@pytest.fixture
def small_leaves(monkeypatch, own):
    monkeypatch.setattr(bpe, "LEAF", 5)
    monkeypatch.setattr(bpe, "WHOLE", 3)
    own.known.clear()
    yield
    own.known.clear()


PIECES = ["abc ", "ab'rels t", "  \n\t a", "0123 ab", "漢字かな ", "éàü ß'", "a", "՘x ࢏", "ab　 \x85 .,;!'s", "🙂👍 a", "'ll've're", "<|endoftext|>"]


def test_every_token_is_reached_by_merges():
    bpe.check(bpe.TOKENIZER)


def test_short_pieces_are_merged_lowest_rank_first(own):
    ranks, rng = bpe._ranks(bpe.TOKENIZER), random.Random(4)
    for _ in range(300):
        data = "".join(rng.choice("abeilnrst éß漢") for _ in range(rng.randrange(1, 30))).encode()
        assert [own.bytes_of[t] for t in own.merge(data)] == bpe.lowest_first(ranks, data)


def test_trees_encode_as_the_library(own, library, small_leaves):
    rng = random.Random(3)
    for _ in range(3000):
        pool = rng.choice(PIECES) if rng.random() < 0.8 else "".join(PIECES)
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 90)))
        ids = own.encode(text)
        assert list(bpe._ids(ids)) == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_elements_join(own, library, a, b):
    whole = own.join(own.element(a), own.element(b))
    assert list(bpe._ids(b"".join(whole.ids))) == library.encode_ordinary(a + b)
    assert whole.matches == own.matches(a + b)


def test_long_words_and_blanks(own):
    for text in ("a" * 50_000, " " * 50_000 + "x", "漢" * 20_000, "\n " * 20_000, "xyzw" * 9_000):
        assert own.decode(own.encode(text)) == text.encode()
    for unit in ("a", "xyz", "漢"):  # of one match, held against merges without halves
        assert own.encode_bytes((unit * 3000).encode()) == own.merge((unit * 3000).encode())


def test_encoding_in_tasks_and_rounds(spark, library):
    long = "".join(random.Random(8).choice([*PIECES, "plain words ", "x" * 40]) for _ in range(3000))
    rows = [*edge_rows(), (20, long, "en", "a"), (20, long, "en", "a"), (None, long[:900], "en", "a"), (21, "y" * 5000, "en", "a"), (22, " " * 3000, "en", "a")]
    d = docs(spark, rows)
    want = Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t, *_ in rows)
    for part, fan in ((700, 2), (500, 8), (bpe.PART, bpe.FAN)):
        encoded = bpe.encode(d, part=part, fan=fan)
        assert Counter((r["doc_id"], bpe._ids(bytes(r["ids"]))) for r in encoded.collect()) == want
    decoded = bpe.decode(encoded).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in decoded) == Counter((i, (t or "").encode()) for i, t, *_ in rows)
    assert bpe.digest(d.where("false")).collect() == []


def test_bpe_query(spark, library):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for r in d:
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), sha(r["text"] or "")] += 1
    assert Counter(tuple(r) for r in op13_byte_bpe(spark, SF).collect()) == want
