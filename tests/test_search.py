import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.errors import IndexError_, QueryError
from tidemark.functions import cut
from tidemark.functions import text as X
from tidemark.operators import ann, embedding, fuzzy, hybrid, text_index, text_search, vector_search
from tidemark.operators.embedding import HashingEmbedder
from tidemark.plans.query_parser import Bool, Phrase, Range, Term, parse

CORPUS = [(1, "fire wood fire"), (2, "fire and water"), (3, "water well")]


@pytest.fixture(scope="module")
def index(spark):
    d = spark.createDataFrame(CORPUS, "id int, text string")
    return text_index.postings(d).cache(), text_index.corpus_stats(d).cache()


def scores(df):
    return {r["id"]: round(r["score"], 4) for r in df.collect()}


def test_postings_two_ways(spark):
    d = spark.createDataFrame([*CORPUS, (4, None), (5, "")], "id int, text string")
    rows = lambda df: sorted((r["term"], r["id"], r["tf"], r["dl"], list(r["positions"])) for r in df.collect())
    assert rows(text_index.postings(d)) == rows(text_index.exploded_postings(d))
    assert ("water", "2", 1, 2, [2]) in rows(text_index.postings(d))


@pytest.mark.parametrize(
    ("query", "plain", "boosted"),
    [("fire", {"1": 0.5982, "2": 0.4992}, {"1": 1.7946, "2": 1.4975}), ("fire wood", {"1": 1.4764, "2": 0.4992}, {"1": 9.6251, "2": 0.4992}), ("water well", {"3": 1.5409, "2": 0.4992}, {"3": 10.7862, "2": 0.4992})],
)
def test_bm25(index, query, plain, boosted):
    assert scores(text_search.or_scores(*index, query)) == pytest.approx(plain, abs=1e-4)
    assert scores(text_search.boosted_scores(*index, query)) == pytest.approx(boosted, abs=2e-4)


def test_phrases_keep_gaps(index):
    ids = lambda q: {r["id"] for r in text_search.phrase_matches(index[0], q).collect()}
    assert ids("fire and water") == {"2"} and ids("fire water") == set() and ids("fire wood") == {"1"} and ids("and") == set()
    assert text_search.phrase_matches(index[0], "wood fire").first()["tf"] == 1


def test_grammar():
    assert parse("a") == Term("a")
    assert parse("a AND b") == Bool(must=(Term("a"), Term("b")))
    assert parse("a OR b AND c") == Bool(should=(Term("a"), Bool(must=(Term("b"), Term("c")))))
    assert parse("a -b +c") == Bool(must=(Term("c"),), should=(Term("a"),), must_not=(Term("b"),))
    assert parse('category:/x "two words"^2') == Bool(should=(Term("/x", "category"), Phrase("two words", None, 2.0)))
    assert parse("id:[a TO c]") == Range("id", "a", "c")
    assert parse("(a OR b) AND NOT c") == Bool(must=(Bool(should=(Term("a"), Term("b"))),), must_not=(Term("c"),))
    assert parse("a b", conjunctive=True) == Bool(must=(Term("a"), Term("b")))
    for bad in ("", "(a", "a AND", "OR a", "a)", "^2"):
        with pytest.raises(QueryError):
            parse(bad)


def test_boolean_queries(spark, index):
    stored = spark.createDataFrame([("1", "/a/x"), ("2", "/a/y"), ("3", "/b")], "id string, category string")
    ids = lambda q: {r["id"] for r in text_search.search_query(q, *index, stored).collect()}
    assert ids("fire") == {"1", "2"} and ids("fire AND water") == {"2"} and ids("water NOT well") == {"2"}
    assert ids("category:/a AND fire") == {"1", "2"} and ids("category:/a/y") == {"2"} and ids("id:[2 TO 3]") == {"2", "3"}
    with pytest.raises(QueryError):
        ids("NOT fire")
    counts = {r["facet"]: r["count"] for r in text_search.facet_counts(stored, text_search.or_scores(*index, "fire water")).collect()}
    assert counts == {"/a": 2, "/b": 1}
    assert {r["facet"] for r in text_search.facet_counts(stored, text_search.or_scores(*index, "fire"), "/a").collect()} == {"/a/x", "/a/y"}
    assert [r["term"] for r in text_search.fuzzy_terms(index[0], "wate", 1).collect()] == ["water"]


def test_fragment():
    got = text_search.best_fragment("x " * 100 + "a <fire> & wood here " + "y " * 100, {"fire": 1.0, "wood": 2.0})
    assert "<b>fire</b>" in got and "<b>wood</b>" in got and "&lt;" in got and "&amp;" in got
    assert text_search.best_fragment("nothing", {"fire": 1.0}) == ""


def test_index_on_disk(spark, tmp_path):
    index = text_index.TextIndex(spark, str(tmp_path / "i"))
    with pytest.raises(IndexError_):
        index.postings  # noqa: B018
    d = spark.createDataFrame([(str(i), t, "/c", f"/p/{i}") for i, t in CORPUS], "id string, content string, category string, doc_path string")
    index.write(d)
    hits = text_search.search(index, "fire wood", 2).collect()
    assert [h["id"] for h in hits] == ["1", "2"] and hits[0]["score"] > hits[1]["score"] and hits[0]["path"] == "/p/1" and "<b>fire</b>" in hits[0]["snippet"]
    assert text_search.search_hits(index, "fire", 1).first()["source"] == "text"
    plan = index.postings.where(F.col("term").isin(["fire"]))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "fire" in plan.split("PushedFilters")[1]


def test_documents_and_queries_have_the_same_tokens(spark):
    """Indic and Thai scripts, combining marks, and letters that libraries disagree about."""
    texts = ["हिन्दी भाषा", "ภาษาไทย น้ำ", "cafe\u0301 e\u0363x", "தமிழ் மொழி", "Straße ΣΊΣΥΦΟΣ İstanbul", "x\u0f82y ²³ ⅷ", "漢字かな交じり文", "emoji 🙂 a_b"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    p, s = text_index.postings(d), text_index.corpus_stats(d)
    for r in d.select("id", X.tokens("text").alias("t"), "text").collect():
        assert list(text_search._cut(r["text"])) == list(r["t"])
        assert str(r["id"]) in scores(text_search.or_scores(p, s, r["text"]))
        assert str(r["id"]) in {x["id"] for x in text_search.phrase_matches(p, r["text"]).collect()}
    shown = text_search.snippets(d, "हिन्दी น้ำ", text_col="text").collect()
    assert shown[0]["snippet"] == "<b>हिन</b>्<b>दी</b>" and shown[2]["snippet"] == ""


def test_postings_meet_their_terms_without_a_shuffle(spark, tmp_path):
    index = text_index.TextIndex(spark, str(tmp_path / "i"))
    index.write(spark.createDataFrame([(str(i), t) for i, t in CORPUS], "id string, content string"))
    plain = text_index.postings(spark.createDataFrame(CORPUS, "id int, text string")), text_index.corpus_stats(spark.createDataFrame(CORPUS, "id int, text string"))
    for f in (text_search.or_scores, text_search.boosted_scores, text_search.phrase_scores):
        for q in ("fire wood", "fire and water", "water"):
            assert scores(f(index.postings, index.numbers, q)) == pytest.approx(scores(f(*plain, q)))
    plan = text_search.or_scores(index.postings, index.numbers, "fire wood")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("BroadcastHashJoin") == 1 and plan.count("Exchange hashpartitioning") == 1 and plan.count("In(term") == 2
    assert text_search.correct(index.terms, "watre fire", 4) == "watre fire" and text_search.correct(index.terms, "waters", 4) == "water"
    assert [h["id"] for h in text_search.search(index, "waters", 5, edits=4).collect()] == [h["id"] for h in text_search.search(index, "water", 5).collect()]


def test_fusion(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.4)], "id string, score double")
    t = spark.createDataFrame([("b", 2.0), ("a", 0.9), ("d", 0.1)], "id string, score double")
    assert [tuple(r) for r in hybrid.fuse(v, t, 3).collect()] == [("b", 2.0, "text"), ("a", 0.9, "vector"), ("c", 0.4, "vector")]
    assert [r["id"] for r in hybrid.fuse(v, t, 2, "rrf").collect()] == ["a", "b"]
    assert hybrid.fuse(v, t, 4, "minmax").count() == 4
    with pytest.raises(ValueError, match="no fusion"):
        hybrid.fuse(v, t, 1, "other")


def test_rerank(spark):
    c = spark.createDataFrame([("x", 0.8, "campfires"), ("y", 0.6, "a fire pit")], "id string, score double, content string")
    assert [(r["id"], round(r["score"], 2)) for r in vector_search.lexical_rerank(c, "Fire Pit", 2).collect()] == [("y", 0.72), ("x", 0.71)]
    assert vector_search.lexical_rerank(c, "", 1).first()["score"] == pytest.approx(0.56)


def test_hashing_embedder():
    v = HashingEmbedder(64).embed_one("hello world")
    assert v[2] == pytest.approx(0.982905, abs=1e-5) and v[38] == pytest.approx(0.184111, abs=1e-5)
    v = HashingEmbedder(1024).embed_one("hello world hello")
    assert v[166] == pytest.approx(0.375181, abs=1e-5) and v[962] == pytest.approx(0.926952, abs=1e-5)


@pytest.mark.parametrize(("n", "nlist"), [(0, 1), (1, 1), (2, 1), (32, 31), (300, 299), (2048, 2047), (2049, 2048), (2050, 2048), (10**6, 2048), (4 * 10**6, 4000), (25 * 10**6, 10000), (2 * 10**9, 65536)])
def test_ivf_params(n, nlist):
    assert ann.ivf_params(n, 64) == ann.IvfPqParams(nlist, 16, 8) and ann.ivf_params(n, 1024).m == 32


def test_ivf_recall(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector")
    first = ann.IvfPq.build(e, str(tmp_path / "ivf"), ann.IvfPqParams(16, 16))
    index = ann.IvfPq.load(spark, str(tmp_path / "ivf"))
    assert index.params == ann.IvfPqParams(16, 16) and index.vectors.count() == e.count()
    some, recall = ann.validate_index(index, sample=8, k=10, nprobe=12)
    assert some and recall >= 0.85
    by = dict(ann.recalls(index, (1, 16), sample=5))
    assert by[1] <= by[16] and by[16] >= 0.95
    plan = index.vectors.where(F.col("ivf_cell").isin([1, 2]))._jdf.queryExecution().toString()
    assert "In(ivf_cell" in plan
    second = ann.IvfPq.build(e, str(tmp_path / "ivf"), ann.IvfPqParams(4, 16))
    assert ann.IvfPq.load(spark, str(tmp_path / "ivf")).params.nlist == 4 and ann.IvfPq.load(spark, str(tmp_path / "ivf"), first).params.nlist == 16 and first != second


def test_two_levels_give_all_centroids(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector")
    index = ann.IvfPq.train(e, ann.IvfPqParams(40, 16), task_rows=100)
    assert 36 <= len(index.centroids) <= 44 and len(np.unique(index.centroids.round(6), axis=0)) == len(index.centroids)
    x = np.array([r["vector"] for r in e.collect()])
    spread = lambda c: (((x - c[ann._nearest(x, c)]) ** 2).sum(1)).mean()
    assert spread(index.centroids) < spread(ann._kmeans(x, 40, rounds=1)) * 1.2


def test_many_queries_at_once(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[:130] = 2 * x[0] + 0.5 * x[:130]  # a large cell
    t = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<float>")
    ann.IvfPq.build(t, str(tmp_path / "ivf"), ann.IvfPqParams(8, 4))
    index = ann.IvfPq.load(spark, str(tmp_path / "ivf"))
    q = t.where("id % 20 = 0").selectExpr("id AS query_id", "vector AS query")
    exact = {(r["query_id"], r["id"]) for r in vector_search.batch_search(t, q, 5).collect()}
    for cell_rows in (50_000, 30):
        got = index.batch_search(q, 5, nprobe=8, refine_factor=100, cell_rows=cell_rows).collect()
        assert {(r["query_id"], r["id"]) for r in got} == exact and {r["rank"] for r in got} == {1, 2, 3, 4, 5}
    one = {r["id"]: r["score"] for r in index.search([float(c) for c in x[40]], 5, nprobe=3, refine_factor=20).collect()}
    many = {r["id"]: r["score"] for r in index.batch_search(q.where("query_id = 40"), 5, nprobe=3, refine_factor=20).collect()}
    assert many == pytest.approx(one)
    same = spark.range(300).selectExpr("id", "array(1.0f, 2.0f) AS vector")
    assert ann.IvfPq.train(same, ann.IvfPqParams(4, 2), task_rows=50).centroids.shape[1] == 2


def test_near_terms_by_key_are_those_of_a_scan(spark):
    """Random words of few letters, some beyond ASCII, some longer than a prefix, with edits at all places."""
    rng = random.Random(5)
    words = {"".join(rng.choices("abcé漢🙂", k=rng.randrange(1, 14))) for _ in range(70)}
    for w in list(words):
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:i] + "x" + w[i:], w[:i] + w[i + 1 :], w[:i] + "é" + w[i + 1 :]]) or "a")
    words = sorted(words)
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    near = fuzzy.neighbourhood(terms).cache()
    assert near.groupBy("term").count().agg(F.max("count")).first()[0] <= 37

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    true = {(a, b, edits(a, b)) for a in words for b in words if abs(len(a) - len(b)) <= 2}
    asked = spark.createDataFrame([(w,) for w in [*words, *words, None]], "word string")
    for d in (0, 1, 2):
        assert {tuple(r) for r in fuzzy.join(asked, near, d).collect()} == {t for t in true if t[2] <= d}
    assert fuzzy.join(asked, near).count() == sum(t[2] <= 2 for t in true)
    for w in (words[0], words[-1], "é" * 20, "ab"):
        wanted = {(b, edits(w, b)) for b in words if edits(w, b) <= 2}
        assert {tuple(r) for r in fuzzy.lookup(near, w, 2).collect()} == {tuple(r) for r in fuzzy.scan(terms, w, 2).collect()} == wanted
    assert fuzzy.join(asked.limit(0), near).isEmpty() and fuzzy.join(asked, near.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        fuzzy.join(asked, near, 3)


def test_fuzzy_index_and_grammar(spark, tmp_path):
    index = text_index.TextIndex(spark, str(tmp_path / "i"))
    index.write(spark.createDataFrame([("1", "fire and wood"), ("2", "fires, water"), ("3", "well")], "id string, content string"))
    index.append(spark.createDataFrame([("4", "firs stone"), ("5", "farm")], "id string, content string"))
    near = lambda w, d=2: {r["term"]: r["distance"] for r in index.near(w, d).collect()}
    assert near("fire") == {"fire": 0, "fires": 1, "firs": 1, "farm": 2} and near("fire", 1) == {"fire": 0, "fires": 1, "firs": 1} and near("stonework", 4) == {"stone": 4}
    plan = index.near("fire")._jdf.queryExecution().executedPlan().toString()
    assert "In(key" in plan
    ids = lambda q: {r["id"]: r["score"] for r in text_search.search_query(q, index.postings, index.numbers, near=index.near).collect()}
    assert ids("fire~1") == ids("Fire~1") == {"1": 1, "2": 1, "4": 1} and set(ids("fire~0")) == {"1"} and ids("farn~1^3") == {"5": 3.0}
    assert ids("fire~ -stome~1") == {"1": 1, "2": 1, "5": 1} and ids("watre~1") == {} and set(ids("watre~")) == {"2"}
    scanned = text_search.search_query("fire~1", index.postings, index.numbers).collect()
    assert {r["id"] for r in scanned} == {"1", "2", "4"}
    index.delete(spark.createDataFrame([("4",)], "id string"))
    assert near("fire") == {"fire": 0, "fires": 1, "farm": 2} and set(ids("fire~1")) == {"1", "2"}
    assert [r["term"] for r in index.near_words(spark.createDataFrame([("farmer",), ("wel",)], "word string")).orderBy("term").collect()] == ["farm", "well"]
    index.merge(whole=True)
    assert near("fire") == {"fire": 0, "fires": 1, "farm": 2}
    for bad in ("category:a~1", "a.b~1"):
        with pytest.raises(QueryError):
            ids(bad)
    assert text_search.correct(index.terms, "waterr", 4, index.near) == "water" == text_search.correct(index.terms, "waterr", 4)
    few, text_search.FEW_TERMS = text_search.FEW_TERMS, 1
    try:
        assert set(ids("fire~1")) == {"1", "2"}
    finally:
        text_search.FEW_TERMS = few


def test_building_an_index_shuffles_no_token(spark, monkeypatch):
    """A document's tokens are counted where it is read, some documents at a time; a dictionary has three keys a term."""
    texts = [(i, " ".join(f"w{i * j % 7} the é{j}" for j in range(i))) for i in range(9)] + [(9, None), (10, "")]
    d = spark.createDataFrame(texts, "id int, text string")
    rows = lambda df: sorted((r["term"], r["id"], r["tf"], r["dl"], list(r["positions"])) for r in df.collect())
    wanted = rows(text_index.postings(d))
    for held in (1, 7, 10_000):
        monkeypatch.setattr(text_index, "HELD_TOKENS", held)
        assert rows(text_index.exploded_postings(d.coalesce(1))) == wanted
    assert "Exchange" not in text_index.exploded_postings(d)._jdf.queryExecution().executedPlan().toString()
    near = fuzzy.neighbourhood(spark.createDataFrame([("licenses",), ("a",), ("",)], "term string"))
    assert near.groupBy("term").count().agg(F.max("count")).first()[0] == 3


def test_texts_are_cut_as_by_the_expression(spark):
    """All code points, ends of texts, words beside nulls: what numpy cuts is what Spark's expression cuts."""
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    rows = [every[a : a + 700] + "a" for a in range(0, len(every), 700)] + [None, "", " ", "a", "é", "b é", "𝒜", "-", "x", "İΑΣ ΑΣ the\x00and", "日本 日本"]
    d = spark.createDataFrame(list(enumerate(rows)), "i int, text string").coalesce(1)
    letters = cut.members(X.TOKEN)

    @F.arrow_udf("array<string>")
    def tokens(x: pa.Array) -> pa.Array:
        found, n = cut.runs(x, cut.table(letters))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), found.cast(pa.string()))

    got = d.select(X.tokens("text").alias("a"), tokens(F.lower("text")).alias("b"), F.size(X.terms("text")).alias("n"), text_index.lengths(F.col("text")).alias("m"))
    assert got.where("not (coalesce(a, array()) <=> b) or not (n <=> m)").count() == 0
    assert np.flatnonzero(cut.table(cut.members(X.BLANKS))).tolist() == sorted(map(ord, X.WHITE_SPACE))


def test_hashed_vectors(spark):
    """A word is hashed once for a batch of texts; the sums are those of a loop, bit by bit."""
    rows = [None, "", " \u2003", "a", "A a b\u00a0É\x1cx", "fire " * 5000, "Fire\tand wood"]
    d = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    for dim in (16, 5):
        got = [r["v"] for r in d.select("i", embedding.md5_embedding("text", dim).alias("v")).orderBy("i").collect()]
        for text, v in zip(rows, got, strict=True):
            if text is None:
                assert v == [None] * dim
                continue
            cells = [0.0] * dim
            for w in re.split(f"[{X.WHITE_SPACE}]+", text.lower()):
                if w:
                    cells[int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % dim] += 1
            n = max(sum(c * c for c in cells) ** 0.5, 1e-6)
            assert v == [c / n for c in cells]
    assert "ArrowEval" in d.select(embedding.md5_embedding("text"))._jdf.queryExecution().executedPlan().toString()


def test_postings_are_shuffled_packed(spark, tmp_path, monkeypatch):
    """A row of the shuffle has many postings of a term, whose numbers are bytes; what comes out is what went in."""
    texts = [(str(i), " ".join(f"w{i * j % 5} the é{j}" for j in range(i % 50))) for i in range(300)] + [("none", None), ("", "w1 " * 40_000)]
    d = spark.createDataFrame(texts, "id string, text string")
    rows = lambda df: sorted((r["term"], r["id"], r["tf"], r["dl"], list(r["positions"])) for r in df.collect())
    wanted = rows(text_index.postings(d))
    for held, pack in ((1, 1), (40, 3), (2_000_000, 16)):
        monkeypatch.setattr(text_index, "HELD_TOKENS", held), monkeypatch.setattr(text_index, "PACK", pack)
        packed = text_index.exploded_postings(d.coalesce(1)).mapInArrow(text_index.packed, text_index.PACKED)
        assert rows(packed.mapInArrow(text_index.unpacked, text_index.POSTING)) == wanted
    assert packed.count() < len(wanted) / 8
    index = text_index.TextIndex(spark, str(tmp_path / "i"))
    index.write(d, "id", "text")
    assert rows(index.entries) == wanted


def test_exact_batch_search_in_blocks(spark):
    """Blocks of any size give what one gives: ties by id, vectors of another length and null ones apart."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6)).round(1)
    x[30:] = x[:30]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, None), (61, [1.0, 2.0]), (62, [0.0] * 6)]
    t = spark.createDataFrame(rows, "id long, vector array<double>")
    q = t.where("id % 7 = 0 or id > 59").selectExpr("id as query_id", "vector as query")
    for metric in ("cosine", "l2", "dot"):
        got = [{(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in vector_search.batch_search(t, q, 5, metric, block_queries=a, block_rows=b).collect()} for a, b in ((3, 7), (1000, 1000))]
        assert got[0] == got[1]
        for i, v in [r for r in rows if r[0] % 7 == 0 and r[1] is not None]:
            one = vector_search.flat_search(t, v, 5, metric, digits=6).collect()
            assert sorted((i, r["id"], round(r["score"], 6), n + 1) for n, r in enumerate(one)) == sorted(g for g in got[0] if g[0] == i)


def test_many_word_queries_at_once(spark, monkeypatch):
    d = spark.createDataFrame([(str(i), " ".join(f"w{i * j % 5}" for j in range(1 + i % 6))) for i in range(40)], "id string, text string")
    p, s = text_index.postings(d), text_index.corpus_stats(d)
    q = spark.createDataFrame([(1, "w0"), (1, "w3"), (1, "w3"), (2, "w2"), (3, "none"), (4, None)], "item long, term string")
    rows = lambda: sorted((r["item"], r["id"], round(r["score"], 9)) for r in text_search.batch_or_scores(p, s, q, "item").collect())
    wanted = sorted((i, r["id"], round(r["score"], 9)) for i, words in ((1, "w0 w3"), (2, "w2")) for r in text_search.or_scores(p, s, words).collect())
    assert rows() == wanted
    best = text_search.best_of_each(text_search.batch_or_scores(p, s, q, "item"), "item", "id", 2).collect()
    assert sorted((r["item"], r["id"], r["rank"]) for r in best) == sorted((i, x, n + 1) for i in (1, 2) for n, (_, x) in enumerate(sorted((-s, x) for j, x, s in wanted if j == i)[:2]))
    monkeypatch.setattr(text_search, "FEW_PAIRS", 1)
    assert rows() == wanted
