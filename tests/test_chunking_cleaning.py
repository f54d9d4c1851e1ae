import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunking, cleaning


def chunks(spark, text):
    rows = chunking.chunk(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("chunk_index").collect()
    assert [r["id"] for r in rows] == [f"d:{i}" for i in range(len(rows))] and all(r["total_chunks"] == len(rows) for r in rows)
    return [r["content"] for r in rows]


def test_paragraphs(spark):
    assert chunks(spark, "A b\n\n  \n\nC  d\n\n\nE") == ["A b", "C  d", "E"]
    assert chunks(spark, "Short text\n") == ["Short text"]
    assert chunks(spark, "") == []


@pytest.mark.parametrize(("n", "windows"), [(375, [(0, 375)]), (376, [(0, 300), (240, 376)]), (540, [(0, 300), (240, 540)]), (541, [(0, 300), (240, 540), (480, 541)]), (781, [(0, 300), (240, 540), (480, 780), (720, 781)])])
def test_windows(spark, n, windows):
    w = [f"w{i}" for i in range(n)]
    assert chunks(spark, " ".join(w)) == [" ".join(w[a:b]) for a, b in windows]


def test_recursive_splitter():
    text = "\n\n".join(" ".join(f"word{i}{j}" for j in range(60)) for i in range(6))
    parts = chunking.split_recursive(text, 300, 60)
    assert all(len(p) <= 300 for p in parts) and {w for p in parts for w in p.split()} == set(text.split())
    assert chunking.split_recursive("", 10, 2) == [] and chunking.split_recursive("abc", 10, 2) == ["abc"]
    assert chunking.split_recursive("x" * 25, 10, 2) and all(len(p) <= 10 for p in chunking.split_recursive("x" * 25, 10, 2))


def test_long_lines():
    assert cleaning.split_long_line("short", 10) == ["short"]
    assert cleaning.split_long_line("One two. Three four. Five.", 12) == ["One two.", "Three four.", "Five."]
    assert cleaning.split_long_line("a very long sentence. b", 5)[0] == "a very long sentence."
    assert cleaning.split_long_line("aa bb cc dd", 5) == ["aa bb", "cc dd"]


def test_paragraph_rebuilding():
    assert cleaning.rebuild_paragraphs([]) == ""
    assert cleaning.rebuild_paragraphs(["a" * 25 + "  " + "b" * 25 + "  c"]) == "a" * 25 + "\n\n" + "b" * 25
    long = ["word " * 200]
    assert [len(p.split()) for p in cleaning.rebuild_paragraphs(long).split("\n\n")] == [150, 50]


def test_clean_text(spark):
    text = "A first line that is long enough to stay here.\n!!! --- ###\nshort\nThe second line stays as well, it is quite long."
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [r["y"] for r in df.select(cleaning.clean_text("t", F.lit("txt")).alias("y")).collect()]
    assert "first line" in got[0] and got[1] == "" and got[2] == ""
    assert cleaning.long_texts(df.withColumnRenamed("t", "text")).count() == 1


def test_chunks_and_vectors_of_more_texts_than_a_worker_holds(spark, monkeypatch):
    from tidemark.operators import embedding

    texts = [None if i % 50 == 7 else f"word{i} " * (i % 9) for i in range(300)]
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file_name string, content string").coalesce(1)
    monkeypatch.setattr(chunking, "AT_ONCE", 7)
    got = sorted((r["chunk_id"], r["content"]) for r in chunking.recursive_chunks(d, 20, 4).collect())
    assert got == sorted((f"{i}_{n}", c) for i, t in enumerate(texts) for n, c in enumerate(chunking.split_recursive(t or "", 20, 4)))
    vectors = {r["file_name"]: list(r["e"]["vector"]) for r in d.select("file_name", embedding.embed_column(embedding.HashingEmbedder(8), "content", 16).alias("e")).collect()}
    assert all(vectors[str(i)] == [float(v) for v in embedding.HashingEmbedder(8).embed_batch([t or ""])[0]] for i, t in enumerate(texts))
