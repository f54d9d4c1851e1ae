import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.cli import main
from tidemark.config import Config
from tidemark.errors import ConfigError, EmbeddingError, ExtractorUnavailable, SourceError
from tidemark.functions.tokens import bpe_token_count, counter
from tidemark.operators.backfill import backfill, derived_status, sync_serving
from tidemark.operators.embedding import Embedder, HashingEmbedder, ModelEmbedder, SentenceEmbedder
from tidemark.sources import export, files
from tidemark.sources.store import Store, merge_vectors, unmatched
from tidemark.streaming import ingest


def chunk_rows(spark, n):
    return spark.createDataFrame([(f"d{i}:0", f"d{i}", f"/p/{i}", "/test", "/test", f"hello world {i % 4}", 0, 1) for i in range(n)], schemas.CHUNK)


def test_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    with pytest.raises(SourceError):
        s.read("documents")
    s.ensure("documents")
    assert s.read("documents").count() == 0
    s.write_documents("documents", chunk_rows(spark, 3))
    assert s.status("documents") == {"rows": 3, "ready": 0}
    s.overwrite("documents", s.read("documents").where("doc_id = 'd1'"))
    assert s.status("documents")["rows"] == 1
    s.set_meta("k", "it's")
    s.set_meta("k", "new")
    s.activate_index("documents", "i1")
    assert s.get_meta("k") == "new" and s.get_meta("none") is None and s.active_index("documents") == "i1"


def test_backfill(spark, tmp_path):
    s, e = Store(spark, str(tmp_path)), HashingEmbedder(16)
    s.write_documents("documents", chunk_rows(spark, 5))
    status = F.when(F.col("id") == "d3:0", "ready").when(F.col("id") == "d2:0", "error").when(F.col("id") == "d4:0", "in_progress").otherwise("new")
    s.overwrite("documents", s.read("documents").withColumn("embedding_status", status))
    s.ensure("emb_cache")
    known = s.read("documents").where("id = 'd0:0'").select("content_hash", F.array(*[F.lit(0.25).cast("float")] * 16).alias("vector"))
    s.cache_put(e.embedder_id, known)
    got = backfill(s, e)
    assert (got.selected, got.failed) == (4, 0) and got.embedded == 2  # d0 and d4 share a cached content
    rows = {r["id"]: r for r in s.read("documents").collect()}
    assert all(r["embedding_status"] == "ready" for r in rows.values()) and rows["d1:0"]["embedding_version"] == 1 and rows["d3:0"]["embedding_version"] == 0
    assert s.read("embeddings").count() == 4 and s.read("emb_cache").count() == 3
    assert backfill(s, e).selected == 0
    assert sync_serving(s, e.embedder_id) == (4, 0)


class Picky(Embedder):
    dim, kind = 4, "picky"

    def embed_batch(self, texts):
        if any("3" in t for t in texts):
            raise ValueError("no threes")
        return [[1.0, 0.0, 0.0, 0.0] for _ in texts]


def test_errors_concern_their_row(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write_documents("documents", chunk_rows(spark, 8))
    got = backfill(s, Picky())
    assert (got.embedded, got.failed) == (3, 1)
    bad = s.read("documents").where("embedding_status = 'error'").collect()
    assert {r["doc_id"] for r in bad} == {"d3", "d7"} and all("no threes" in r["embedding_error"] for r in bad)
    assert backfill(s, Picky(), limit=1).selected == 1


def test_merge(spark):
    d = spark.createDataFrame([("a", None), ("b", [9.0])], "id string, vector array<float>")
    at = lambda h: dt.datetime(2024, 1, 1, h)
    e = spark.createDataFrame([("a", [1.0], at(1)), ("a", [2.0], at(2)), ("z", [3.0], at(1))], "id string, vector array<float>, embedded_at timestamp_ntz")
    assert {r["id"]: list(r["vector"]) for r in merge_vectors(d, e).collect()} == {"a": [2.0], "b": [9.0]}
    assert [r["id"] for r in unmatched(d, e).collect()] == ["z"]


def test_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("alpha bravo")
    (tmp_path / "in/sub/b.txt").write_text("charlie delta\n\necho")
    (tmp_path / "in/sub/bad.txt").write_bytes(b"x \xff y")
    (tmp_path / "in/c.html").write_text("<h1>T</h1><script>no</script><p>one &amp; two</p>")
    (tmp_path / "in/d.md").write_text("# Head\nbody **bold**")
    (tmp_path / "in/e.pdf").write_bytes(b"%PDF")
    (tmp_path / "in/m.eml").write_text("Subject: hi\nContent-Type: text/plain\n\nbody")
    root = str(tmp_path / "in")
    chunks = files.process_directory(spark, root)
    assert {(r["id"], r["category"]) for r in chunks.collect()} == {("a:0", "/misc"), ("sub/b:0", "/sub"), ("sub/b:1", "/sub"), ("sub/bad:0", "/sub")}
    assert files.process_directory(spark, root, limit=1).select("doc_id").distinct().count() == 1
    assert {r["id"] for r in files.file_documents(spark, root).collect()} == {"a.txt", "sub/b.txt"}
    assert {r["category"] for r in files.file_documents(spark, root, "path2").collect()} == {"/a.txt", "/sub/b.txt"}
    out = {r["metadata"]["file_name"]: r for r in files.extract_directory(spark, root, (*files.DEFAULT_FORMATS, "eml")).collect()}
    assert out["c.html"]["content"] == "T\n\none & two" and out["d.md"]["content"] == "Head\n\nbody bold" and out["m.eml"]["content"] == "hi\n\nbody"
    assert out["e.pdf"]["metadata"]["error"] and out["e.pdf"]["content"] == "" and out["e.pdf"]["metadata"]["elements"] is None
    assert {r["ext"]: r["n"] for r in files.ext_distribution(files.find_supported(spark, root)).collect()} == {"html": 1, "md": 1, "pdf": 1, "txt": 3}
    counts = files.extraction_counts(files.extract_directory(spark, root)).first()
    assert (counts["processed"], counts["errors"]) == (5, 1)
    tree = spark.createDataFrame([(f"{root}/sub/b.txt", "hey")], "path string, content string")
    export.write_text_tree(tree.select(export.output_path(F.col("path"), root, str(tmp_path / "out")).alias("path"), "content"), "path")
    assert (tmp_path / "out/sub/b.txt").read_text() == "hey"


def test_office_formats_and_options(spark, tmp_path):
    import io
    import zipfile

    def zipped(**names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, text in names.items():
                z.writestr(n.replace("__", "/").replace("_", "."), text)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:br w:type='page'/><w:t>Some </w:t><w:t>text</w:t></w:r></w:p>"
    docx = zipped(word__document_xml=f"<w:document {w}><w:body>{body}</w:body></w:document>")
    assert files.extract_bytes(docx, "docx") == ("Title\n\nSome text", [("Title", "Title"), ("PageBreak", ""), ("NarrativeText", "Some text")])
    epub = zipped(a_xhtml="<h1>One</h1><p>first</p>", b_xhtml="<p>second</p>", mimetype="application/epub+zip")
    assert files.extract_bytes(epub, "epub")[0] == "One\n\nfirst\n\nsecond"
    rtf = rb"{\rtf1{\fonttbl{\f0 Arial;}}\pard Caf\'e9 au lait\par Second {\b bold}\par}"
    assert files.extract_bytes(rtf, "rtf")[0] == "Caf\u00e9 au lait\n\nSecond bold"
    for ext, options in (("pdf", {"backend": "none"}), ("pdf", {"strategy": "hi_res"}), ("msg", {})):
        with pytest.raises(ExtractorUnavailable):
            files.extract_bytes(b"x", ext, files.extractors_for(**options))
    seen = []
    files.PDF_BACKENDS["own"] = lambda data: seen.append(data) or ["page one", "page two"]
    try:
        assert files.extract_bytes(b"%PDF", "pdf", files.extractors_for(backend="own")) == ("page onepage two", [("NarrativeText", "page one"), ("PageBreak", ""), ("NarrativeText", "page two")])
    finally:
        del files.PDF_BACKENDS["own"]
    assert seen == [b"%PDF"]


def test_model_embedders(tmp_path, monkeypatch):
    """With stand-ins for the libraries: what our side of them does."""
    import sys
    import types

    import numpy as np
    import onnxruntime
    import tokenizers

    class Session:
        def __init__(self, path):
            assert path.endswith("model.onnx")

        def run(self, _, feed):
            assert feed["input_ids"].shape == (2, 4) and feed["attention_mask"].tolist() == [[1, 1, 0, 0], [1, 1, 1, 1]]
            return [np.stack([feed["input_ids"], 2 * feed["input_ids"]], 2).astype(float)]

    class Words:
        @staticmethod
        def from_file(path):
            return types.SimpleNamespace(encode=lambda t: types.SimpleNamespace(ids=[len(x) for x in t.split()]))

    (tmp_path / "model.onnx").write_bytes(b"")
    monkeypatch.setattr(onnxruntime, "InferenceSession", Session)
    monkeypatch.setattr(tokenizers, "Tokenizer", Words)
    got = ModelEmbedder(str(tmp_path), 2, 4).embed_batch(["a bb", "a b c d e"])
    assert np.allclose(got, [[1 / 5**0.5, 2 / 5**0.5]] * 2)
    with pytest.raises(EmbeddingError):
        ModelEmbedder(str(tmp_path / "none")).embed_batch(["x"])
    with pytest.raises(EmbeddingError):
        SentenceEmbedder("any").embed_batch(["x"])
    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=lambda name: types.SimpleNamespace(encode=lambda ts: [[float(len(t))] * 2 for t in ts])))
    assert [list(v) for v in SentenceEmbedder("any", 2).embed_batch(["abc", "", "x"])] == [[3.0, 3.0], [], [1.0, 1.0]]


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["", None, "some words here", "<|endoftext|>", "漢字 🙂"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    wanted = [len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        got = d.select("i", bpe_token_count("t", public_tokenizers.path(name)).alias("n")).orderBy("i").collect()
        assert [r["n"] for r in got] == wanted
    with pytest.raises(SourceError):
        counter("x.txt")


def test_exports(spark, tmp_path):
    c = spark.createDataFrame([("f_0", "x", {"file_name": "f"})], "chunk_id string, content string, metadata struct<file_name:string>")
    assert export.text_export(c).first().asDict() == {"id": "f_0", "content": "x", "file_name": "f", "file_path": "", "chunk_index": 0, "total_chunks": 1, "token_count": 0}
    assert export.vector_export(c).first()["embedding_dimension"] == 0
    export.write_json(export.text_export(c), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_streaming(spark, tmp_path):
    src, s = tmp_path / "src", Store(spark, str(tmp_path / "db"))
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id string, text string")
    rows("a", "b").write.parquet(str(src))
    run = lambda: ingest.ingest(ingest.read_stream(spark, str(src), rows("a").schema), s, str(tmp_path / "cp"), HashingEmbedder(8)).awaitTermination()
    run()
    ready = lambda: {r["status"]: r["n"] for r in derived_status(s.read("documents"), s.read("embeddings"), "local:fake:d8").groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert ready() == {"ready": 2} and s.status("documents") == {"rows": 2, "ready": 0}
    parts = s.state("documents").parts
    rows("b", "c").write.mode("append").parquet(str(src))
    run()
    assert ready() == {"ready": 3} and s.state("documents").parts[: len(parts)] == parts  # appended, not rewritten
    assert backfill(s, HashingEmbedder(8), settled=False).selected == 0
    assert sync_serving(s, "local:fake:d8") == (3, 0) and s.status("documents") == {"rows": 3, "ready": 3}


def test_config_and_cli(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "config.toml").write_text("[search]\ndefault_limit = 3\n[vector]\ndim = 64\n")
    (tmp_path / "config.test.toml").write_text("[search]\nmax_limit = 4\n")
    c = Config.load(str(tmp_path), "test", {"APP_VECTOR__NPROBES": "2", "ETL_RAW_DIR": "/r"})
    assert (c.limit(), c.limit(50), c.get("vector.nprobes"), c.get("data.raw_dir"), c.get("no.such", 1)) == (3, 4, 2, "/r", 1)
    c.validate()
    with pytest.raises(ConfigError):
        Config.load(str(tmp_path), "prod", {}).validate()
    monkeypatch.setenv("APP_USE_FAKE_EMBEDDINGS", "1")
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt/fire.txt").write_text("how to make a fire with wood")
    (tmp_path / "txt/water.txt").write_text("finding water in dry land")
    base = ["--config", str(tmp_path)]
    main([*base, "ingest", str(tmp_path / "txt")], spark)
    main([*base, "query", "fire wood"], spark)
    assert capsys.readouterr().out.split("\t")[1] == "fire:0"
    main([*base, "search-text", "water", "--facets"], spark)
    assert "<b>water</b>" in capsys.readouterr().out
    main([*base, "search-vector", "water"], spark)
    assert capsys.readouterr().out.split("\t")[2] == "water:0"
    main([*base, "build-index"], spark)
    capsys.readouterr()
    main([*base, "--verbose", "query", "fire wood"], spark)
    spark.sparkContext.setLogLevel("ERROR")
    shown = capsys.readouterr()
    assert shown.out.split("\t")[1] == "fire:0" and "query:" in shown.err
    main([*base, "search-text", "watr", "--fuzzy"], spark)
    assert "<b>water</b>" in capsys.readouterr().out
    main([*base, "status"], spark)
    assert "'rows': 2" in capsys.readouterr().out


def test_small_files_share_tasks(spark, tmp_path):
    """Hundreds of small files are read by a few tasks, whole; a listing reads no contents."""
    for i in range(600):
        (tmp_path / f"d{i % 7}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 7}/{i}.txt").write_text(f"text {i}")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a part for each file
    try:
        found = files.file_documents(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() <= max(4 * spark.sparkContext.defaultParallelism, 600 // 32)
        assert {(r["id"], r["content"]) for r in found.collect()} == {(f"d{i % 7}/{i}.txt", f"text {i}") for i in range(600)}
        listed = files.list_text_files(spark, str(tmp_path))
        assert listed.count() == 600 and "content#" not in listed._jdf.queryExecution().executedPlan().toString().split("FileScan")[-1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_files_that_are_empty_or_hidden(spark, tmp_path):
    """A file without bytes is a file, and so is one whose name begins with a point or an underscore."""
    (tmp_path / "in/.d/e/f").mkdir(parents=True)
    wanted = {"a.txt": "one", "none.txt": "", ".h.txt": "two", ".d/_u.txt": "three", ".d/e/f/deep.txt": "four"}
    for name, text in wanted.items():
        (tmp_path / "in" / name).write_text(text)
    (tmp_path / "in/.txt").write_text("no name")
    (tmp_path / "in/x.txt.gz").write_text("no text")
    root = str(tmp_path / "in")
    assert {r["id"]: r["content"] for r in files.file_documents(spark, root).collect()} == wanted
    assert [(r["path"], r["length"]) for r in files.list_text_files(spark, root).collect()] == [(f"file:{root}/{n}", len(wanted[n])) for n in sorted(wanted)]
    assert files.find_supported(spark, root).count() == 5
    assert [r["content"] for r in files.file_documents(spark, f"{root}/a.txt").collect()] == ["one"]
    # A pattern is left to Spark's reader.
    assert files.list_text_files(spark, f"{root}/a*").count() == 1


def test_executors_list_files(spark, tmp_path):
    """No plan has names of files in it, and a text is cut into chunks once."""
    for i in range(30):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}/{i}.txt").write_text("a b\n\nc")
    chunks = files.process_directory(spark, str(tmp_path))
    for found in (chunks, files.list_text_files(spark, str(tmp_path)), files.find_supported(spark, str(tmp_path))):
        assert not found.inputFiles()
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("flatten(") == 1
    assert chunks.count() == 60 and {r["total_chunks"] for r in chunks.collect()} == {2}
