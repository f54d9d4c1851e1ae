"""Commands: ingest, query, index, search-text, search-vector, extract, chunk, embed, load, pipeline, status."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.text import extension, file_name, token_estimate
from tidemark.functions.tokens import bpe_token_count
from tidemark.operators import chunking, cleaning, text_search, vector_search
from tidemark.operators.backfill import backfill, sync_serving
from tidemark.operators.embedding import default_embedder, embed_column
from tidemark.operators.hybrid import HybridEngine
from tidemark.operators.text_index import TextIndex
from tidemark.sources import export, files
from tidemark.sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description="Hybrid document search and document processing")
    p.add_argument("--config", default=".", help="folder of the settings")
    p.add_argument("--env")
    p.add_argument("--verbose", action="store_true", help="log what Spark does, and how long a command took")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, **options) -> None:
        c = sub.add_parser(name, **options)
        for a, kw in args:
            c.add_argument(*([a] if isinstance(a, str) else a), **kw)

    data = ("dir", {"nargs": "?"})
    limit = (("-k", "--limit"), {"type": int})
    formats = ("--formats", {"nargs": "*", "default": ["pdf", "docx", "jpg", "png"]})
    dry = ("--dry-run", {"action": "store_true"})
    command("ingest", data, help="chunk, embed and index a folder of text files")
    command("index", data, ("--skip-text", {"action": "store_true"}), ("--limit-files", {"type": int}), ("--limit-vectors", {"type": int}), help="the same with parts left out")
    command("build-index", help="an index of the vectors, which searches use from then on")
    command("query", ("text", {}), limit, help="hybrid search")
    fuzzy = ("--fuzzy", {"action": "store_true", "help": "unknown words stand for near ones"})
    command("search-text", ("text", {}), limit, fuzzy, ("--facets", {"action": "store_true"}), help="boosted keyword search with snippets")
    command("search-vector", ("text", {}), limit, help="vector search, reranked by words")
    command("backfill", ("--limit", {"type": int}), help="embed documents without a vector")
    command("status", help="counts of rows and vectors")
    options = (("--backend", {"help": "a PDF library"}), ("--strategy", {"default": "auto"}), ("--languages", {"nargs": "*", "default": ["eng"]}))
    command("extract", ("input", {}), ("output", {}), formats, *options)
    command("chunk", ("input", {}), ("output", {}), ("--size", {"type": int, "default": 1000}), ("--overlap", {"type": int, "default": 200}), ("--tokenizer", {"help": "a vocabulary file, for exact counts"}))
    command("embed", ("input", {}), ("output", {}))
    command("load", ("input", {}), ("output", {}), ("--kind", {"choices": ["text", "vector"], "default": "text"}))
    command("pipeline", ("input", {}), ("output", {}), formats)
    command("texts", data, ("output", {"nargs": "?"}), dry, help="cleaned text files from a folder of documents")
    return p


def extract_stage(spark: SparkSession, source: str, formats: list[str], backend: str | None = None, strategy: str = "auto", languages: list[str] | tuple[str, ...] = ("eng",)) -> DataFrame:
    return files.extract_directory(spark, source, tuple(formats), files.extractors_for(backend, strategy, tuple(languages)))


def chunk_stage(extracted: DataFrame, size: int = 1000, overlap: int = 200, tokenizer: str | None = None) -> DataFrame:
    """Chunks with their number of tokens: exact with a vocabulary, else estimated from words."""
    rows = extracted.where(F.col("metadata.error").isNull()).select(F.col("metadata.file_name").alias("file_name"), "content")
    count = bpe_token_count("content", tokenizer) if tokenizer else token_estimate("content")
    return chunking.recursive_chunks(rows, size, overlap).withColumn("token_count", count)


def embed_stage(chunks: DataFrame, embedder) -> DataFrame:
    e = chunks.withColumn("_e", embed_column(embedder, F.col("content")))
    return e.withColumns({"embedding": F.col("_e.vector"), "embedding_model": F.lit(embedder.embedder_id), "embedding_dimension": F.size("_e.vector")}).drop("_e")


def clean_files(spark: SparkSession, source: str, conf: cleaning.Cleaning, formats: tuple[str, ...] = files.DEFAULT_FORMATS) -> DataFrame:
    """path, content of the files whose text is long enough, cleaned."""
    raw = extract_stage(spark, source, list(formats)).select(F.col("metadata.file_path").alias("path"), "content")
    return cleaning.long_texts(raw, "content", conf).select("path", cleaning.clean_text("content", extension(file_name("path")), conf).alias("content"))


def _show(df: DataFrame) -> None:
    for i, r in enumerate(df.collect(), 1):
        print(i, *(f"{v:.4f}" if isinstance(v, float) else str(v).replace("\n", " ")[:160] for v in r), sep="\t")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    conf = Config.load(a.config, a.env)
    conf.validate()
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    embedder = default_embedder(conf.get("vector.dim"))
    text, store = TextIndex(spark, conf.path("data.index_dir", a.config)), Store(spark, conf.path("data.db_dir", a.config))
    k = conf.limit(getattr(a, "limit", None))
    engine = HybridEngine(text, store, embedder, fusion=conf.get("search.fusion"), metric=conf.get("search.metric"), nprobes=conf.get("vector.nprobes"), refine_factor=conf.get("vector.refine_factor"))
    began = time.perf_counter()
    if a.verbose:
        spark.sparkContext.setLogLevel("INFO")
    folder = getattr(a, "dir", None) or conf.path("data.txt_dir", a.config)
    chunks = lambda n=None: files.process_directory(spark, folder, n, max_tokens=conf.get("chunking.max_tokens"), overlap=conf.get("chunking.overlap_percent"))
    if a.command == "ingest":
        engine.index(chunks())
    elif a.command == "index":
        store.write_documents("documents", chunks(a.limit_files))
        backfill(store, embedder, limit=a.limit_vectors)
        if not a.skip_text:
            text.write(store.read("documents"))
    elif a.command == "query":
        _show(engine.query(a.text, k))
    elif a.command == "build-index":
        print(engine.build_vectors(conf.get("vector.num_partitions"), conf.get("vector.num_sub_vectors")))
    elif a.command == "search-text":
        _show(text_search.search(text, a.text, k, edits=conf.get("search.fuzzy_max_distance") if a.fuzzy else 0))
        if a.facets:
            _show(text_search.facet_counts(text.stored, text_search.or_scores(text.postings, text.numbers, a.text)))
    elif a.command == "search-vector":
        _show(vector_search.text_search(store.read("documents"), a.text, embedder.embed_one, k))
    elif a.command == "backfill":
        print(backfill(store, embedder, limit=a.limit), sync_serving(store, embedder.embedder_id))
    elif a.command == "status":
        print(store.status("documents"))
    elif a.command == "extract":
        export.write_stage(extract_stage(spark, a.input, a.formats, a.backend, a.strategy, a.languages), a.output, "parquet")
    elif a.command == "chunk":
        export.write_stage(chunk_stage(spark.read.parquet(a.input), a.size, a.overlap, a.tokenizer), a.output)
    elif a.command == "embed":
        export.write_stage(embed_stage(spark.read.parquet(a.input), embedder), a.output)
    elif a.command == "load":
        rows = spark.read.parquet(a.input)
        export.write_json(export.text_export(rows) if a.kind == "text" else export.vector_export(rows), a.output)
    elif a.command == "pipeline":
        extracted = export.write_stage(extract_stage(spark, a.input, a.formats), f"{a.output}/extracted")
        cut = export.write_stage(chunk_stage(extracted), f"{a.output}/chunks")
        made = export.write_stage(embed_stage(cut, embedder), f"{a.output}/embedded")
        export.write_json(export.text_export(made), f"{a.output}/text")
        export.write_json(export.vector_export(made), f"{a.output}/vector")
    elif a.command == "texts":
        raw = getattr(a, "dir", None) or conf.path("data.raw_dir", a.config)
        found = files.find_supported(spark, raw)
        _show(files.ext_distribution(found))
        if not a.dry_run:
            names = ("english_only", "lowercase", "min_text_length", "min_line_length", "max_line_length")
            cleaned = clean_files(spark, raw, cleaning.Cleaning(**{n: conf.get(f"text_cleaning.{n}") for n in names}))
            out = a.output or conf.path("data.txt_dir", a.config)
            export.write_text_tree(cleaned.select(export.output_path(F.col("path"), raw, out).alias("path"), "content"), "path")
    if a.verbose:
        print(f"{a.command}: {time.perf_counter() - began:.1f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
