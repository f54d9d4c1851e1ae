"""Files out."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _meta(df: DataFrame, name: str, default) -> Column:
    fields = {f.name for f in df.schema["metadata"].dataType.fields} if "metadata" in df.columns else set()
    value = F.col(f"metadata.{name}") if name in fields else F.col(name) if name in df.columns else F.lit(None)
    return F.coalesce(value, F.lit(default)).alias(name)


def _export(chunks: DataFrame) -> list[Column]:
    tokens = F.col("token_count") if "token_count" in chunks.columns else F.lit(None)
    named = [_meta(chunks, n, d) for n, d in (("file_name", ""), ("file_path", ""), ("chunk_index", 0), ("total_chunks", 1))]
    return [F.col("chunk_id").alias("id"), F.col("content"), *named, F.coalesce(tokens, F.lit(0)).cast("int").alias("token_count")]


def text_export(chunks: DataFrame) -> DataFrame:
    """The columns that a keyword index takes."""
    return chunks.select(*_export(chunks))


def vector_export(chunks: DataFrame) -> DataFrame:
    """The same with vectors; a chunk without one has an empty vector."""
    own = lambda n, t, d: F.coalesce((F.col(n) if n in chunks.columns else F.lit(None)).cast(t), d).alias(n)
    vector = own("embedding", "array<float>", F.array().cast("array<float>"))
    return chunks.select(*_export(chunks), vector, own("embedding_model", "string", F.lit("")), own("embedding_dimension", "int", F.lit(0)))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """One stage's table, read back, so that the next stage does not compute it again."""
    df.write.mode("overwrite").format(fmt).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def output_path(path: Column, raw_root: str, out_root: str) -> Column:
    """The place of a document's text: the tree below ``raw_root``, with ``.txt`` for its suffix."""
    from tidemark.sources.files import _below

    return F.concat(F.lit(out_root.rstrip("/") + "/"), F.regexp_replace(_below(path, raw_root), r"\.[^./]*$", ""), F.lit(".txt"))


def _write_files(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    from tidemark.sources.files import opened

    made = set()
    for batch in batches:
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            system, path = opened(path if ":/" in path else default + path)
            folder = path.rsplit("/", 1)[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(path, compression=None) as out:
                out.write(text.as_buffer() or b"")
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])


def write_text_tree(docs: DataFrame, path_col: str, text_col: str = "content") -> None:
    """One file per row at its path. A path without a scheme belongs to the cluster's default file system; executors open it by Arrow."""
    sc = docs.sparkSession.sparkContext
    default = sc._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(sc._jsc.hadoopConfiguration()).toString().rstrip("/")
    docs.select(path_col, text_col).mapInArrow(partial(_write_files, default=default), "n long").write.format("noop").mode("overwrite").save()
