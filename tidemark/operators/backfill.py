"""Resumable embedding of documents that have no vector yet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.embedding import Embedder, embed_column
from tidemark.sources.store import Store, merge_vectors, unmatched


@dataclass(frozen=True)
class Outcome:
    selected: int
    embedded: int
    failed: int


def pending(documents: DataFrame) -> DataFrame:
    """Rows whose status isn't ready; a missing status isn't."""
    return documents.where(~F.col("embedding_status").eqNullSafe("ready"))


def derived_status(documents: DataFrame, embeddings: DataFrame, embedder_id: str) -> DataFrame:
    """id, status from what is there rather than from a mutable column."""
    done = embeddings.where(F.col("embedder_id") == embedder_id).select("id").distinct().withColumn("done", F.lit(True))
    return documents.select("id").join(done, "id", "left").select("id", F.when(F.col("done"), "ready").otherwise("new").alias("status"))


def settle(documents: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Documents with the results (id, vector, error) of one run."""
    r = results.select("id", F.col("vector").alias("_v"), F.col("error").alias("_e"), F.lit(True).alias("_done"))
    hit, ok = F.coalesce("_done", F.lit(False)), F.coalesce(F.col("_done") & F.col("_e").isNull(), F.lit(False))
    out = documents.join(r, "id", "left").withColumns({
        "embedding_status": F.when(ok, "ready").when(hit, "error").otherwise(F.col("embedding_status")),
        "embedding_error": F.when(ok, F.lit(None)).when(hit, F.col("_e")).otherwise(F.col("embedding_error")),
        "embedding_version": F.when(ok, F.col("embedding_version") + 1).otherwise(F.col("embedding_version")),
        "embedded_at": F.when(ok, now).otherwise(F.col("embedded_at")),
        "vector": F.when(ok, F.col("_v")).otherwise(F.col("vector")),
    })
    return out.select(*documents.columns)


def backfill(store: Store, embedder: Embedder, table: str = "documents", limit: int | None = None, settled: bool = True) -> Outcome:
    """Embed what is pending: cached contents are reused, each new content is embedded once, and everything is written as set operations.

    Vectors and cache entries are appended. With ``settled``, the status columns of the documents are brought up to date, which
    rewrites that table; without, nothing is rewritten, what is pending follows from the vectors that are there (:func:`derived_status`), and
    :func:`sync_serving` brings them into the table when it suits.

    Idempotent: a run that dies before the last step leaves rows pending, and the cache keeps what was embedded.
    """
    for name in ("embeddings", "emb_cache"):
        store.ensure(name)
    documents = store.read(table)
    if settled:
        todo = pending(documents)
    else:
        done = store.read("embeddings").where(F.col("embedder_id") == embedder.embedder_id)
        todo = documents.join(done.select("id"), "id", "left_anti")
    todo = todo.select("id", "content", "content_hash")
    return embed_rows(store, embedder, todo.orderBy("id").limit(limit) if limit is not None else todo, table, settled)


def embed_rows(store: Store, embedder: Embedder, todo: DataFrame, table: str = "documents", settled: bool = False) -> Outcome:
    """Embed the rows of ``todo`` (id, content, content_hash) through the cache and append their vectors."""
    for name in ("embeddings", "emb_cache"):
        store.ensure(name)
    store.overwrite(f"{table}_todo", todo)
    todo = store.read(f"{table}_todo")
    selected = todo.count()
    if not selected:
        return Outcome(0, 0, 0)
    cached = store.cache_get(embedder.embedder_id, todo, embedder.dim)
    missing = todo.join(cached.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
    store.overwrite(f"{table}_made", missing.select("content_hash", embed_column(embedder, F.col("content")).alias("e")).select("content_hash", "e.vector", "e.error"))
    made = store.read(f"{table}_made")
    counts = made.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count("error").alias("bad")).first()
    now = F.current_timestamp().cast("timestamp_ntz")
    by_hash = cached.select("content_hash", "vector", F.lit(None).cast("string").alias("error")).unionByName(made)
    store.overwrite(f"{table}_run", todo.join(by_hash, "content_hash").select("id", "content_hash", "vector", "error"))
    results = store.read(f"{table}_run")
    store.cache_put(embedder.embedder_id, made.where("error is null"))
    store.append("embeddings", results.where("error is null").select("id", F.lit(embedder.embedder_id).alias("embedder_id"), "content_hash", now.alias("embedded_at"), "vector"))
    if settled:
        store.update(table, lambda documents: settle(documents, results, now))
    return Outcome(selected, counts["ok"], counts["bad"])


def sync_serving(store: Store, embedder_id: str, table: str = "documents") -> tuple[int, int]:
    """Bring the newest vectors of an embedder into the serving table: rows with a vector, vectors without a row."""
    vectors = store.read("embeddings").where(F.col("embedder_id") == embedder_id)
    left = unmatched(store.read(table), vectors).count()
    store.update(table, lambda documents: merge_vectors(documents, vectors))
    return store.status(table)["ready"], left


