"""Incremental ingest by Structured Streaming: the same functions as in batch, on what is new."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import content_hash
from tidemark.operators.backfill import embed_rows
from tidemark.operators.chunking import chunk
from tidemark.operators.embedding import Embedder
from tidemark.operators.text_index import TextIndex
from tidemark.sources.store import Store, document_rows


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


#: State on the executors' disks, of which a batch saves the changes alone.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _started(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query with :data:`_STATE`. It has a copy of the session's settings, so the session keeps its own."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        return start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _name(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that has this checkpoint: the same after a restart, another one where the checkpoint was deleted."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def ingest(stream: DataFrame, store: Store, checkpoint: str, embedder: Embedder | None = None, table: str = "documents", id_col: str = "doc_id", text_col: str = "text", index: TextIndex | None = None) -> StreamingQuery:
    """Chunk what arrives, append the chunks whose ids are new as documents, and append the vectors of just that if there is an embedder: no batch rewrites
    a table. Ends when all that is there is done; a later call with the same checkpoint goes on from there. With ``index``, a batch is a segment of it, so its words are
    found when the batch is done.

    The ids that the stream has brought are its state, keyed by id, so a batch looks up its own ids and reads none of what earlier ones wrote. Parts of the table that
    others have written, or rewritten, are read for their ids as long as they are there. A batch notes its number in the state that its rows appear
    in: one that is replayed adds nothing, and embeds what the last attempt left without a vector.
    """
    spark, name = store.spark, []
    chunks = chunk(stream, id_col, text_col).dropDuplicates(["id"])

    def each(batch: DataFrame, number: int) -> None:
        if not name:
            name.append(_name(spark, checkpoint))
        store.overwrite(f"{table}_batch", document_rows(batch))
        arrived, replayed, others = store.read(f"{table}_batch"), store.last_batch(table, name[0]) >= number, store.read_others(table, name[0])
        if not replayed:
            store.append(table, arrived.join(others.select("id"), "id", "left_anti").select(*arrived.columns) if others is not None else arrived, name[0], number)
        if embedder is not None:
            store.ensure("embeddings")
            todo = arrived.select("id", "content", "content_hash")
            if replayed or others is not None:
                todo = todo.join(store.read("embeddings").where(F.col("embedder_id") == embedder.embedder_id).select("id"), "id", "left_anti")
            embed_rows(store, embedder, todo, table)
        if index is not None:
            index.append(arrived)  # a batch that is replayed takes its own place
            index.merge()

    return _started(spark, chunks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start)


def dedup_contents(stream: DataFrame, time_col: str, delay: str = "1 hour", text_col: str = "content") -> DataFrame:
    """Without contents seen within ``delay``; state is bounded by the watermark."""
    marked = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).withColumn("content_hash", content_hash(text_col))
    return marked.dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(events: DataFrame, time_col: str = "ts", key: str = "event_type", window: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Counts and sums per window and key; for streams and tables alike."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    timed = timed.withWatermark(time_col, delay) if events.isStreaming else timed
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    out = timed.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n", "total")


def session_counts(events: DataFrame, time_col: str = "ts", key: str = "user_id", gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Sessions per key: runs of events that are less than ``gap`` apart."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    timed = timed.withWatermark(time_col, delay) if events.isStreaming else timed
    out = timed.groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), key, "n")
