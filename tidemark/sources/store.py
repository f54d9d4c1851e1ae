"""A store of versioned Parquet tables.

Parquet has no updates: rows are written to new folders, and a state of the table (:mod:`tidemark.sources.versions`) that lists them makes them
visible, all at once. Appends add folders, whoever else writes. A rewrite takes the place of the folders that it has read, and keeps what was appended
meanwhile; if another rewrite came first, it conflicts. A table that is upserted is kept in buckets by a hash of its keys, and an upsert rewrites
those that it touches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.errors import EmbeddingError, SourceError
from tidemark.functions.text import content_hash
from tidemark.sources import versions


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key. An aggregate, not a window: it is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    return latest(old.unionByName(new), keys, order)


def merge_vectors(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Serving rows with the newest vector of their id; rows without one stay, vectors without a row are left out."""
    new = latest(embeddings.select("id", "vector", "embedded_at"), ["id"], "embedded_at").select("id", F.col("vector").alias("_v"))
    return documents.join(new, "id", "left").withColumn("vector", F.coalesce("_v", "vector")).drop("_v")


def unmatched(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Ids of vectors that no document has."""
    return embeddings.select("id").distinct().join(documents.select("id"), "id", "left_anti")


def document_rows(chunks: DataFrame, now: Column | None = None) -> DataFrame:
    """Chunks (with a vector or without) as rows of the documents table."""
    vector = F.col("vector").cast(schemas.VECTOR) if "vector" in chunks.columns else F.lit(None).cast(schemas.VECTOR)
    ready = vector.isNotNull()
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    return chunks.select(
        *(f.name for f in schemas.CHUNK), vector.alias("vector"), content_hash("content").alias("content_hash"), F.when(ready, "ready").otherwise("new").alias("embedding_status"),
        F.lit(None).cast("string").alias("embedding_error"), F.when(ready, 1).otherwise(0).alias("embedding_version"), F.when(ready, now).alias("embedded_at"),
        F.lit("stale").alias("index_status"), F.lit(0).alias("index_version"),
    )


class Store:
    SCHEMAS = {"documents": schemas.DOCUMENTS, "embeddings": schemas.EMBEDDINGS, "emb_cache": schemas.CACHE, "meta": schemas.META}
    #: Side tables are read by embedder: its folder is pruned.
    PARTITIONED = {"embeddings": ["embedder_id"], "emb_cache": ["embedder_id"]}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def state(self, name: str) -> versions.State | None:
        return versions.load(self.spark, f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self.state(name) is not None

    def ensure(self, name: str, schema: T.StructType | None = None) -> None:
        """Create a table without rows if there is none."""
        if not self.exists(name):
            self.overwrite(name, self.spark.createDataFrame([], schema or self.schema(name)))

    def schema(self, name: str) -> T.StructType:
        return self.SCHEMAS.get(name, schemas.DOCUMENTS)

    def read(self, name: str, state: versions.State | None = None) -> DataFrame:
        state = state or self.state(name)
        if state is None:
            raise SourceError(f"no table {name} in {self.path}")
        return self._rows(name, state.parts)

    def _rows(self, name: str, parts: list[versions.Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema(name))
        reader = self.spark.read.schema(self.SCHEMAS[name]) if name in self.SCHEMAS else self.spark.read
        paths = [f"{self.path}/{name}/{p['path']}" for p in parts]
        if name in self.PARTITIONED:
            return reader.option("basePath", f"{self.path}/{name}").parquet(*paths).select(*(f.name for f in self.SCHEMAS[name]))
        return reader.parquet(*paths)

    def _write(self, name: str, df: DataFrame, props: dict) -> list[versions.Part]:
        """Write rows to a folder of their own, that nothing lists yet."""
        # Folders of partitions are partitions of the table themselves.
        version = f"part={versions.new_name()}" if name in self.PARTITIONED else versions.new_name()
        home = f"{self.path}/{name}/{version}"
        if "buckets" not in props:
            df.write.partitionBy(*self.PARTITIONED.get(name, [])).parquet(home)
            return [{"path": version}]
        df.withColumn("_bucket", self._bucket(props)).repartition("_bucket").write.partitionBy("_bucket").parquet(home)
        fs, p = versions._fs(self.spark, home)
        found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return [{"path": f"{version}/{b}", "bucket": int(b.partition("=")[2])} for b in sorted(found) if b.startswith("_bucket=")]

    @staticmethod
    def _bucket(props: dict) -> Column:
        return F.pmod(F.xxhash64(*props["keys"]), F.lit(props["buckets"])).cast("int")

    def overwrite(self, name: str, df: DataFrame, base: versions.State | None = None) -> versions.State:
        """The rows of ``df``, which may read the table, take the place of those of ``base``, the state that it was read in (else the current one)."""
        base = base or self.state(name)
        return versions.change(self.spark, f"{self.path}/{name}", self._write(name, df, base.props if base else {}), base.parts if base else (), base=base)

    def update(self, name: str, rows: Callable[[DataFrame], DataFrame]) -> versions.State:
        """Rewrite the table as ``rows`` of it, and once more if another writer has rewritten it meanwhile."""

        def attempt() -> versions.State:
            base = self.state(name)
            return self.overwrite(name, rows(self.read(name, base)), base)

        return versions.retried(attempt)

    def append(self, name: str, df: DataFrame, stream: str | None = None, batch: int | None = None) -> DataFrame:
        """Add rows, and give them back as they were written. With ``stream``, they are the rows of its batch number ``batch``, which the table notes."""
        state = self.state(name)
        parts = [p | ({"stream": stream} if stream else {}) for p in self._write(name, df, state.props if state else {})]
        versions.change(self.spark, f"{self.path}/{name}", parts, props={f"stream:{stream}": batch} if stream else None)
        return self._rows(name, parts)

    def last_batch(self, name: str, stream: str) -> int:
        """The last batch of a stream that the table has, or -1. The number outlives rewrites of the table."""
        state = self.state(name)
        return state.props.get(f"stream:{stream}", -1) if state else -1

    def read_others(self, name: str, stream: str) -> DataFrame | None:
        """The rows that others than the stream have written or rewritten, or None where there are none."""
        state = self.state(name)
        parts = [p for p in state.parts if p.get("stream") != stream] if state else []
        return self._rows(name, parts) if parts else None

    def compact(self, name: str, most: int = 64) -> None:
        """Rewrite a table that consists of more than ``most`` folders (in buckets: a bucket that does)."""
        state = self.state(name)
        if state and len(state.parts) > most * state.props.get("buckets", 1):
            self.update(name, lambda rows: rows)

    def upsert(self, name: str, new: DataFrame, keys: list[str], order: str, buckets: int = 64) -> versions.State:
        """Of the rows with equal ``keys``, in the table and in ``new``, the one with the highest ``order`` stays.

        Rows are kept in ``buckets`` by a hash of their keys (the number is fixed when the table is first upserted), and the buckets that have keys of ``new`` are
        rewritten. Writers of different buckets don't conflict; of two that touch one bucket, the later one starts over.
        """
        folder, staged = f"{self.path}/{name}", f"{self.path}/{name}/{versions.new_name()}"
        new.write.parquet(staged)  # read twice, and again after a conflict
        rows = self.spark.read.schema(new.schema).parquet(staged)

        def attempt() -> versions.State:
            base = self.state(name)
            props = (base.props if base else {}) or {"buckets": buckets, "keys": keys}
            touched = {r["b"] for r in rows.select(self._bucket(props).alias("b")).distinct().collect()}  # a number for each bucket
            # Rows that were written before the table had buckets may be anywhere.
            hit = lambda p: p.get("bucket") is None or p["bucket"] in touched
            replaced = [p for p in (base.parts if base else []) if hit(p)]
            merged = upsert(self._rows(name, replaced), rows, keys, order) if replaced else latest(rows, keys, order)
            return versions.change(self.spark, folder, self._write(name, merged, props), replaced, props, base, hit)

        try:
            return versions.retried(attempt)
        finally:
            fs, p = versions._fs(self.spark, staged)
            fs.delete(p, True)

    def write_documents(self, name: str, chunks: DataFrame, dim: int | None = None) -> DataFrame:
        """Append chunks as documents, and give the rows back; a vector of another length than ``dim`` fails."""
        rows = document_rows(chunks)
        if dim is not None:
            bad = F.col("vector").isNotNull() & (F.size("vector") != dim)
            rows = rows.withColumn("vector", F.when(bad, F.raise_error(F.lit(f"a vector has not {dim} dimensions")).cast(schemas.VECTOR)).otherwise(F.col("vector")))
        return self.append(name, rows)

    def status(self, name: str) -> dict[str, int]:
        r = self.read(name).agg(F.count("*").alias("rows"), F.count("vector").alias("ready")).first()
        return {"rows": r["rows"], "ready": r["ready"]}

    # Cache
    def cache_get(self, embedder_id: str, wanted: DataFrame, dim: int) -> DataFrame:
        """content_hash, vector of the ``wanted`` hashes that are cached with the right length."""
        cached = self.read("emb_cache").where((F.col("embedder_id") == embedder_id) & (F.size("vector") == dim))
        return cached.join(wanted.select("content_hash").distinct(), "content_hash", "left_semi").groupBy("content_hash").agg(F.max_by("vector", "created_at").alias("vector"))

    def cache_put(self, embedder_id: str, rows: DataFrame) -> None:
        """Add (content_hash, vector), each hash once."""
        new = rows.select("content_hash", "vector").dropDuplicates(["content_hash"])
        self.append("emb_cache", new.select("content_hash", F.lit(embedder_id).alias("embedder_id"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"), "vector"))

    # Meta
    def set_meta(self, key: str, value: str) -> None:
        new = self.spark.createDataFrame([(key, value, dt.datetime.now(dt.UTC).replace(tzinfo=None))], schemas.META)
        self.upsert("meta", new, ["key"], "updated_at", buckets=1)

    def get_meta(self, key: str) -> str | None:
        if not self.exists("meta"):
            return None
        r = self.read("meta").where(F.col("key") == F.lit(key)).select("value").first()
        return r["value"] if r else None

    def activate_index(self, table: str, index_id: str) -> None:
        self.set_meta(f"active_index_id:{table}", index_id)

    def active_index(self, table: str) -> str | None:
        return self.get_meta(f"active_index_id:{table}")


def check_dim(dim: int, vectors: list[list[float]]) -> None:
    if any(len(v) != dim for v in vectors):
        raise EmbeddingError(f"vectors must have {dim} dimensions")
