"""Fusion of keyword and vector hits."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ann, text_search, vector_search
from tidemark.operators.text_index import TextIndex


class SearchEngine(Protocol):
    def index(self, chunks: DataFrame) -> None: ...

    def query(self, query: str, k: int) -> DataFrame: ...


def fuse(vector: DataFrame, text: DataFrame, k: int, fusion: str = "max", rrf_k: int = 60) -> DataFrame:
    """id, score, source of the best ``k`` of both lists (id, score).

    ``max``: the higher score of an id, of equal ones the vector's. ``rrf``: sums of 1 / (rrf_k + rank). ``minmax``: sums of scores
    scaled to [0, 1] per list. Both lists are top-k results, so one task holds them all.
    """
    both = vector.select("id", "score", F.lit("vector").alias("source")).unionByName(text.select("id", "score", F.lit("text").alias("source")))
    if fusion == "max":
        first = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("source"))
        rows = both.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    elif fusion in ("rrf", "minmax"):
        w = Window.partitionBy("source")
        if fusion == "rrf":
            part = 1 / (rrf_k + F.row_number().over(w.orderBy(F.desc("score"), "id")))
        else:
            low, high = F.min("score").over(w), F.max("score").over(w)
            part = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
        scored = both.withColumn("part", part)
        rows = scored.groupBy("id").agg(F.sum("part").alias("score"), F.when(F.count("*") > 1, "both").otherwise(F.max("source")).alias("source"))
    else:
        raise ValueError(f"no fusion {fusion!r}")
    return rows.select("id", "score", "source").orderBy(F.desc("score"), "id").limit(k)


class HybridEngine:
    """One table of chunks, indexed for words and for vectors. Vectors are searched through the table's active index, where it has one."""

    def __init__(self, text: TextIndex, store, embedder, table: str = "documents", fusion: str = "max", metric: str = "l2", nprobes: int = 4, refine_factor: int = 10):
        self.text, self.store, self.embedder, self.table, self.fusion, self.metric = text, store, embedder, table, fusion, metric
        self.nprobes, self.refine_factor = nprobes, refine_factor

    def index(self, chunks: DataFrame) -> None:
        from tidemark.operators.embedding import with_vectors

        # Words are indexed from the written rows: chunks are extracted once.
        self.text.append(self.store.write_documents(self.table, with_vectors(chunks, self.embedder)))
        self.text.merge()

    def _home(self) -> str:
        return f"{self.store.path}/{self.table}_ivf"

    def build_vectors(self, nlist: int | None = None, m: int | None = None) -> str:
        """An index of the table's vectors, of which the newest is active."""
        rows = self.store.read(self.table).where("vector is not null")
        wanted = ann.ivf_params(rows.count(), self.embedder.dim)
        name = ann.IvfPq.build(rows, self._home(), ann.IvfPqParams(min(nlist or wanted.nlist, wanted.nlist), m or wanted.m))
        self.store.activate_index(self.table, name)
        return name

    def near(self, query: list[float], k: int) -> DataFrame:
        """id, score, source of the nearest vectors."""
        active = self.store.active_index(self.table)
        if active is None:
            return vector_search.search_hits(self.store.read(self.table), query, k, self.metric)
        found = ann.IvfPq.load(self.store.spark, self._home(), active).search(query, k, self.nprobes, self.refine_factor, self.metric)
        return found.withColumn("source", F.lit("vector"))

    def query(self, query: str, k: int = 5) -> DataFrame:
        return fuse(self.near(self.embedder.embed_one(query), k), text_search.search_hits(self.text, query, k), k, self.fusion)


class TextEngine:
    """Words alone, behind the same protocol. Its index is written by :class:`TextIndex`, so ``index`` has nothing to do."""

    def __init__(self, text: TextIndex):
        self.text = text

    def index(self, chunks: DataFrame) -> None:
        """Nothing: the search side of an index doesn't write it."""

    def query(self, query: str, k: int = 5) -> DataFrame:
        return text_search.search_hits(self.text, query, k)
