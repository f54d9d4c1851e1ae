"""An inverted-file index with product quantisation, as Parquet tables and DataFrame plans.

Coarse centroids come from a sample that grows with their number. Small numbers are fitted in one go; larger ones in two levels: a few
centers from a bounded sample, then the centroids around each center by one task each, from a bounded number of rows. An index is a
version of a folder: its centroids and codebooks, and the vectors with their codes, sorted by cell, so that a search reads the row groups
of the cells it probes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import IndexError_
from tidemark.operators.vector_search import flat_search
from tidemark.sources import versions

#: Sampled rows for each centroid; rows that one task fits on, at most; distances that are held at once.
CELL_ROWS, TASK_ROWS, HELD = 32, 50_000, 4_000_000


@dataclass(frozen=True)
class IvfPqParams:
    nlist: int
    m: int
    nbits: int = 8


def ivf_params(n: int, dim: int) -> IvfPqParams:
    """Cells: twice the root of n, within [2048, 65536], fewer than n; 32 sub-vectors from 1024 dimensions, else 16."""
    nlist = min(max(2048, 2 * math.isqrt(max(n, 0))), 65536)
    return IvfPqParams(1 if n <= 1 else min(nlist, n - 1), 32 if dim >= 1024 else 16)


def _kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=len(centers))
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    own, square = np.zeros(len(x), np.int64), (centers**2).sum(1)
    rows = max(1, HELD // len(centers))
    for a in range(0, len(x), rows):
        own[a : a + rows] = np.argmin(square - 2 * x[a : a + rows] @ centers.T, 1)
    return own


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass
class IvfPq:
    """Coarse centroids and one codebook per sub-vector; small arrays whose size depends on parameters alone."""

    centroids: np.ndarray
    codebooks: np.ndarray
    params: IvfPqParams

    #: Where an index that was built or loaded has its vectors.
    vectors: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def train(cls, table: DataFrame, params: IvfPqParams, vector_col: str = "vector", task_rows: int = TASK_ROWS, seed: int = 1, id_col: str = "id") -> IvfPq:
        """On a sample of ``CELL_ROWS`` rows a centroid; codebooks on ``task_rows`` rows at most. Rows are drawn by their ids: equal vectors are drawn each for itself."""
        rows = table.where(F.col(vector_col).isNotNull()).select(F.xxhash64(F.lit(seed), id_col).alias("k"), F.col(vector_col).cast("array<double>").alias("v"))
        total = rows.count()
        some = lambda n: rows.where(F.pmod("k", F.lit(1 << 30)) <= int(min(1.0, n / max(total, 1)) * (1 << 30)))
        local = _matrix(some(task_rows).select("v").limit(2 * task_rows).toArrow().column(0).combine_chunks())
        local = local[np.lexsort(local.T)]
        if params.nlist * CELL_ROWS <= task_rows or total <= task_rows:
            centroids = _kmeans(local, params.nlist, seed=seed)
        else:
            centroids = _two_levels(some(params.nlist * CELL_ROWS), local, params.nlist, task_rows, seed)
        sub = (local - centroids[_nearest(local, centroids)]).reshape(len(local), params.m, -1)
        books = [_kmeans(sub[:, j], min(2**params.nbits, len(local)), seed=seed + j) for j in range(params.m)]
        return cls(centroids, np.stack(books), params)

    @classmethod
    def build(cls, table: DataFrame, home: str, params: IvfPqParams, vector_col: str = "vector", id_col: str = "id", seed: int = 1) -> str:
        """Train, encode and write; the new version of ``home`` is current, and its name is returned."""
        spark, name = table.sparkSession, versions.new_name()
        index = cls.train(table, params, vector_col, seed=seed, id_col=id_col)
        parts = [("centroid", i, 0, c) for i, c in enumerate(index.centroids)] + [("code", i, j, c) for j, book in enumerate(index.codebooks) for i, c in enumerate(book)]
        kind, number, sub, vector = zip(*parts, strict=True)
        model = pa.table({"kind": kind, "i": pa.array(number, pa.int32()), "j": pa.array(sub, pa.int32()), "v": pa.array([v.astype(np.float32) for v in vector], pa.list_(pa.float32())), "nbits": pa.array([params.nbits] * len(kind), pa.int32())})
        spark.createDataFrame(model).write.parquet(f"{home}/{name}/model")
        index = cls.load(spark, home, name, vectors=False)  # what searches will use, in their precision
        encoded = index.encode(table, id_col, vector_col)
        encoded.repartitionByRange("ivf_cell").sortWithinPartitions("ivf_cell").write.option("parquet.block.size", 16 << 20).parquet(f"{home}/{name}/vectors")
        versions.commit(spark, home, name)
        return name

    @classmethod
    def load(cls, spark: SparkSession, home: str, name: str | None = None, vectors: bool = True) -> IvfPq:
        """The current version of ``home``, or the one of this name."""
        name = name or versions.current(spark, home)
        if name is None:
            raise IndexError_(f"no index at {home}")
        rows = spark.read.parquet(f"{home}/{name}/model").toArrow().sort_by([("kind", "ascending"), ("j", "ascending"), ("i", "ascending")])
        kind = np.array(rows["kind"].to_pylist())
        pick = lambda k: _matrix(rows.filter(pa.array(kind == k))["v"].combine_chunks())
        centroids, m = pick("centroid"), int(np.max(rows["j"].to_numpy())) + 1
        books = pick("code")
        table = spark.read.parquet(f"{home}/{name}/vectors") if vectors else None
        return cls(centroids, books.reshape(m, -1, centroids.shape[1] // m), IvfPqParams(len(centroids), m, rows["nbits"][0].as_py()), table)

    def encode(self, table: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
        """id, ivf_cell, codes, vector: write it sorted by ``ivf_cell`` so that a search prunes cells."""
        kind, m = table.schema[id_col].dataType.simpleString(), self.params.m
        model = table.sparkSession.sparkContext.broadcast((self.centroids, self.codebooks))  # its size is a parameter

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, books = model.value
            for batch in batches:
                x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, centroids.shape[1]))
                cell = _nearest(x, centroids)
                sub = (x - centroids[cell]).reshape(len(x), m, -1)
                codes = np.stack([_nearest(sub[:, j], books[j]) for j in range(m)], 1) if len(x) else np.zeros((0, m))
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * m)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(codes.astype(np.int16).ravel())), batch.column(1)], ["id", "ivf_cell", "codes", "vector"])

        vector = table.schema[vector_col].dataType.simpleString()
        return table.where(F.col(vector_col).isNotNull()).select(id_col, vector_col).mapInArrow(run, f"id {kind}, ivf_cell int, codes array<smallint>, vector {vector}")

    def search(self, query: list[float], k: int, nprobe: int = 4, refine_factor: int = 10, metric: str = "cosine", encoded: DataFrame | None = None) -> DataFrame:
        """Probe the nearest cells, rank their codes by table look-ups, then rank k x refine_factor candidates exactly."""
        encoded = self.vectors if encoded is None else encoded
        q = np.array(query, float)
        near = np.argsort(((self.centroids - q) ** 2).sum(1), kind="stable")[:nprobe]
        rows = encoded.where(F.col("ivf_cell").isin([int(c) for c in near]))
        parts = []
        for cell in near:
            sub = (q - self.centroids[cell]).reshape(self.params.m, -1)
            parts.append([((self.codebooks[j] - sub[j]) ** 2).sum(1) for j in range(self.params.m)])
        place = {int(c): i for i, c in enumerate(near)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.array(parts)
            for batch in batches:
                at = np.array([place[c] for c in batch.column("ivf_cell").to_pylist()], int)
                codes = batch.column("codes").flatten().to_numpy().astype(int).reshape(batch.num_rows, -1)
                d = table[at[:, None], np.arange(codes.shape[1])[None, :], codes].sum(1) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(d)], ["id", "vector", "approx"])

        kind, vector = (rows.schema[c].dataType.simpleString() for c in ("id", "vector"))
        candidates = rows.mapInArrow(run, f"id {kind}, vector {vector}, approx double").orderBy("approx", "id").limit(k * refine_factor)
        return flat_search(candidates, query, k, metric)

    def batch_search(self, queries: DataFrame, k: int, nprobe: int = 4, refine_factor: int = 10, encoded: DataFrame | None = None, cell_rows: int = TASK_ROWS) -> DataFrame:
        """query_id, id, score, rank: the ``k`` nearest by cosine of every row of ``queries`` (query_id, query).

        Queries are dealt to the cells that they probe, and a cell is read once for all of its queries, ``cell_rows`` vectors to a task: a large cell is dealt in
        parts, which meet its queries each. A part ranks its codes by table look-ups, the best k x ``refine_factor`` of a query exactly, and hands on k.
        """
        encoded = self.vectors if encoded is None else encoded
        model = encoded.sparkSession.sparkContext.broadcast((self.centroids, self.codebooks))  # its size is a parameter
        key, kind = (d.dataType.simpleString() for d in (queries.schema["query_id"], encoded.schema["id"]))
        probes = min(nprobe, len(self.centroids))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column(1).cast(pa.list_(pa.float64()))) if batch.num_rows else np.zeros((0, model.value[0].shape[1]))
                near = np.argsort(((model.value[0][None] - q[:, None]) ** 2).sum(2), 1, kind="stable")[:, :probes].astype(np.int32)
                ends = pa.array(np.arange(len(q) + 1, dtype=np.int32) * probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(near.ravel()))], ["query_id", "query", "cells"])

        sizes = encoded.groupBy("ivf_cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts"))  # a row a cell
        asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).mapInArrow(probe, f"query_id {key}, query array<double>, cells array<int>")
        asked = asked.select("query_id", "query", F.explode("cells").alias("ivf_cell")).join(sizes, "ivf_cell").select("query_id", "query", "ivf_cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        held = encoded.join(sizes, "ivf_cell").select("id", "ivf_cell", "codes", "vector", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))

        def meet(asks: pa.Table, rows: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if asks.num_rows and rows.num_rows:
                centroids, books = model.value
                x = _matrix(rows["vector"].combine_chunks().cast(pa.list_(pa.float64())))
                norms = np.sqrt((x * x).sum(1))
                codes = rows["codes"].combine_chunks().flatten().to_numpy().astype(int).reshape(len(x), -1)
                ids, cell = np.array(rows["id"].to_pylist(), object), rows["ivf_cell"][0].as_py()
                for who, q in zip(asks["query_id"].to_pylist(), _matrix(asks["query"].combine_chunks()), strict=True):
                    sub = (q - centroids[cell]).reshape(len(books), 1, -1)
                    far = ((books - sub) ** 2).sum(2)[np.arange(len(books))[None, :], codes].sum(1)
                    most = k * refine_factor
                    near = np.flatnonzero(far <= np.partition(far, most - 1)[most - 1]) if len(far) > most else np.arange(len(far))
                    best = near[np.argsort(far[near], kind="stable")][:most]
                    scale = norms[best] * np.sqrt((q * q).sum())
                    score = np.where(scale > 0, (x[best] @ q) / np.where(scale > 0, scale, 1), 0.0)
                    out += [(who, ids[best[i]], float(score[i])) for i in np.lexsort((ids[best].astype(str), -score))[:k]]
            who, ids, score = zip(*out, strict=True) if out else ((), (), ())
            return pa.table({"query_id": pa.array(who, asks.schema.field("query_id").type), "id": pa.array(ids, rows.schema.field("id").type), "score": pa.array(score, pa.float64())})

        found = asked.groupBy("ivf_cell", "part").cogroup(held.groupBy("ivf_cell", "part")).applyInArrow(meet, f"query_id {key}, id {kind}, score double")
        # k rows for each part of each probed cell.
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _two_levels(sample: DataFrame, local: np.ndarray, nlist: int, task_rows: int, seed: int) -> np.ndarray:
    """``nlist`` centroids: of each center as many as its share of ``sample`` asks for, fitted by a task of its own on ``task_rows`` rows at most."""
    centers = _kmeans(local[np.random.default_rng(seed).permutation(len(local))[:16_000]], max(1, math.isqrt(nlist)), seed=seed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_nearest(_matrix(batch.column(1)), centers).astype(np.int32)), *batch.columns], ["c", "k", "v"])

    dealt = sample.mapInArrow(deal, "c int, k long, v array<double>")
    counts = {r["c"]: r["n"] for r in dealt.groupBy("c").agg(F.count("*").alias("n")).collect()}  # a row a center
    exact = {c: n * nlist / sum(counts.values()) for c, n in counts.items()}
    wanted = {c: max(1, int(x)) for c, x in exact.items()}
    for c in sorted(exact, key=lambda c: (int(exact[c]) - exact[c], c))[: max(0, nlist - sum(wanted.values()))]:
        wanted[c] += 1
    keep = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, int(min(1.0, task_rows / n) * (1 << 30)))))
    kept = dealt.where(F.pmod(F.xxhash64("k", F.lit(seed + 1)), F.lit(1 << 30)) < keep[F.col("c")])

    def fit(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v").combine_chunks())
        x = x[np.lexsort(x.T)]
        found = _kmeans(x, wanted[table.column("c")[0].as_py()], seed=seed)
        return pa.table({"v": pa.array(list(found), pa.list_(pa.float64()))})

    return _matrix(kept.groupBy("c").applyInArrow(fit, "v array<double>").toArrow().column(0).combine_chunks())


def recalls(index: IvfPq, nprobes: tuple[int, ...] = (1, 4, 8, 16), sample: int = 20, k: int = 10, refine_factor: int = 10) -> list[tuple[int, float]]:
    """Mean recall@k against the exact search for ``sample`` stored vectors, by number of probed cells."""
    rows = index.vectors.orderBy("id").limit(sample).select("vector").collect()
    exact = [{x["id"] for x in flat_search(index.vectors, list(r["vector"]), k, "cosine").collect()} for r in rows]
    out = []
    for n in nprobes:
        got = [{x["id"] for x in index.search(list(r["vector"]), k, n, refine_factor).collect()} for r in rows]
        out.append((n, float(np.mean([len(a & b) / max(len(a), 1) for a, b in zip(exact, got, strict=True)])) if rows else 0.0))
    return out


def validate_index(index: IvfPq, sample: int = 5, k: int = 10, nprobe: int = 8) -> tuple[bool, float]:
    """Whether any of ``sample`` stored vectors finds something, and the mean recall@k against the exact search."""
    recall = recalls(index, (nprobe,), sample, k)[0][1]
    return recall > 0, recall
