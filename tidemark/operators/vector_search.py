"""Exact nearest-neighbour search and reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators.text_search import fetch


def flat_search(table: DataFrame, query: list[float], k: int, metric: str = "l2", id_col: str = "id", vector_col: str = "vector", digits: int | None = None) -> DataFrame:
    """id, score of the ``k`` nearest. The query is a literal: one scan, and a top-k per partition before any row moves."""
    d = V.distance(vector_col, V.literal(query), metric)
    score = V.score(d) if digits is None else F.round(V.score(d), digits)
    rows = table.where(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), score.alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(k)


def search_hits(table: DataFrame, query: list[float], k: int, metric: str = "l2", id_col: str = "id") -> DataFrame:
    return flat_search(table, query, k, metric, id_col).withColumn("source", F.lit("vector"))


#: Queries and vectors that one task compares.
BLOCK_QUERIES, BLOCK_ROWS = 2_048, 20_000


def batch_search(table: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", digits: int = 6, block_queries: int = BLOCK_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, id, score, rank for every row of ``queries`` (query_id, query), however many they are.

    Queries and vectors are dealt in blocks of bounded size, and each block of queries meets each of vectors in one task, by a product of matrices. A task
    hands on the best ``k`` of each query, ties by id.
    """
    if metric not in ("l2", "cosine", "dot"):
        raise ValueError(f"no metric {metric!r}")
    vectors = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector is not null")
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).where("query is not null")
    n_queries, n_rows = max(1, -(-asked.count() // block_queries)), max(1, -(-vectors.count() // block_rows))
    # A row of either side is written once for each block of the other.
    deal = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_q", deal("query_id", n_queries)).withColumn("_v", every(n_rows))
    right = vectors.withColumn("_v", deal("id", n_rows)).withColumn("_q", every(n_queries))
    key, kind = (d.dataType.simpleString() for d in (left.schema["query_id"], right.schema["id"]))

    def meet(asks: pa.Table, rows: pa.Table) -> pa.Table:
        who, ids, score = [], [], []
        # Rows by id, so that a stable order breaks ties by id; vectors of another length than a query's are no neighbours of it.
        rows = rows.sort_by("id") if rows.num_rows else rows
        for length in pc.unique(pc.list_value_length(asks["query"])).to_pylist():
            some, held = (t.filter(pc.equal(pc.list_value_length(t[c]), length)) for t, c in ((asks, "query"), (rows, "vector")))
            if not held.num_rows:
                continue
            flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, length)
            x, q = flat(held, "vector"), flat(some, "query")
            norms = np.sqrt((x * x).sum(1))
            step = max(1, 4_000_000 // len(x))
            for a in range(0, len(q), step):
                part = q[a : a + step]
                found = part @ x.T
                if metric == "cosine":
                    scale = np.sqrt((part * part).sum(1))[:, None] * norms
                    found = np.where(scale > 0, found / np.where(scale > 0, scale, 1), 0.0)
                elif metric == "l2":
                    found = 1 - np.stack([((x - p) ** 2).sum(1) for p in part])
                found = np.round(found, digits)
                for own, row in zip(some["query_id"].slice(a, step), found, strict=True):
                    row = np.where(np.isnan(row), np.inf, row)  # as in an ORDER BY
                    near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                    near = near[np.argsort(-row[near], kind="stable")][:k]
                    who += [own] * len(near)
                    ids.append(held["id"].take(pa.array(near)))
                    score.append(row[near])
        parts = [c for x in ids for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])]
        return pa.table({
            "query_id": pa.array([w.as_py() for w in who], asks.schema.field("query_id").type),
            "id": pa.chunked_array(parts, rows.schema.field("id").type),
            "score": pa.array(np.concatenate(score) if score else [], pa.float64()),
        })

    found = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInArrow(meet, f"query_id {key}, id {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def lexical_rerank(candidates: DataFrame, query: str, k: int, text_col: str = "content", weight: float = 0.3, digits: int | None = None) -> DataFrame:
    """The best ``k`` by 0.7 x score and 0.3 x the share of query words that occur in the text; an empty query shares nothing."""
    words = query.lower().split()
    found = sum((F.contains(F.lower(text_col), F.lit(w)).cast("int") for w in words), F.lit(0))
    share = found / F.lit(len(words)) if words else F.lit(0.0)
    final = (1 - weight) * F.col("score") + weight * share
    rows = candidates.withColumn("score", final if digits is None else F.round(final, digits))
    return rows.orderBy(F.desc("score"), "id").limit(k)


def text_search(table: DataFrame, query: str, embed, k: int = 10, candidates: int | None = None, metric: str = "l2") -> DataFrame:
    """score, id, category, path, content: nearest by the query's vector, then reranked by its words."""
    near = flat_search(table, embed(query), candidates or 10 * k, metric)
    full = fetch(table.select("id", "category", F.col("doc_path").alias("path"), "content"), near)
    return lexical_rerank(full, query, k).select("score", "id", "category", "path", "content")


