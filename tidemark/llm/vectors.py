"""Embedding near-duplicates through an inverted multi-index.

Vectors are scaled to length one and split in halves, each with a codebook of its own (k-means on a bounded hash sample); the pairs of
codes form a product grid. Every vector is filed in its own cell and looks into the nearest cells, in the order of the sum of
both halves' distances (multi-sequence traversal). How many cells it visits is calibrated: neighbours are drawn at the very
threshold around sampled vectors, and the visits must reach their cells for ``recall`` of them. What stands there is
verified in double precision, in blocks of a cell by a cell's visitors: a large cell becomes many blocks, and a block returns counts and a
spanning part of its links, not pairs. Exact copies are one vector until the end.

Vectors of each length have an index of their own, and meet only those of their label and length. A length of up to a block of
vectors has one cell, where all are compared.

A pair found from either side counts once: the visitor of a cell counts both sides unless the other one also visits the visitor's cell.

Defined results: a vector that is null, zero, without a label or an id, or with a null or non-finite component links
with nothing; vectors of one component are equal if their signs are; repeated rows are vectors of their own and link as copies; a null vec_id has a null component and isn't kept; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._store import materialize
from tidemark.llm.components import components, stars

COSINE = 0.98
RECALL = 0.97
#: Vectors that codebooks and visits are fitted on, at most; of them, how many stand for a code at least.
FIT_ROWS, CODE_ROWS = 16_000, 8
#: Vectors of either side in a block of a cell.
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = distances(x, centers).argmin(1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def traverse(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> np.ndarray:
    """The ``visits`` nearest cells of each vector, nearest first. A pair of ranks (i, j) can only be among the first n if
    (i+1)(j+1) <= n, as all pairs below it come earlier; only those sums are formed."""
    half = x.shape[1] // 2
    d = [distances(x[:, :half], books[0]), distances(x[:, half:], books[1])]
    order = [v.argsort(1, kind="stable") for v in d]
    near = [np.take_along_axis(v, o, 1) for v, o in zip(d, order, strict=True)]
    upto = np.minimum(visits // np.arange(1, min(len(books[0]), visits) + 1), len(books[1]))
    i = np.repeat(np.arange(len(upto)), upto)
    j = np.arange(len(i)) - np.repeat(np.cumsum(upto) - upto, upto)
    best = (near[0][:, i] + near[1][:, j]).argsort(1, kind="stable")[:, :visits]
    return order[0][np.arange(len(x))[:, None], i[best]] * len(books[1]) + order[1][np.arange(len(x))[:, None], j[best]]


def calibrate(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cosine: float, recall: float, seed: int = 5) -> int:
    """Visits that reach the cells of ``recall`` of the neighbours that lie at the threshold."""
    rng = np.random.default_rng(seed)
    q = x[rng.permutation(len(x))[:2000]]
    u = rng.normal(size=q.shape)
    u -= (u * q).sum(1, keepdims=True) * q
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    other = cosine * q + np.sqrt(1 - cosine**2) * u
    half = x.shape[1] // 2
    own = np.divmod(traverse(other, books, 1)[:, 0], len(books[1]))
    to = [distances(q[:, :half], books[0]), distances(q[:, half:], books[1])]
    every = np.arange(len(q))
    reach = to[0][every, own[0]] + to[1][every, own[1]]
    # The rank of a cell is the number of sums up to its own, counted per code of the first half among the sorted distances of the second.
    rank = [np.searchsorted(np.sort(b), r * (1 + 1e-12) - a, "right").sum() for a, b, r in zip(*to, reach, strict=True)]
    return int(np.quantile(rank, recall, method="higher"))


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        mine, looks = table.filter(pa.compute.equal(table["kind"], 0)), table.filter(pa.compute.equal(table["kind"], 1))
        out: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        if mine.num_rows and looks.num_rows:
            a, b = (_unit(t["embedding"].combine_chunks()) for t in (looks, mine))
            ra, rb = looks["rep"].to_numpy(), mine["rep"].to_numpy()
            na, nb = looks["n"].to_numpy(), mine["n"].to_numpy()
            home = looks["home"].to_numpy()
            i, j = np.nonzero((a @ b.T >= cosine) & (ra[:, None] != rb[None, :]))
            if len(i):
                visits = mine["visits"].combine_chunks()
                ends, flat = visits.offsets.to_numpy(), visits.values.to_numpy()
                back = np.zeros(len(i), bool)
                for k in np.unique(j):
                    at = np.flatnonzero(j == k)
                    back[at] = np.isin(home[i[at]], flat[ends[k] : ends[k + 1]])
                once = ~back
                count = np.concatenate([np.stack([ra[i], nb[j]], 1), np.stack([rb[j[once]], na[i[once]]], 1)])
                who, inverse = np.unique(count[:, 0], return_inverse=True)
                total = np.bincount(inverse, count[:, 1]).astype(np.int64)
                node, root = stars(ra[i], rb[j])
                out += [np.stack([who, np.full(len(who), -1), total], 1), np.stack([node, root, np.zeros(len(node), np.int64)], 1)]
        rows = np.concatenate(out)
        edge = rows[:, 2] == 0
        return pa.table({"rep": pa.array(rows[:, 0]), "other": pa.array(rows[:, 1], mask=~edge), "links": pa.array(rows[:, 2])})

    return run


def _index(reps: DataFrame, total: int, cosine: float, recall: float, fit_rows: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Codebooks and visits for ``reps``, which are ``total`` vectors of one length."""
    share = min(1.0, fit_rows / total)
    sample = reps.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("embedding").toArrow().column(0).combine_chunks()
    if not len(sample):
        sample = reps.select("embedding").limit(1).toArrow().column(0).combine_chunks()
    x = _unit(sample)
    x = x[np.lexsort(x.T)]
    # Cells as many as the root of the vectors, so that a cell has as many vectors as there are cells.
    codes = max(1, min(len(x) // CODE_ROWS, round(total**0.25)))
    half = x.shape[1] // 2
    books = (kmeans(x[:, :half], codes), kmeans(x[:, half:], codes))
    return books, calibrate(x, books, cosine, recall)


def near_duplicates(table: DataFrame, cosine: float = COSINE, recall: float = RECALL, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``table`` (vec_id, embedding, label)."""
    v = F.col("embedding")
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    )
    rows = table.select("vec_id", "embedding", "label").withColumn("sound", F.coalesce(sound, F.lit(False)))
    element = table.schema["embedding"].dataType.elementType.simpleString()
    # Scaled to length one, vectors of one component are copies of two: they need no index, however many they are.
    rows = rows.withColumn("embedding", F.when(F.col("sound") & (F.size(v) == 1), F.array(F.signum(F.get(v, F.lit(0))).cast(element))).otherwise(v))
    reps = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # Vectors that differ may share an id: each has a number of its own, which is fixed by writing it.
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()))
    lengths = reps.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    index = {r["d"]: _index(reps.where(F.size("embedding") == r["d"]), r["count"], cosine, recall, fit_rows) for r in lengths if r["d"] > 1 and r["count"] > block}

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pa.compute.list_value_length(batch.column("embedding"))
            for d in pa.compute.unique(length).to_pylist():
                alike = batch.filter(pa.compute.equal(length, d))
                for a in range(0, alike.num_rows, 512):
                    part = alike.slice(a, 512)
                    cells = (traverse(_unit(part.column("embedding")), *index[d]) if d in index else np.zeros((part.num_rows, 1))).astype(np.int32)
                    ends = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
                    listed = pa.ListArray.from_arrays(ends, pa.array(cells.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[:, 0]), listed], [*part.schema.names, "home", "visits"])

    # From here on a label is one of a length.
    label = F.concat_ws("/", F.col("label").cast("string"), F.size("embedding")).alias("label")
    filed = materialize(reps.select(label, "embedding", "rep", "n").mapInArrow(file, f"label string, embedding array<{element}>, rep long, n long, home int, visits array<int>"))

    own = filed.select("label", F.col("home").alias("cell"), "rep", "n", "embedding", "home", "visits")
    looks = filed.select("label", F.explode("visits").alias("cell"), "rep", "n", "embedding", "home", F.array().cast("array<int>").alias("visits"))
    members = own.groupBy("label", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("n_own"))
    visitors = looks.groupBy("label", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("n_looks"))
    blocks = materialize(members.join(visitors, ["label", "cell"]))
    part = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = own.join(blocks, ["label", "cell"]).withColumn("i", part(F.col("n_own"))).withColumn("j", every(F.col("n_looks"))).withColumn("kind", F.lit(0))
    theirs = looks.join(blocks, ["label", "cell"]).withColumn("j", part(F.col("n_looks"))).withColumn("i", every(F.col("n_own"))).withColumn("kind", F.lit(1))
    # Dealt by block: by label and cell alone, all blocks of a hot cell would meet in one task.
    dealt = mine.unionByName(theirs).repartition("label", "cell", "i", "j")
    met = dealt.groupBy("label", "cell", "i", "j").applyInArrow(_links(cosine), "rep long, other long, links long")
    met = materialize(met)
    links = met.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    found = components(met.where("other is not null").select("rep", "other"))
    classes = reps.join(links, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    classes = materialize(classes.select("label", "embedding", "component", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(ids, "component").select(F.col("label").alias("l"), F.col("embedding").alias("e"), "n_links", "component_id")
    joined = rows.join(classes, F.col("sound") & (rows.label == F.col("l")) & (rows.embedding == F.col("e")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
