"""Mixing sources to target weights by the cube method.

Each source's target gives its documents one common multiplicity r = target / size. Every document is taken floor(r) times, and
once more with probability r - floor(r), by balanced sampling: the probabilities move along directions in the null space of the
two balance equations of a source, words and documents, until a probability is 0 or 1; each move keeps both totals. At most two
documents of a group stay undecided.

Equal rows are counted first. Each copy is then dealt by a hash of its content and its number to groups of about ``group_rows`` within
its source, so that neither a source nor a document with a third of all rows is one group. What stays undecided goes through the same in ever fewer groups until its source is one
group, whatever the others are; there the landing phase settles the last documents, choosing the nearest total. Each group hands
some settled documents on with its undecided ones, so that every landing has others to trade with. Reruns agree: groups, order
and moves depend on rows alone.

Defined results: null and empty texts have size 0, a source without words has target 0; the null source is a source, last in
order; repeated rows are sampled each; a null doc_id is kept; an empty table gives an empty table; :func:`mixed` returns the
columns it got, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._store import discard, fresh, materialize

WEIGHTS = (5, 2, 1)
MOST = 3
GROUP_ROWS = 4096
#: Settled documents that a group hands on, and that a landing may trade.
SPARE = 10
#: Copies of a row that are dealt, or ranked, together at most.
COPIES = 10_000
SCHEMA = "doc_id long, size long, source_size long, target double, taken long"


def sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, n_docs, source_size, target. ``docs``: source, size, n (rows that are so)."""
    own = docs.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # These windows see one row per source, not the documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    own = own.withColumn("w", w).withColumn("most", most * F.col("source_size").cast("double")).withColumn("full_at", F.col("most") / F.col("w"))
    # Sources fill up in order of full_at; the level is where what is left meets the weights of those that are not full.
    full = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    own = own.withColumn("filled", F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    own = own.withColumn("open", F.sum("w").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    own = own.withColumn("level", (F.sum("source_size").over(everything) - F.col("filled")) / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    return own.withColumn("level", level).select("source", "n_docs", "source_size", F.least("most", F.coalesce(F.col("w") * F.col("level"), F.col("most"))).alias("target"))


def flight(share: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Move ``share`` within [0, 1] until at most two entries are inside, keeping sum(share) and sum(share * size)."""
    p = np.clip(share.astype(float), 0, 1)
    p[p < 1e-9], p[p > 1 - 1e-9] = 0, 1
    inside: list[int] = []
    left = iter(np.flatnonzero((p > 0) & (p < 1)).tolist())
    while True:
        while len(inside) < 3:
            k = next(left, None)
            if k is None:
                return p
            inside.append(k)
        a, b, c = (float(size[k]) for k in inside)
        u = np.array([b - c, c - a, a - b])
        u = u / np.abs(u).max() if u.any() else np.array([1.0, -1.0, 0.0])
        at = p[inside]
        with np.errstate(divide="ignore"):
            up = np.where(u > 0, (1 - at) / u, np.where(u < 0, -at / u, np.inf)).min()
            down = np.where(u > 0, at / u, np.where(u < 0, (at - 1) / u, np.inf)).min()
        # The random choice of the method, as a fixed function of the rows: reruns and retried tasks agree.
        draw = (int(a) * 31 + int(b) * 17 + int(c) * 7 + inside[0] * 131 + inside[1] * 37 + inside[2]) * 0x9E3779B97F4A7C15 % 2**64 / 2**64
        new = at + u * (up if draw < down / (up + down) else -down)
        new[new < 1e-9], new[new > 1 - 1e-9] = 0, 1
        p[inside] = new
        inside = [k for k in inside if 0 < p[k] < 1]


def spares(share: np.ndarray, size: np.ndarray, spare: int = SPARE) -> np.ndarray:
    """Where up to ``spare`` settled entries are that a landing may trade: taken and not taken in turn, near the half, the quarter
    and so on of the largest open one, so that their sums and differences reach any total between."""
    open_ = (share > 0) & (share < 1)
    if not open_.any():
        return np.zeros(0, np.int64)
    most = size[open_].max()
    free = ~open_ & (size > 0) & (size <= most)
    picked: list[int] = []
    for k in range(spare):
        side = free & ((share >= 1) == (k % 2 == 0))
        at = np.flatnonzero(side if side.any() else free)
        if len(at):
            picked.append(int(at[np.abs(size[at] - most / 2 ** (1 + k // 2)).argmin()]))
            free[picked[-1]] = False
    return np.array(picked, np.int64)


def land(share: np.ndarray, size: np.ndarray, spare: int = SPARE) -> np.ndarray:
    """Settle what a flight leaves: its few open entries, and up to ``spare`` settled ones of no greater size, which may change
    sides so that the total of words comes out nearest; of equally near choices, one that changes fewer."""
    p = share.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        wanted = (p[open_] * size[open_]).sum()
        other = spares(p, size, spare)
        units = np.concatenate([open_, other])
        choices = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
        total = choices @ size[units] - (wanted + (p[other] * size[other]).sum())
        flips = (choices[:, len(open_) :] != p[other]).sum(1)
        p[units] = choices[np.lexsort((flips, np.abs(total)))[0]]
    return p


def _fly(rows: DataFrame) -> DataFrame:
    """``rows`` with their new shares; ``onward`` marks what a source of several groups hands on to its next round."""

    def run(table: pa.Table) -> pa.Table:
        # One order for each set of rows. A long document among short ones barely moves, so one of the open ones is often long.
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("k1", "ascending"), ("copy", "ascending")])
        share, size = table.column("share").to_numpy(), table.column("size").to_numpy()
        p, onward = flight(share, size), np.zeros(len(share), bool)
        if table.column("groups")[0].as_py() <= 1:
            p = land(p, size)
        else:
            onward = (p > 0) & (p < 1)
            onward[spares(p, size)] = True
        return table.drop_columns(["group", "groups", "share"]).append_column("share", pa.array(p)).append_column("onward", pa.array(onward))

    kept = [c for c in rows.columns if c not in ("group", "groups", "share")]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", share double, onward boolean"
    return rows.groupBy("source", "group").applyInArrow(run, schema)


def _key(columns: list[str]) -> list:
    """128 bits of the content of these columns."""
    return [F.xxhash64(F.lit(salt), *(F.col(f"`{c}`") for c in columns)).alias(f"k{salt}") for salt in (1, 2)]


def draw(docs: DataFrame, columns: list[str], weights: tuple[int, ...] = WEIGHTS, most: int = MOST, group_rows: int = GROUP_ROWS, copies: int = COPIES) -> DataFrame:
    """doc_id, k1, k2, size, source_size, target, taken (times) for each row of ``docs`` (doc_id, source, text), whose content is ``columns``."""
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size")
    same = materialize(docs.select("doc_id", "source", size, *_key(columns)).groupBy("doc_id", "source", "size", "k1", "k2").agg(F.count("*").alias("n")))
    totals = materialize(sources(same, weights, most))
    t = totals.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + 1e-12)
    kept = ["doc_id", "k1", "k2", "source", "size", "source_size", "target"]
    # A row for so many copies, dealt out where there are more, then a row for each.
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(copies).cast("long"))).alias("copy")
    rows = same.join(t, same.source.eqNullSafe(t.of)).select(*kept, "n_docs", whole.alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("share"), "n", begin)
    if not same.where(F.col("n") > copies).isEmpty():
        rows = rows.repartition("k1", "copy")
    each = F.explode(F.sequence("copy", F.least(F.col("n"), F.col("copy") + copies) - 1)).alias("copy")
    rows = rows.select(*(c for c in rows.columns if c not in ("n", "copy")), each)
    done = None
    while True:
        groups = F.ceil(F.col("n_docs") / group_rows)
        dealt = rows.withColumn("groups", groups).withColumn("group", F.pmod(F.xxhash64("k1", "copy", "n_docs"), groups).cast("int")).drop("n_docs")
        flown = materialize(_fly(dealt))
        settled = flown.where(~F.col("onward")).drop("onward")
        done = settled if done is None else done.unionByName(settled)
        rows = flown.where("onward").drop("onward")
        # Two a group at most: each round has a few thousandths of the open rows of the last. A group without open rows hands on none.
        n = rows.where((F.col("share") > 0) & (F.col("share") < 1)).groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n_docs"))
        if n.isEmpty():
            break
        rows = rows.join(n, rows.source.eqNullSafe(F.col("of"))).drop("of")
    discard(same)
    return done.select("doc_id", "k1", "k2", "size", "source_size", "target", (F.col("whole") + F.round("share")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, group_rows: int = GROUP_ROWS, copies: int = COPIES) -> DataFrame:
    """How many words the mix takes from each document."""
    drawn = draw(docs, ["doc_id", "source", "text"], weights, most, group_rows, copies)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("taken") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, group_rows: int = GROUP_ROWS, copies: int = COPIES) -> DataFrame:
    """The rows of the mix: each document as many times as it is taken."""
    columns = docs.columns
    k1, k2, times, more, n, rank, bucket, first = (fresh(columns, f"__{c}") for c in ("k1", "k2", "times", "more", "n", "rank", "bucket", "first"))
    content = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    chosen = draw(docs, content, weights, most, group_rows, copies).groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2))
    # Of n equal rows, those that are taken once more than the others are the first.
    chosen = chosen.agg(F.min("taken").alias(times), (F.sum("taken") - F.count("*") * F.min("taken")).alias(more), F.count("*").alias(n))
    keys = [c.alias(name) for c, name in zip(_key(content), (k1, k2), strict=True)]
    rows = docs.select("*", *keys).join(chosen, [k1, k2])
    few, many = rows.where(F.col(n) <= copies), None
    if not chosen.where(F.col(n) > copies).isEmpty():
        # Ranks within buckets of a group, which are written down, behind what the buckets before have.
        many = materialize(rows.where(F.col(n) > copies).withColumn(bucket, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col(n) / copies))))
        before = Window.partitionBy(k1, k2).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        filled = many.groupBy(k1, k2, bucket).agg(F.count("*").alias(first)).withColumn(first, F.coalesce(F.sum(first).over(before), F.lit(0)))
        many = many.withColumn(rank, F.row_number().over(Window.partitionBy(k1, k2, bucket).orderBy(F.lit(0)))).join(filled, [k1, k2, bucket]).withColumn(rank, F.col(rank) + F.col(first))
    once = few.where(F.col(n) == 1).withColumn(rank, F.lit(1))
    some = few.where(F.col(n) > 1).withColumn(rank, F.row_number().over(Window.partitionBy(k1, k2).orderBy(F.lit(0))))
    total = F.col(times) + F.when(F.col(rank) <= F.col(more), 1).otherwise(0)
    shown = [F.col(f"`{c}`") for c in columns]
    parts = [part.withColumn(times, total).where(F.col(times) > 0).select(*shown, F.explode(F.sequence(F.lit(1), F.col(times))).alias(n)).select(*shown) for part in (once, some, many) if part is not None]
    return reduce(DataFrame.unionAll, parts)
