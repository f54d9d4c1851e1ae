"""Bounded samples of documents for fitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._store import materialize

#: Ids are drawn for a share that is this much larger than wanted, then cut to the wanted number: counts are estimates.
SLACK = 1.2
#: Values of which each gets a plan of its own.
FEW = 4


def sample(docs: DataFrame, keys: DataFrame, limits: dict | int, by: str, salt: int = 0) -> tuple[DataFrame, dict]:
    """doc_id, text, ``by`` of documents whose ids are in ``keys`` (doc_id, ``by``), and how many ids each value has.

    At most ``limits`` ids of each value of ``by`` (a number for each, or one for all) are drawn by a hash of the id, which does not
    depend on partitions, and there is one row for each: of rows that share an id, the one whose text has the lowest hash. So the
    bound holds whatever rows are repeated. Null ids are left out.
    """
    ids = keys.where(F.col("doc_id").isNotNull() & F.col(by).isNotNull()).select("doc_id", by)
    counts = {r[by]: r["n"] for r in ids.groupBy(by).agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()}
    if not counts:
        return docs.where("false").select("doc_id", "text", F.lit(None).cast(keys.schema[by].dataType).alias(by)), {}
    most = {v: limits if isinstance(limits, int) else limits.get(v, 0) for v in counts}
    kind = keys.schema[by].dataType.simpleString()
    # One row a value of ``by``.
    shares = docs.sparkSession.createDataFrame([(v, SLACK * most[v] / n, most[v]) for v, n in counts.items()], f"`{by}` {kind}, share double, most long")
    drawn = F.xxhash64("doc_id", F.lit(salt))
    part = ids.join(F.broadcast(shares), by).where(F.pmod(drawn, F.lit(1 << 30)) < F.col("share") * (1 << 30))
    part = materialize(part.groupBy("doc_id").agg(F.min(by).alias(by), F.min("most").alias("most")))
    if len(most) <= FEW:  # the best of each task, then of all
        chosen = reduce(DataFrame.unionAll, [part.where(F.col(by) == F.lit(v)).orderBy(drawn, "doc_id").limit(m).select("doc_id", by) for v, m in most.items()])
    else:
        rank = F.row_number().over(Window.partitionBy(by).orderBy(drawn, "doc_id"))
        chosen = part.withColumn("rank", rank).where("rank <= most").select("doc_id", by)
    # ``limits`` rows of each value.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min(by).alias(by), F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", by), counts
