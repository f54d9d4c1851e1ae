"""Vector functions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: inside a lambda, an outer expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(_d(v), lambda x: x * x)))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def distance(a: Column | str, b: Column | str, metric: str = "l2") -> Column:
    """Smaller is nearer: squared L2, one minus cosine, or one minus dot product."""
    if metric == "l2":
        return l2_squared(a, b)
    if metric not in ("cosine", "dot"):
        raise ValueError(f"no metric {metric!r}")
    return 1 - (cosine if metric == "cosine" else dot)(a, b)


def score(d: Column) -> Column:
    """Higher is better."""
    return 1 - d


def normalize(v: Column | str, eps: float = 1e-6) -> Column:
    return let(_d(v), lambda a: let(F.greatest(F.sqrt(total(F.transform(a, lambda x: x * x))), F.lit(eps)), lambda n: F.transform(a, lambda x: x / n)))


def masked_mean(vectors: Column | str, mask: Column | str, eps: float = 1e-12) -> Column:
    """The mean of the vectors whose mask is 1, scaled to length one."""
    vs, m = (F.col(c) if isinstance(c, str) else c for c in (vectors, mask))
    chosen = F.transform(F.filter(F.arrays_zip(vs.alias("v"), m.alias("m")), lambda x: x["m"] > 0), lambda x: x["v"].cast("array<double>"))
    dims = F.size(F.get(vs, F.lit(0)))
    # What is chosen, the mean and its length are computed once each.
    mean = let(chosen, lambda own: let(F.greatest(F.size(own), F.lit(1)), lambda n: F.transform(F.sequence(F.lit(0), dims - 1), lambda i: F.aggregate(own, F.lit(0.0), lambda a, x: a + F.get(x, i)) / n)))
    return let(mean, lambda m: let(F.sqrt(total(F.transform(m, lambda x: x * x))) + eps, lambda n: F.transform(m, lambda x: x / n)))


def grouped_mean(rows: DataFrame, by: str, vector: str, eps: float = 1e-12) -> DataFrame:
    """``by``, cell, v: the mean of each group's vectors, scaled to length one. Cells are summed where the rows are, so no task holds a group."""
    cells = rows.select(by, F.posexplode(_d(vector)).alias("cell", "x")).groupBy(by, "cell").agg(F.avg("x").alias("x"))
    one = cells.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("cell", "x"))).alias("cells"))  # as many as a vector has
    scaled = let(F.sqrt(total(F.transform("cells", lambda c: c["x"] * c["x"]))) + eps, lambda n: F.transform("cells", lambda c: F.struct(c["cell"].alias("cell"), (c["x"] / n).alias("v"))))
    return one.select(by, F.explode(scaled).alias("c")).select(by, "c.cell", "c.v")
