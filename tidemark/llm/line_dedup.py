"""Line dedup by site-relative frequency, in DataFrame functions alone.

A line's frequency on a site is the share of the site's documents that contain it. Lines above ``ratio`` (and in ``min_docs``
documents at least) are boilerplate of that site and are dropped from all its documents; the same line stays elsewhere.

Only hashes of lines are shuffled, once, aggregated before the shuffle, so a site or a line that holds a third of all rows is spread.
The boilerplate of a site is bounded: with L lines in a mean document, at most L / ratio lines can exceed it. If all sites
together have at most ``broadcast_lines`` such lines, they are broadcast and texts do not move at all; beyond that, each document's
boilerplate is found by a join on hashes and brought to the texts by a join on the row. Both give the same rows.

Defined results: null text stays null, empty text stays empty; blank lines are kept and never counted; a null host is a site
of its own; a line that repeats within a document counts once for it; repeated rows count as documents each; an
empty table gives an empty table; all columns are returned as they came, with text rewritten and, where there is one,
n_chars counted anew for changed texts. A document that loses all its lines has an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._store import fresh, materialize

RATIO = 0.02
MIN_DOCS = 3
BROADCAST_LINES = 200_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\f\x0b", "    ")) != ""


def boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, min_docs: int = MIN_DOCS) -> DataFrame:
    """host, line (its MD5), n_docs, n_host: the lines that exceed ``ratio`` of their site's documents."""
    own = docs.select(host.alias("host"), "text")
    totals = own.groupBy("host").agg(F.count("*").alias("n_host"))
    counts = (
        own.where(F.col("text").isNotNull())
        .select("host", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _filled), F.md5))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )
    return counts.join(totals, counts.host.eqNullSafe(totals.host)).where(F.col("n_docs") > ratio * F.col("n_host")).select(counts.host, "line", "n_docs", "n_host")


def dedup(docs: DataFrame, host: Column, ratio: float = RATIO, min_docs: int = MIN_DOCS, broadcast_lines: int = BROADCAST_LINES, counts: bool = False) -> DataFrame:
    """``docs`` without the boilerplate of their sites; with ``counts``, also n_lines and n_dropped."""
    columns = docs.columns
    own, row, old, gone = (fresh(columns, f"__{c}") for c in ("host", "row", "old", "lines"))
    found = materialize(boilerplate(docs, host, ratio, min_docs))
    if found.count() <= broadcast_lines:
        by_host = F.broadcast(found.groupBy(F.col("host").alias(own)).agg(F.collect_list("line").alias(gone)))
        joined = docs.join(by_host, host.eqNullSafe(F.col(own)), "left")
    else:
        # Rows get a number of their own, fixed by writing it down: ids may repeat or be null.
        docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
        lines = docs.where(F.col("text").isNotNull()).select(
            row, host.alias("host"), F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _filled), F.md5))).alias("line")
        )
        hits = lines.join(found.withColumnRenamed("host", own), (lines.line == found.line) & lines.host.eqNullSafe(F.col(own)), "left_semi")
        joined = docs.join(hits.groupBy(row).agg(F.collect_list("line").alias(gone)), row, "left")
    drop, text = F.col(gone), F.col(old)
    kept = F.filter(_lines(text), lambda x: ~F.coalesce(F.array_contains(drop, F.md5(x)), F.lit(False)) | ~_filled(x))
    out = joined.withColumn(old, F.col("text")).withColumn("text", F.when(drop.isNotNull(), F.array_join(kept, "\n")).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text") == text, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    extra = []
    if counts:
        n = F.when(text.isNull(), 0).otherwise(F.coalesce(F.size(F.filter(_lines(text), _filled)), F.lit(0)))
        lost = F.size(F.filter(_lines(text), lambda x: _filled(x) & F.coalesce(F.array_contains(drop, F.md5(x)), F.lit(False))))
        extra = [n.cast("long").alias("n_lines"), F.when(text.isNull(), 0).otherwise(lost).cast("long").alias("n_dropped")]
    return out.select(*(F.col(f"`{c}`") for c in columns), *extra)


#: The rows of :func:`dedup` on ``documents`` with their source as host.
ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, pos, line, trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    '), ' ') <> '' AS filled
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), totals AS (SELECT source, count(*) AS n_host FROM documents GROUP BY source),
found AS (
  SELECT l.source, l.line FROM (SELECT source, line, count(DISTINCT doc_id) AS n_docs FROM lines WHERE filled GROUP BY source, line) l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE n_docs >= {MIN_DOCS} AND n_docs > {RATIO} * n_host
), marked AS (
  SELECT l.*, l.filled AND f.line IS NOT NULL AS gone FROM lines l LEFT JOIN found f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.text, '') END AS text,
  coalesce(m.n_lines, 0)::BIGINT AS n_lines, coalesce(m.n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text, count(*) FILTER (filled) AS n_lines, count(*) FILTER (gone) AS n_dropped
  FROM marked GROUP BY doc_id
) m ON d.doc_id = m.doc_id
"""
