"""Fill-in-the-middle texts, as relations of a text's units.

A unit is a word with the white space before it, or white space that ends the text. The units of a text are exploded with their
ordinals; a window sums their lengths, so that each ordinal knows the character it ends at; the cuts that a text asks for meet the
units by ordinal; one aggregate per text has its offsets, and ``substring`` cuts. All of it is SQL functions.

Texts that are to be cut are known by their id and two hashes of id and text: equal rows are cut alike, so their units are exploded
once, however often they are repeated. Only lengths are shuffled and exploded, ``UNIT_BYTES`` of text to a partition, and the window, the
join and the aggregate stay in the partitioning that the lengths arrive in. Offsets are written down; texts meet them in an ordinary join,
which adaptive execution splits where one text is repeated.

Defined results: a null text is empty, and an empty text is plain; a text that contains one of the markers is plain, as its output
could not be read back; a text of any length is cut whole; a null id is drawn for as an empty one; repeated rows give equal rows; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._store import discard, materialize

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
SEED, CUT_PERCENT, SPM_PERCENT = 42, 50, 80
#: Bytes of text whose units share a partition, and partitions at most: beyond that they grow, and sorts spill.
UNIT_BYTES, MOST_PARTITIONS = 16 << 20, 20_000


def units(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def draw(doc_id: Column | str, number: int, seed: int = SEED) -> Column:
    """The ``number``-th of the eight groups of 32 bits that the hash of seed and id has."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * number - 7, 8), 16, 10).cast("long")


def form(doc_id: Column | str, text: Column | str, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (draw(doc_id, 3, seed) % 100 >= cut_percent)
    return F.when(plain, "plain").when(draw(doc_id, 4, seed) % 100 < spm_percent, "spm").otherwise("psm")


def restore(output: Column | str, how: Column | str) -> Column:
    """The text that an output of this form was made from."""
    output, how = (F.col(c) if isinstance(c, str) else c for c in (output, how))
    part = F.split(output, "<[PSM]>")  # nothing, then three parts, as no part holds a marker
    get = lambda i: F.get(part, F.lit(i))
    return F.when(how == "psm", F.concat(get(1), get(3), get(2))).when(how == "spm", F.concat(get(2), get(3), get(1))).otherwise(output)


def transform(docs: DataFrame, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("form", form("doc_id", "text", cut_percent, spm_percent, seed))
    none = F.lit(None).cast("long")
    plain = rows.where("form = 'plain'").select("doc_id", F.size(units("text")).cast("long").alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))

    key = ["h1", "h2"]
    cut = rows.where("form <> 'plain'").withColumns({"h1": F.xxhash64("doc_id", "text"), "h2": F.xxhash64(F.lit(1), "text", "doc_id")})
    total = cut.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # As many as shuffles have by themselves at least: with fewer, the join would deal the units once more.
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-total // unit_bytes), MOST_PARTITIONS))
    # Equal rows become one before they are dealt. Units are matched once: both what is exploded and what is asked for read the written table.
    lengths = cut.select(*key, draw("doc_id", 1, seed).alias("r1"), draw("doc_id", 2, seed).alias("r2"), F.transform(units("text"), F.length).alias("lengths"))
    lengths = lengths.groupBy(*key).agg(F.first("r1").alias("r1"), F.first("r2").alias("r2"), F.first("lengths").alias("lengths"))
    lengths = materialize(lengths.select("*", F.size("lengths").cast("long").alias("n")))
    texts = lengths.select(*key, "lengths").repartition(partitions, *key)
    exploded = texts.select(*key, F.posexplode("lengths").alias("at", "length"))
    upto = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = exploded.select(*key, "at", F.sum("length").over(upto).alias("end"))

    a, b = F.col("r1") % (F.col("n") + 1), F.col("r2") % (F.col("n") + 1)
    asked = lengths.select(*key, "n", F.explode(F.array(F.struct(F.lit(1).alias("cut"), F.least(a, b).alias("ordinal")), F.struct(F.lit(2).alias("cut"), F.greatest(a, b).alias("ordinal")))).alias("r"))
    asked = asked.select(*(F.col(k).alias(f"r_{k}") for k in key), "n", "r.cut", "r.ordinal").repartition(partitions, *(f"r_{k}" for k in key))
    same = (F.col("h1") == F.col("r_h1")) & (F.col("h2") == F.col("r_h2"))
    # A cut before the first unit is met by that unit as well. The ordinal is no key of the join: the text's partitioning holds for it.
    met = ends.join(asked.hint("merge"), same & (F.greatest("ordinal", F.lit(1)) - F.col("at") == 1))
    end = F.when(F.col("ordinal") > 0, F.col("end")).otherwise(F.lit(0))
    offsets = met.groupBy(*key).agg(F.max("n").alias("n"), F.max(F.when(F.col("cut") == 1, end)).alias("first"), F.max(F.when(F.col("cut") == 2, end)).alias("second"))
    offsets = materialize(offsets)
    discard(lengths)

    found = cut.join(offsets, key)
    text, first, second = F.col("text"), F.col("first").cast("int"), F.col("second").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.length(text) - second)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    made = found.select("doc_id", "n", "form", F.col("first").alias("prefix_chars"), (F.col("second") - F.col("first")).alias("middle_chars"), F.when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))
    return plain.unionByName(made)


def digest(made: DataFrame) -> DataFrame:
    """The outputs of :func:`transform` and the texts read back from them, as hashes."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore("output", "form"), 256).alias("restored_sha256"))


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
f AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1 : least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1 : n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
