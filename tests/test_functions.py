import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import validators as Q
from tidemark.functions import vectors as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (X.fix_hyphenation, "Tra-\nditionally", "Traditionally"),
        (X.fix_hyphenation, "auto- mobile", "automobile"),
        (X.fix_hyphenation, "ab- cde", "ab- cde"),
        (X.fix_hyphenation, "foo- Bar", "foo- Bar"),
        (X.fix_hyphenation, "well-known", "well-known"),
        (X.fix_hyphenation, "foo- bar- baz", "foobar- baz"),
        (X.pdf_artifacts, "a.....b", "a...b"),
        (X.html_artifacts, "a&nbsp;b   c", "ab c"),
        (X.mostly_punctuation, "--- a ---", True),
        (X.mostly_punctuation, "abc...", False),
        (X.mostly_punctuation, "   ", False),
        (X.needs_aggressive, "a" * 90 + "é" * 11, True),
        (X.needs_aggressive, "é" * 100, False),
        (lambda c: X.needs_aggressive(c, F.lit("pdf")), "plain", True),
        (X.replace_quotes, "“a” ‘b’", "\"a\" 'b'"),
        (X.replace_dashes, "a–b—c", "a-b-c"),
        (X.drop_non_ascii, "aéb", "ab"),
        (X.paragraphs_from_breaks, "a\nb\n\n\n\nc", "a b\n\nc"),
        (X.collapse_blanks, "  a   b ", "a b"),
        (X.token_estimate, "a b c", 4),
        (X.stem, "/x/y/a.b.txt", "a.b"),
        (X.extension, "/x/y.z/File.TXT", "txt"),
        (X.extension, "/x/y.z/.hidden", ""),
        (X.facet, "a/b", "/a/b"),
        (X.facet, "", "/misc"),
        (X.facet_ancestors, "/a/b", ["/a", "/a/b"]),
        (X.terms, "The fire AND the Wood", ["fire", "wood"]),
        (lambda c: F.array_join(X.collapse_blank_lines(F.split(c, "\n")), "|"), "a\n\n \nb", "a||b"),
        (lambda c: X.clean(c, lowercase=True, trailing_punctuation=True, dashes=True), "• A-b.;", "a b"),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


@pytest.mark.parametrize(
    ("f", "bad", "good"),
    [
        (Q.whitespace_clean, ["a   b", "a\n\n\nb", "a\tb"], ["a  b", "a\n\nb"]),
        (Q.bullets_clean, ["- item", "x\n1. item", "• item"], ["a - b"]),
        (Q.quotes_normal, ["“a”", "it’s"], ['"a"']),
        (Q.dashes_normal, ["a–b"], ["a-b"]),
        (Q.hyphenation_fixed, ["ab-\ncd"], ["ab-cd"]),
        (Q.long_enough, ["x" * 49 + "  "], ["x" * 50]),
        (Q.few_empty_lines, ["a\n\n\n\n\nb\nc\nd\ne", "a\n\n\n\nb\nc\nd\ne\nf\ng"], ["a\n\n\n\nb\nc\nd\ne\nf", "a\n\n\nb\nc\nd\ne\nf\ng\nh"]),
        (lambda c: Q.format_clean(c, F.lit("pdf")), ["a...."], ["a..."]),
        (lambda c: Q.format_clean(c, F.lit("html")), ["a&amp;b"], ["a&b"]),
        (Q.unicode_clean, ["it" + X.MOJIBAKE[0] + "s"], ["its"]),
    ],
)
def test_validators(spark, f, bad, good):
    assert [one(spark, x, f) for x in bad] == [False] * len(bad)
    assert [one(spark, x, f) for x in good] == [True] * len(good)


def test_validation_map(spark):
    got = one(spark, "- a", lambda c: Q.validate(c, F.lit("txt")))
    assert len(got) == 9 and not got["bullets_cleaned"]["passed"] and got["bullets_cleaned"]["issues"]
    assert one(spark, "- a", lambda c: Q.passed_count(Q.validate(c, F.lit("txt")))) == 7


def test_whitespace_words_equal_python(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab \t\n  　\x0b") for _ in range(30)) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", X.whitespace_words("x").alias("y")).collect()
    assert all(row["y"] == row["x"].split() for row in got)


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0])], "a array<float>, b array<float>").select(
        V.dot("a", "b").alias("d"), V.l2_squared("a", "b").alias("l"), V.cosine("a", "b").alias("c"), V.normalize("a").alias("n"), V.normalize(F.array(F.lit(0.0))).alias("z")
    )
    r = row.first()
    assert (r["d"], r["l"], r["z"]) == (4.0, 2.0, [0.0]) and r["c"] == pytest.approx(0.8) and r["n"] == pytest.approx([1 / 5**0.5, 2 / 5**0.5])


def test_masked_mean(spark):
    df = spark.createDataFrame([([[1.0, 3.0], [2.0, 4.0], [10.0, 10.0], [20.0, 20.0]], [1, 1, 0, 0])], "v array<array<double>>, m array<int>")
    assert df.select(V.masked_mean("v", "m").alias("y")).first()["y"] == pytest.approx([1.5 / 14.5**0.5, 3.5 / 14.5**0.5])


def test_blank_lines_in_time_that_follows_their_number(spark):
    """60,000 lines; looking at each must not cut the text again."""
    import time

    text = "\n\n\nx " * 20_000
    d = spark.createDataFrame([(text,)], "t string").repartition(1)
    began = time.perf_counter()
    n = d.select(F.size(X.collapse_blank_lines(F.split(F.replace("t", F.lit("x"), F.lit("y")), "\n", -1))).alias("n")).first()["n"]
    lines = text.replace("x", "y").split("\n")
    assert n == sum(not (i and not x.strip() and not lines[i - 1].strip()) for i, x in enumerate(lines))
    assert time.perf_counter() - began < 30


def test_grouped_mean_is_that_of_each_group(spark):
    d = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [2.0, 5.0]), ("b", [0.0, 3.0]), (None, [2.0, 0.0]), ("c", None)], "k string, v array<double>")
    got = {(r["k"], r["cell"]): r["v"] for r in V.grouped_mean(d, "k", "v").collect()}
    assert got == pytest.approx({("a", 0): 1.5 / 14.5**0.5, ("a", 1): 3.5 / 14.5**0.5, ("b", 0): 0.0, ("b", 1): 1.0, (None, 0): 1.0, (None, 1): 0.0})
    plan = V.grouped_mean(d, "k", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "avg(" in plan
