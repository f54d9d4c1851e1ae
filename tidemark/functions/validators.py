"""Checks of cleaned text: each a struct of whether it passed and the issues found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import _c, has_mojibake, strip

MIN_LENGTH = 50
#: How a list item begins.
BULLETS = ("(?mU)^\\s*[•·▪▫]\\s*", "(?mU)^\\s*[-*+]\\s*", "(?mU)^\\s*\\d+[.)]\\s*")


def unicode_clean(x: Column | str) -> Column:
    return ~has_mojibake(x)


def hyphenation_fixed(x: Column | str) -> Column:
    return ~F.rlike(_c(x), F.lit(r"(?U)\w+-\s*\n\s*\w+"))


def whitespace_clean(x: Column | str) -> Column:
    return ~F.rlike(_c(x), F.lit(r" {3,}|\n{3,}|\t"))


def bullets_clean(x: Column | str) -> Column:
    found = F.lit(False)
    for p in BULLETS:
        found = found | F.rlike(_c(x), F.lit(p))
    return ~found


def quotes_normal(x: Column | str, ascii_only: bool = False) -> Column:
    """No typographic quotes; with ``ascii_only``, no double quote at all."""
    return ~F.contains(_c(x), F.lit('"')) if ascii_only else ~F.rlike(_c(x), F.lit("[‘’“”]"))


def dashes_normal(x: Column | str) -> Column:
    return ~F.rlike(_c(x), F.lit("[–—]"))


def long_enough(x: Column | str, least: int = MIN_LENGTH) -> Column:
    return F.length(strip(x)) >= least


def few_empty_lines(x: Column | str) -> Column:
    lines = F.split(_c(x), "\n", -1)
    empty = F.size(F.filter(lines, lambda l: strip(l) == ""))  # noqa: E741
    return empty <= F.size(lines) * F.when(F.size(lines) < 10, F.lit(0.4)).otherwise(F.lit(0.2))


def format_clean(x: Column | str, file_format: Column | str) -> Column:
    fmt, x = _c(file_format), _c(x)
    bad = F.when(fmt == "pdf", F.rlike(x, F.lit(r"\.{4,}"))).when(fmt.isin("html", "htm"), F.rlike(x, F.lit("&[a-zA-Z0-9#]+;"))).when(fmt.isin("docx", "doc"), F.contains(x, F.lit("\x00")))
    return ~F.coalesce(bad, F.lit(False))


def checks(x: Column | str, file_format: Column | str) -> dict[str, Column]:
    return {
        "unicode_clean": unicode_clean(x), "hyphenation_fixed": hyphenation_fixed(x), "whitespace_normalized": whitespace_clean(x), "bullets_cleaned": bullets_clean(x),
        "quotes_normalized": quotes_normal(x), "dashes_normalized": dashes_normal(x), "min_length": long_enough(x), "empty_lines": few_empty_lines(x), "format_specific": format_clean(x, file_format),
    }


def validate(x: Column | str, file_format: Column | str) -> Column:
    """All checks as a map from name to (passed, issues)."""
    parts = []
    for name, passed in checks(x, file_format).items():
        issues = F.when(passed, F.array().cast("array<string>")).otherwise(F.array(F.lit(f"{name} failed")))
        parts += [F.lit(name), F.struct(passed.alias("passed"), issues.alias("issues"))]
    return F.create_map(*parts)


def passed_count(results: Column) -> Column:
    return F.size(F.map_filter(results, lambda _, v: v["passed"]))
