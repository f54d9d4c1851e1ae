"""Cleaning of extracted text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_NEW_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


@dataclass(frozen=True)
class Cleaning:
    english_only: bool = True
    lowercase: bool = False
    min_text_length: int = 50
    min_line_length: int = 10
    max_line_length: int = 1000
    remove_empty_lines: bool = True
    remove_whitespace_only: bool = True
    normalize_whitespace: bool = True
    preserve_paragraphs: bool = True
    #: "documented" keeps identifiers and dates; "parity" turns their dashes into blanks.
    clean_mode: str = "documented"


def normalize_for_search(x: Column | str, aggressive: Column | None = None, conf: Cleaning = Cleaning()) -> Column:
    aggressive = F.lit(False) if aggressive is None else aggressive
    x = X.replace_quotes(X.fix_hyphenation(x))
    if conf.english_only:
        x = F.when(aggressive, X.drop_non_ascii(x)).otherwise(x)
    parity = conf.clean_mode == "parity"
    x = X.clean(x, lowercase=conf.lowercase, dashes=parity, extra_whitespace=parity)
    return X.paragraphs_from_breaks(X.replace_dashes(x))


#: Characters that a paragraph has at least, between double blanks and elsewhere; a sentence shorter than this ends one.
SHORT_PARAGRAPH, PARAGRAPH, ENDING_SENTENCE = 20, 50, 100


def _packed(sizes: list[int], limit: int, step: int) -> list[tuple[int, int]]:
    """Runs of neighbours, as many as go into ``limit`` characters, where each costs its size, and ``step`` more behind the first."""
    runs, first, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > limit:
            runs.append((first, i))
            first, held = i, 0
        held += n + step
    return [*runs, (first, len(sizes))] if sizes else runs


def split_long_line(line: str, limit: int) -> list[str]:
    """A line in parts of up to ``limit`` characters, cut between sentences or, if there is one only, between words."""
    if len(line) <= limit:
        return [line]
    parts = _SENTENCE.split(line)
    if len(parts) == 1:
        parts = line.split()
    return [part for a, b in _packed([len(p) for p in parts], limit, 1) if (part := " ".join(parts[a:b]).strip())]


def rebuild_paragraphs(lines: list[str], words: int = 150) -> str:
    """Paragraphs from lines: at double blanks, else behind short sentences, else every ``words`` words."""
    whole = " ".join(filter(None, map(str.strip, lines)))
    if "  " in whole:
        found = [p for p in map(str.strip, whole.split("  ")) if len(p) > SHORT_PARAGRAPH]
    else:
        sentences = [s for s in map(str.strip, _NEW_SENTENCE.split(whole)) if s]
        closes = [len(s) < ENDING_SENTENCE and s.endswith((".", "!", "?")) for s in sentences]
        cuts = [0]
        for i, ends in enumerate(closes, 1):
            if ends and i - cuts[-1] > 1:
                cuts.append(i)
        found = [p for a, b in zip(cuts, [*cuts[1:], len(sentences)], strict=True) if len(p := " ".join(sentences[a:b])) > PARAGRAPH]
    if len(found) < 2:
        every = whole.split()
        found = [p for i in range(0, len(every), words) if len(p := " ".join(every[i : i + words])) > PARAGRAPH]
    return "\n\n".join(found)


def kept_lines(x: Column | str, conf: Cleaning = Cleaning()) -> Column:
    """The lines that are long enough and not mostly punctuation."""
    both = F.transform(F.split(X._c(x), "\n", -1), lambda l: F.struct(l.alias("line"), X.strip(l).alias("bare")))  # noqa: E741

    def good(x: Column) -> Column:
        n = F.length(x["bare"])
        ok = (n >= conf.min_line_length) & ~F.when(n > 0, F.length(F.regexp_replace(x["line"], r"[^\p{IsAlphabetic}\p{N}]", "")) / n < 0.3).otherwise(F.lit(False))
        return ok & (n > 0) if conf.remove_empty_lines or conf.remove_whitespace_only else ok

    # A bare line needs no further trimming: only its blanks are joined.
    return F.transform(F.filter(both, good), lambda x: F.regexp_replace(x["bare"], " +", " ") if conf.normalize_whitespace else x["line"])


def clean_text(x: Column | str, file_format: Column | str, conf: Cleaning = Cleaning()) -> Column:
    """The whole chain. All but the rebuilding of lines and paragraphs, which looks back, stays a Column expression."""
    normal = normalize_for_search(x, X.needs_aggressive(x, file_format), conf)
    lines = kept_lines(X.format_artifacts(normal, file_format), conf)

    @F.pandas_udf("string")
    def rebuild(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda ls: _joined([p for l in (ls if ls is not None else []) for p in split_long_line(l, conf.max_line_length)], conf))  # noqa: E741

    return F.when(F.coalesce(F.length(X._c(x)), F.lit(0)) == 0, F.lit("")).otherwise(rebuild(lines))


def _joined(lines: list[str], conf: Cleaning) -> str:
    single = [l for i, l in enumerate(lines) if l.strip() or not i or lines[i - 1].strip()]  # noqa: E741
    return rebuild_paragraphs(single) if conf.preserve_paragraphs else "\n".join(single)


def long_texts(docs: DataFrame, text_col: str = "text", conf: Cleaning = Cleaning()) -> DataFrame:
    """Without documents whose raw text is too short."""
    return docs.where(F.length(X.strip(text_col)) >= conf.min_text_length)
