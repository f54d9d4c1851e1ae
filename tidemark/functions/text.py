"""Scalar text functions as Column expressions that stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the analyzer leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "or", "but", "not", "this", "these", "they", "them", "their", "there", "then", "than", "so", "if",
    "when", "where", "why", "how", "what", "which", "who", "whom", "whose", "can", "could", "should", "would", "may", "might", "must",
    "shall", "do", "does", "did", "have", "had", "having",
)

#: What UTF-8 punctuation becomes when it is read as Latin-1.
MOJIBAKE = ("â\u0080\u0099", "â\u0080\u009c", "â\u0080\u009d", "â\u0080\u0093", "â\u0080\u0094")

#: Our table of typographic quotes and what replaces them.
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "′": "'", "″": '"', "´": "'", "`": "'"}

TOKEN = r"[\p{IsAlphabetic}\p{N}]+"
BLANKS = r"(?U)\s+"
#: Fixed value: what BLANKS matches.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def whitespace_words(x: Column | str) -> Column:
    """The words between Unicode white space."""
    return F.filter(F.split(_c(x), BLANKS), lambda w: w != "")


def word_count(x: Column | str) -> Column:
    return F.size(whitespace_words(x))


def token_estimate(x: Column | str) -> Column:
    """Words divided by 0.75, rounded down."""
    return F.floor(word_count(x) / F.lit(0.75)).cast("int")


def strip(x: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def content_hash(x: Column | str) -> Column:
    return F.sha2(_c(x), 256)


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def relative_path(path: Column | str, root: str) -> Column:
    """The path below ``root``."""
    return F.when(F.startswith(_c(path), F.lit(root.rstrip("/") + "/")), F.substr(_c(path), F.lit(len(root.rstrip("/")) + 2))).otherwise(_c(path))


def parent_path(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), r"/?[^/]*$", "")


def facet(category: Column | str) -> Column:
    """A category with one leading slash; without one, ``/misc``."""
    bare = F.regexp_replace(_c(category), r"^/+|/+$", "")
    return F.when(bare == "", F.lit("/misc")).otherwise(F.concat(F.lit("/"), bare))


def facet_ancestors(path: Column | str) -> Column:
    """``/a``, ``/a/b``, ... for ``/a/b/...``."""
    parts = F.filter(F.split(_c(path), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))


def tokens(x: Column | str) -> Column:
    """All tokens, lower-cased, stop words among them: their places are positions."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(TOKEN), F.lit(0))


def is_stop(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def terms(x: Column | str) -> Column:
    """Tokens without stop words."""
    return F.filter(tokens(x), lambda t: ~is_stop(t))


#: A word that a line break split; a word that a blank split, from three letters and a lower-case one on, or else any pair.
#: A match begins where a word does; saying so spares trying all its letters.
SPLIT_BY_LINE = r"(?U)(?<!\w)(\w+)-\s*\n\s*(\w+)"
SPLIT_BY_BLANK = r"(?U)(?<!\w)(?:(\w{3,})-\s+(\p{IsLowercase}\w{2,})|(\w+-\s+\w+))"


def fix_hyphenation(x: Column | str) -> Column:
    """Join words that a line break split, then words that a stray blank split."""
    x = _c(x)
    joined = F.regexp_replace(x, SPLIT_BY_LINE, "$1$2")
    # The second alternative consumes pairs that do not qualify, so that matching goes on behind them.
    return F.when(F.contains(x, F.lit("-")), F.regexp_replace(joined, SPLIT_BY_BLANK, "$1$2$3")).otherwise(x)


def replace_quotes(x: Column | str) -> Column:
    return F.translate(_c(x), "".join(QUOTES), "".join(QUOTES.values()))


def drop_non_ascii(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"[^\x00-\x7F]", "")


def replace_dashes(x: Column | str) -> Column:
    return F.translate(_c(x), "–—", "--")


def clean(x: Column | str, *, lowercase: bool = False, trailing_punctuation: bool = False, dashes: bool = False, extra_whitespace: bool = True, bullets: bool = True) -> Column:
    """Element cleaning, in this order: lower case, trailing punctuation, dashes, white space, a leading bullet."""
    x = _c(x)
    x = F.lower(x) if lowercase else x
    x = F.regexp_replace(x, r"[.,:;]+$", "") if trailing_punctuation else x
    x = F.regexp_replace(x, "[-–]", " ") if dashes else x
    x = F.trim(F.regexp_replace(F.regexp_replace(x, "[ \n]", " "), " {2,}", " ")) if extra_whitespace else x
    return F.trim(F.regexp_replace(x, "^[•·▪▫●⁃*-]\\s*", "")) if bullets else F.trim(x)


def paragraphs_from_breaks(x: Column | str) -> Column:
    """Single line feeds become blanks, three and more become two."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"(?<!\n)\n(?!\n)", " "), r"\n{3,}", "\n\n")


def non_ascii_ratio(x: Column | str) -> Column:
    x = _c(x)
    return F.when(F.length(x) > 0, F.length(F.regexp_replace(x, r"[\x00-\x7F]", "")) / F.length(x)).otherwise(F.lit(0.0))


def has_mojibake(x: Column | str) -> Column:
    found = F.lit(False)
    for p in MOJIBAKE:
        found = found | F.contains(_c(x), F.lit(p))
    return found


def needs_aggressive(x: Column | str, file_format: Column | str | None = None) -> Column:
    """Whether a text shows signs of a bad extraction."""
    fmt = F.lit(None).cast("string") if file_format is None else _c(file_format)
    return F.coalesce(fmt == "pdf", F.lit(False)) | has_mojibake(x) | ((F.length(_c(x)) > 100) & (non_ascii_ratio(x) > 0.1))


def alnum_ratio(x: Column | str) -> Column:
    s = strip(x)
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(_c(x), r"[^\p{IsAlphabetic}\p{N}]", "")) / F.length(s))


def mostly_punctuation(x: Column | str) -> Column:
    """Under 30 % letters and digits; blank lines are not."""
    return F.coalesce(alnum_ratio(x) < 0.3, F.lit(False))


def collapse_blanks(x: Column | str) -> Column:
    return strip(F.regexp_replace(_c(x), " +", " "))


def pdf_artifacts(x: Column | str) -> Column:
    x = F.regexp_replace(_c(x), r"\.{3,}", "...")
    x = F.regexp_replace(F.regexp_replace(x, " {2,}", " "), r"\n{3,}", "\n\n")
    special = lambda l: F.length(F.regexp_replace(l, r"(?U)[\w\s]", "")) / F.greatest(F.length(l), F.lit(1))  # noqa: E731, E741
    return F.array_join(F.filter(F.split(x, "\n", -1), lambda l: special(l) < 0.7), "\n")  # noqa: E741


def html_artifacts(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(x), "&[a-zA-Z0-9#]+;", ""), BLANKS, " ")


def docx_artifacts(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(x), BLANKS, " "), r"\n+", "\n")


def format_artifacts(x: Column | str, file_format: Column | str) -> Column:
    fmt = _c(file_format)
    return F.when(fmt == "pdf", pdf_artifacts(x)).when(fmt.isin("html", "htm"), html_artifacts(x)).when(fmt.isin("docx", "doc"), docx_artifacts(x)).otherwise(_c(x))


def collapse_blank_lines(lines: Column) -> Column:
    """An array of lines in which a blank line never follows another."""
    blank = lambda l: strip(l) == ""  # noqa: E731, E741
    # An outer expression in a lambda is computed for every element, so the lines are computed before.
    held = F.transform(F.array(lines), lambda own: F.filter(own, lambda l, i: ~(blank(l) & (i > 0) & blank(F.get(own, i - 1)))))  # noqa: E741
    return F.get(held, F.lit(0))
