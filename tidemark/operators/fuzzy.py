"""Terms within an edit distance, found by key.

A term is cut into one piece more than there may be edits, so of two words within the distance one has a piece of the other unchanged, moved by
no more places than there are edits. A dictionary is written with a row for each piece of a term, three whatever its length, sorted by the hash of the term's length, the
piece's number and the piece. A search makes the keys of all terms that its word can be near to, reads the row groups of those and compares what it
finds there; no term within the distance is missed. Distances beyond ``DISTANCE`` scan the dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits that a written dictionary is made for.
DISTANCE = 2
PIECES = DISTANCE + 1


def _bound(length: Column, i: Column) -> Column:
    """Where piece ``i`` of a term of that length begins, from 0."""
    return F.floor(i * length / PIECES).cast("int")


def keys(term: Column) -> Column:
    """Hashes of the pieces of a term. Null has none."""
    n = F.length(term)
    piece = lambda i: F.substr(term, _bound(n, i) + 1, _bound(n, i + 1) - _bound(n, i))
    return F.when(term.isNotNull(), F.transform(F.array(*map(F.lit, range(PIECES))), lambda i: F.hash(n, i, piece(i))))


def probes(word: Column, distance: int = DISTANCE) -> Column:
    """The keys that a term within ``distance`` of a word can have: pieces of terms of about its length, at about their places."""
    n, edits = F.length(word), F.lit(distance)

    def moved(length: Column, i: Column) -> Column:
        start, size = _bound(length, i), _bound(length, i + 1) - _bound(length, i)
        places = F.filter(F.sequence(start - edits, start + edits), lambda p: (p >= 0) & (p + size <= n))
        return F.transform(places, lambda p: F.hash(length, i, F.substr(word, p + 1, size)))

    lengths = F.sequence(F.greatest(n - edits, F.lit(0)), n + edits)
    found = F.transform(lengths, lambda length: F.flatten(F.transform(F.array(*map(F.lit, range(PIECES))), lambda i: moved(length, i))))
    return F.when(word.isNotNull(), F.array_distinct(F.flatten(found)))


def neighbourhood(terms: DataFrame) -> DataFrame:
    """key, term of a dictionary (term)."""
    return terms.select(F.explode(keys(F.col("term"))).alias("key"), "term")


def within(a: Column, b: Column, distance: int) -> Column:
    """The edit distance in characters, or null beyond ``distance``."""
    found = F.levenshtein(a, b, distance)
    return F.when(found >= 0, found)


def scan(terms: DataFrame, word: str, distance: int) -> DataFrame:
    """term, distance of a dictionary's (or postings') terms near ``word``, of which all of about its length are looked at."""
    near = terms.select("term").where(F.abs(F.length("term") - len(word)) <= distance).distinct()
    return near.select("term", within(F.col("term"), F.lit(word), distance).alias("distance")).where("distance is not null")


def lookup(near: DataFrame, word: str, distance: int) -> DataFrame:
    """The same from a neighbourhood (key, term): the word's keys filter its scan."""
    own = near.sparkSession.range(1).select(probes(F.lit(word), distance)).first()[0]
    found = near.where(F.col("key").isin(own)).select("term").distinct()
    return found.select("term", within(F.col("term"), F.lit(word), distance).alias("distance")).where("distance is not null")


def join(words: DataFrame, near: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """word, term, distance for many words (word) and a neighbourhood (key, term), by equal keys. Words that stand there often count once, null is near nothing."""
    if distance > DISTANCE:
        raise ValueError(f"a neighbourhood is made for {DISTANCE} edits")
    own = words.select("word").distinct().select("word", F.explode(probes(F.col("word"), distance)).alias("key"))
    # Compared before duplicates go: most of what shares a key is not near.
    near_by = own.join(near, "key").select("word", "term", within(F.col("word"), F.col("term"), distance).alias("distance"))
    return near_by.where("distance is not null").distinct()
