"""Chunkers: tables of documents in, tables of chunks out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip, whitespace_words

MAX_TOKENS, OVERLAP = 500, 0.2
#: Texts whose chunks a Python worker holds at once.
AT_ONCE = 64


def windows(words: Column, size: int = 300, overlap: float = OVERLAP) -> Column:
    """Overlapping runs of ``size`` words joined by blanks; the last ends with the words."""
    stride = size - int(size * overlap)
    last = F.greatest(F.ceil((F.size(words) - size) / F.lit(stride)), F.lit(0)) * stride
    return F.transform(F.sequence(F.lit(0), last.cast("int"), F.lit(stride)), lambda s: F.array_join(F.slice(words, s + 1, size), " "))


def paragraph_chunks(text: Column | str, max_tokens: int = MAX_TOKENS, overlap: float = OVERLAP) -> Column:
    """Paragraphs between blank lines; those with too many tokens as overlapping windows. Nothing is shuffled."""
    text = F.col(text) if isinstance(text, str) else text
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    size = int(max_tokens * 0.75 * 0.8)  # 300 words for 500 tokens
    # Words have a character and one between them, so a paragraph of few characters has few words.
    few = lambda p: F.length(p) < 2 * int(max_tokens * 0.75)
    short = lambda p: few(p) | (F.floor(F.size(whitespace_words(p)) / F.lit(0.75)) <= max_tokens)
    return F.flatten(F.transform(paragraphs, lambda p: F.when(short(p), F.array(p)).otherwise(windows(whitespace_words(p), size, overlap))))


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, category: Column | None = None, max_tokens: int = MAX_TOKENS, overlap: float = OVERLAP) -> DataFrame:
    """Rows of the chunk schema. The number of chunks is known before they are exploded, so no window is needed."""
    path = F.col(id_col).cast("string") if path is None else path
    category = F.lit("/misc") if category is None else category
    listed = docs.select(F.col(id_col).cast("string").alias("doc_id"), path.alias("doc_path"), category.alias("category"), paragraph_chunks(text_col, max_tokens, overlap).alias("chunks"))
    # Outer: else Spark filters by the number of chunks as well, and cuts each text twice.
    rows = listed.select("doc_id", "doc_path", "category", F.size("chunks").alias("total_chunks"), F.posexplode_outer("chunks").alias("chunk_index", "content"))
    rows = rows.where("chunk_index is not null")
    return rows.select(F.concat_ws(":", "doc_id", "chunk_index").alias("id"), "doc_id", "doc_path", "category", F.col("category").alias("category_text"), "content", "chunk_index", "total_chunks")


def split_recursive(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Split at the first separator that occurs, again within pieces that are too long, and join neighbours up to ``size``
    characters, each chunk beginning with up to ``overlap`` characters of the last. A separator leads the piece that follows it."""
    if not text:
        return []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        first, *others = text.split(separator)
        parts = [p for p in (first, *(separator + o for o in others)) if p]
    else:
        parts = list(text)
    done: list[str] = []
    run: list[str] = []

    def join() -> None:
        held: list[str] = []
        length = 0
        for p in run:
            if held and length + len(p) > size:
                whole = "".join(held).strip()
                done.extend([whole] if whole else [])
                while held and (length > overlap or length + len(p) > size):
                    length -= len(held.pop(0))
            held.append(p)
            length += len(p)
        whole = "".join(held).strip()
        done.extend([whole] if whole else [])
        run.clear()

    for p in parts:
        if len(p) < size or not finer:
            run.append(p)
        else:
            join()
            done.extend(split_recursive(p, size, overlap, finer))
    join()
    return done


def recursive_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, name_col: str = "file_name", text_col: str = "content") -> DataFrame:
    """chunk_id, content, chunk_index, total_chunks. The greedy joining is sequential, hence an Arrow-batched function."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            for a in range(0, len(s), AT_ONCE):
                yield s.iloc[a : a + AT_ONCE].map(lambda t: split_recursive(t or "", size, overlap))

    listed = docs.withColumn("chunks", cut(text_col))
    rows = listed.select(name_col, F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "content"))
    return rows.select(F.concat_ws("_", name_col, "chunk_index").alias("chunk_id"), "content", F.col(name_col).alias("file_name"), "chunk_index", "total_chunks")
