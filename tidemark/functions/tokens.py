"""Exact counts of byte-pair tokens."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import SourceError

#: Fixed value: how a vocabulary of ranks cuts a text before pairs are merged, where its file doesn't say.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def counter(path: str, pattern: str = PATTERN) -> Callable[[list[str]], list[int]]:
    """Counts for texts by the vocabulary of a file: ``.json`` of tokenizers, ``.tiktoken`` of ranks."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(e.encode_ordinary(t)) for t in texts]
    raise SourceError(f"no vocabulary: {path}")


def bpe_token_count(x: Column | str, path: str) -> Column:
    """The number of tokens of each text; a null text has none. ``path`` must be there on every executor."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counter(path)
        for s in batches:
            yield pd.Series(of(["" if t is None else t for t in s]), dtype="int32")

    return count(x)
