"""Packing by shortest-pack-first over the length histogram.

Every text is encoded once and cut into pieces of ``max_tokens`` and a rest. The histogram of piece lengths has at
most ``max_tokens`` bins whatever the corpus, so the driver packs the *histogram*: lengths go longest first, each to
the open packs with the most room, and only the counts of packing patterns change. Patterns come back to documents by
rank: the k-th piece of a length takes the k-th slot of that length.

Ranks need no group of one length in one task: equal pieces are one row with a count, which are dealt to hash buckets; a running
sum of the bucket counts gives each bucket's first rank, and a running sum within a bucket the rest. Equal pieces, which
take a run of ranks, become rows again at the end, ``COPIES`` in a task at most.

Ids are those of ``tokenizers``. Ordinary texts get them from an equal and faster encoder over the same vocabulary; its
regular expressions give out on very long runs of white space, so texts with a run of ``BLANKS`` go to ``tokenizers``, as do those with
the string of a special token.

Defined results: a null or empty text is one piece that holds the end token alone; a text of any length is encoded
whole, whatever it holds; repeated rows are packed as separate documents; a null id is kept; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._store import bounded_batches, discard, materialize

MAX_TOKENS = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k"
#: Different pieces of a length that one ranking bucket holds on average; equal pieces that one row stands for when places are given out.
RANK_BUCKET, COPIES = 1_000, 10_000
#: White space in a row from which a text goes to the reference encoder; the fast one bears some hundred thousand.
BLANKS = re.compile(r"\s{4096}")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoders(name: str):
    """The same vocabulary twice: a fast encoder for ordinary text, the reference one for all else."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    return fast, whole, special


def encode(text: str, name: str = TOKENIZER) -> list[int]:
    fast, whole, special = encoders(name)
    if any(s in text for s in special) or BLANKS.search(text):  # the fast encoder knows no special tokens
        return whole.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most ``max_tokens`` ids; each id of a document is in exactly one."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            ids_of, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                ids = np.array([*encode(texts[i].as_py() or "", tokenizer), end_id], dtype="<u4")
                key = ids_of[i].as_py()
                for a in range(0, len(ids), max_tokens):
                    part = ids[a : a + max_tokens]
                    for col, v in zip(out, (key, a, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack_histogram(counts: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns ``(repeats, [(length, times), ...])`` that use up ``counts`` pieces of each length."""
    open_packs: dict[int, list[tuple[int, tuple]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max((r for r, packs in open_packs.items() if packs), default=0)
            if room >= length:
                repeats, pattern = open_packs[room].pop()
                fit = room // length
                use = min(repeats, left // fit)
                if not use:  # fewer pieces than one such pack takes: one pack gets them all
                    use, fit = 1, left
                if repeats > use:
                    open_packs[room].append((repeats - use, pattern))
            else:
                pattern, room, fit = (), max_tokens, max_tokens // length
                use = left // fit
                if not use:
                    use, fit = 1, left
            left -= use * fit
            open_packs.setdefault(room - fit * length, []).append((use, (*pattern, (length, fit))))
    return [(n, list(p)) for r in sorted(open_packs) for n, p in open_packs[r]]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first ranks of its runs of slots, and their first sequence and offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for repeats, pattern in patterns:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                rank = used.get(length, 0)
                runs.setdefault(length, []).append((rank, sequence, offset))
                used[length] = rank + repeats
                offset += length
        sequence += repeats
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: str = TOKENIZER, end_id: int = END_ID, copies: int = COPIES) -> DataFrame:
    """``docs`` (doc_id, text) as pieces with the sequence and the offset each has there."""
    names = PIECES.replace(" long", "").split(", ")
    cut = materialize(pieces(docs, max_tokens, tokenizer, end_id))
    same = materialize(cut.groupBy(*names).agg(F.count("*").alias("n")))
    discard(cut)
    found = same.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.max("n").alias("most")).collect()  # max_tokens rows at most
    table = slots(pack_histogram({r["length"]: r["n"] for r in found}, max_tokens))
    # Each length has as many buckets as its rows need: a frequent one has many.
    shares = docs.sparkSession.createDataFrame([(r["length"], -(-r["rows"] // RANK_BUCKET)) for r in found], "length long, buckets long")
    same = same.join(F.broadcast(shares), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets")).cast("int")).drop("buckets")
    counts = same.groupBy("length", "bucket").agg(F.sum("n").alias("in_bucket"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("first"))

    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn("upto", F.coalesce(F.sum("n").over(within), F.lit(0))).join(first, ["length", "bucket"]).select(*names, (F.col("first") + F.col("upto")).alias("rank"), "n")
    if max((r["most"] for r in found), default=1) > copies:
        # A row for each so many equal pieces, dealt out before they become rows themselves.
        parts = ranked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(copies).cast("long"))).alias("at"))
        ranked = parts.select(*names, (F.col("rank") + F.col("at")).alias("rank"), F.least(F.col("n") - F.col("at"), F.lit(copies)).alias("n")).repartition("rank", "length")
    ranked = ranked.select(*names, F.explode(F.sequence("rank", F.col("rank") + F.col("n") - 1)).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            lengths, begin = np.unique(length[order], return_index=True)
            for n, part in zip(lengths, np.split(order, begin[1:]), strict=True):
                ranks, sequences, offsets = table[int(n)]
                at = np.searchsorted(ranks, rank[part], "right") - 1
                sequence[part] = sequences[at] + rank[part] - ranks[at]
                offset[part] = offsets[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PACKED)
