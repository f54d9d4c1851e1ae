"""Byte-level BPE as a monoid: encodings of neighbouring texts join into the encoding of both.

A text is cut into halves until they are short; the halves are encoded, and neighbours are joined up the tree. Two levels of a text need that.

*Tokens of one match.* A sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs: merges
across a boundary depend on nothing else, as every token of the vocabulary can be reached by merges (:func:`check`). So where two
encodings meet, the tokens at the boundary are encoded again in a window that grows, by twice as many tokens on the side that does not
hold yet, until the window's outer tokens go with their neighbours outside. Tokens outside have stabilised then.

*Matches of a text.* They are runs of one kind of characters, found for a whole text at once (:func:`match_starts`). The pattern reads from left to right and looks at most two characters beyond a match, so the matches of the left text that end two
characters before its end are those of the whole. The rest is matched again, into the right text, until a match ends where one of the
right text's own matches ends: what follows is as it was. A match that is made of whole old matches is joined from their tokens.

Texts beyond ``PART`` characters are dealt to tasks in parts; their elements join pairwise, ``FAN`` neighbours a task in each round, until one is
left. Decoding goes the same way: the bytes of halves are concatenated up the tree.

Defined results: a null or empty text has no ids; a text of any length is encoded whole, whatever it holds (very long words and runs of
white space included); strings of special tokens are ordinary text; repeated rows are encoded each; a null id is kept; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._store import bounded_batches, discard, materialize

TOKENIZER = "byte_bpe_multi_50k"
#: Characters of a leaf of the tree, of a part that is dealt, parts that join in one task and round.
LEAF, PART, FAN = 4096, 1 << 18, 8
#: Bytes of a match that are a leaf; characters of a match, and matches, that a worker remembers encodings of.
WHOLE, SHORT, REMEMBERED = 16, 64, 300_000

Ids = tuple[int, ...]


#: Kinds of characters: all else is 0.
LETTER, NUMBER, SPACE = 1, 2, 3


@lru_cache(maxsize=1)
def kinds() -> bytes:
    """The kind of each code point, packed. Libraries follow different versions of Unicode, so ``tiktoken`` is asked itself, once, on the driver."""
    import tiktoken

    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = np.zeros(0x110000, np.uint8)
    for number, kind in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        of_one = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        for a in range(0, len(every), 4096):
            found = bytes(of_one.encode_ordinary("".join(map(chr, every[a : a + 4096])))).decode()
            table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = number
    return zlib.compress(table.tobytes())


def match_starts(text: str, table: np.ndarray) -> np.ndarray:
    """Where the matches of ``public_tokenizers.PATTERN`` begin; each ends where the next one begins.

    Runs of one kind are the matches, but for three things. A blank before a run of letters, numbers or other marks belongs to it. Other white
    space is one match, without its last character if something follows, as that is either such a blank or a match of its own. An
    apostrophe that stands alone and no blank before it takes the letters of a contraction.
    """
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    kind = table[chars]
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    run = np.flatnonzero(first)
    space = kind[run] == SPACE
    inner = run[1:][space[:-1]] - 1  # the last characters of white space that something follows
    first[inner] = True
    blank = inner[chars[inner] == 0x20]
    first[blank + 1] = False
    quote = run[(chars[run] == 0x27)]
    quote = quote[first[quote] & (quote + 1 < n)]
    for at in quote[kind[quote + 1] == LETTER].tolist():
        tail = text[at + 1 : at + 3]
        size = 1 if tail[0] in "stmd" else 2 if tail in ("re", "ve", "ll") else 0
        if size:
            first[at + 1] = False
            if at + 1 + size < n:
                first[at + 1 + size] = True
    return np.flatnonzero(first)


class _Known(dict):
    """Encodings of matches that were seen, as bytes; others are made, and short ones kept."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, match: str) -> bytes:
        found = _bytes(self.make(match.encode()))
        if len(match) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[match] = found
        return found


def _bytes(ids: Ids) -> bytes:
    return np.array(ids, "<u4").tobytes() if len(ids) > 8 else b"".join(i.to_bytes(4, "little") for i in ids)


def _ids(data: bytes) -> Ids:
    return tuple(np.frombuffer(data, "<u4").tolist())


def lowest_first(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    """The tokens of ``data`` by merges of the lowest rank, the leftmost first: what the vocabulary means, without any library."""
    none = len(ranks)
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        found = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        if (best := min(found)) == none:
            break
        i = found.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Bpe:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], table: np.ndarray):
        import public_tokenizers
        import tiktoken

        self.bytes_of, self.table = {v: k for k, v in ranks.items()}, table
        #: Ranks of the merges of one short piece: the leaves of the tree and the windows between them.
        self.piece = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.known = _Known(self.encode_bytes)
        self.pairs: dict[tuple[int, int], Ids] = {}

    # Tokens of one match

    def merge(self, data: bytes) -> Ids:
        return tuple(self.piece(data))

    def pair(self, a: int, b: int) -> Ids:
        """The encoding of the bytes of two tokens: the two, where they go together."""
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.bytes_of[a] + self.bytes_of[b])
        return known

    def join_ids(self, a: Ids, b: Ids) -> Ids:
        """The encoding of the bytes of ``a`` and ``b``, which are encodings."""
        if not a or not b:
            return a + b
        window = self.pair(a[-1], b[0])
        if window == (a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            left = i == len(a) or self.pair(a[-i - 1], window[0]) == (a[-i - 1], window[0])
            right = j == len(b) or self.pair(window[-1], b[j]) == (window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i = i if left else min(2 * i, len(a))
            j = j if right else min(2 * j, len(b))
            window = self.merge(b"".join([self.bytes_of[t] for t in a[-i:] + b[:j]]))

    def encode_bytes(self, data: bytes) -> Ids:
        """The encoding of the bytes of a match, or of a part of one: of halves, joined."""
        if len(data) > WHOLE:
            half = len(data) // 2
            return self.join_ids(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))
        return self.merge(data)

    # Matches of a text

    def matches(self, text: str) -> list[str]:
        starts = match_starts(text, self.table).tolist()
        return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=False)]

    def element(self, text: str) -> Element:
        """The matches of ``text`` and their tokens: of halves, joined, where it is long."""
        if len(text) <= LEAF:
            found = self.matches(text)
            return Element(found, list(map(self.known.__getitem__, found)))
        half = len(text) // 2
        return self.join(self.element(text[:half]), self.element(text[half:]))

    def join(self, a: Element, b: Element) -> Element:
        """The element of both texts."""
        if not a.matches or not b.matches:
            return Element(a.matches + b.matches, a.ids + b.ids)
        # Matches that end less than two characters before the left text's end may read on; the last one does in any case.
        keep, open_chars = len(a.matches) - 1, len(a.matches[-1])
        while keep and open_chars < 2:
            keep -= 1
            open_chars += len(a.matches[keep])
        old, old_ids = a.matches[keep:], a.ids[keep:]
        took = step = 1
        while True:
            # The window grows over whole matches of the right text.
            found = self.matches("".join(chain(old, b.matches[:took])))
            met = self._meet(found, open_chars, b.matches[:took], took == len(b.matches))
            if met is not None:
                new, used = met
                ids = self._joined(found[:new], old + b.matches[:used], old_ids + b.ids[:used])
                return Element(a.matches[:keep] + found[:new] + b.matches[used:], a.ids[:keep] + ids + b.ids[used:])
            step *= 2
            took = min(took + step, len(b.matches))

    @staticmethod
    def _meet(found: list[str], start: int, right: list[str], whole: bool) -> tuple[int, int] | None:
        """How many new matches, and how many of the right text's, come before the first place in it where both end for certain."""
        ends, size = {start: 0}, start
        for j, m in enumerate(right):
            size += len(m)
            ends[size] = j + 1
        at = 0
        for i, m in enumerate(found):
            at += len(m)
            if not whole and at > size - 2:
                return None  # it may read beyond the window
            if at in ends:
                return i + 1, ends[at]
        return None

    def _joined(self, new: list[str], old: list[str], old_ids: list[bytes]) -> list[bytes]:
        """Tokens of new matches, joined where they are made of whole old ones."""
        out, k, at, end = [], 0, 0, 0
        for m in new:
            first, end = end, end + len(m)
            while k < len(old) and at < first:
                at += len(old[k])
                k += 1
            made, i, upto = (), k, at
            if at == first:
                while i < len(old) and upto < end:
                    made, upto, i = self.join_ids(made, _ids(old_ids[i])), upto + len(old[i]), i + 1
            out.append(_bytes(made) if at == first and upto == end else self.known[m])
        return out

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, four bytes each."""
        return b"".join(self.element(text).ids)

    def decode(self, ids: bytes) -> bytes:
        if len(ids) <= 4 * LEAF:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        half = len(ids) // 8 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Element(NamedTuple):
    """Matches of a text in order and the tokens of each: an element of the monoid, whose neutral one is empty."""

    matches: list[str]
    ids: list[bytes]

    def pack(self) -> tuple[str, bytes, bytes, bytes]:
        lengths, counts = ([len(x) for x in part] for part in self)
        return "".join(self.matches), np.array(lengths, "<u4").tobytes(), np.array(counts, "<u8").tobytes(), b"".join(self.ids)

    @classmethod
    def unpack(cls, text: str, lengths: bytes, counts: bytes, ids: bytes) -> Element:
        ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64).tolist()
        stops = np.cumsum(np.frombuffer(counts, "<u8"), dtype=np.int64).tolist()
        return cls([text[a:b] for a, b in zip([0, *ends], ends, strict=False)], [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)])


def _ranks(name: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def check(name: str) -> None:
    """Encodings join only where merges reach every token. Asked once, on the driver."""
    ranks = _ranks(name)
    if lost := sum(len(lowest_first(ranks, t)) > 1 for t in ranks):
        raise ValueError(f"{lost} tokens of {name} cannot be reached by merges, so encodings don't join")


@lru_cache(maxsize=2)
def vocabulary(name: str, table: bytes) -> Bpe:
    return Bpe(_ranks(name), np.frombuffer(zlib.decompress(table), np.uint8))


ELEMENT = "row long, k long, doc_id long, text string, lengths binary, counts binary, ids binary"


def _long(texts: DataFrame, tokenizer: str, table: bytes, part: int, fan: int) -> DataFrame:
    """doc_id, ids of long texts: their parts are encoded by many tasks and join in rounds."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                for k, a in enumerate(range(0, len(text), part)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([k]), batch.column(1).slice(i, 1), pa.array([text[a : a + part]])], ["row", "k", "doc_id", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer, table)
        for batch in batches:
            for r in batch.to_pylist():
                yield _record([(r["row"], r["k"], r["doc_id"], *bpe.element(r["text"]).pack())])

    def merge(group: pa.Table) -> pa.Table:
        bpe = vocabulary(tokenizer, table)
        rows = sorted(group.to_pylist(), key=lambda r: r["k"])
        level = [Element.unpack(r["text"], r["lengths"], r["counts"], r["ids"]) for r in rows]
        while len(level) > 1:
            level = [bpe.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return pa.Table.from_batches([_record([(rows[0]["row"], rows[0]["k"] // fan, rows[0]["doc_id"], *level[0].pack())])])

    # The row number is fixed by writing it.
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = materialize(numbered.mapInArrow(cut, "row long, k long, doc_id long, text string"))
    most = parts.agg(F.max("k").alias("k")).first()["k"]
    found = parts.repartition("row", "k").mapInArrow(encode, ELEMENT)
    while most:
        found = found.groupBy("row", F.expr(f"k div {fan}").alias("_to")).applyInArrow(merge, ELEMENT)
        most //= fan
    return found.select("doc_id", "ids")


def _record(rows: list[tuple]) -> pa.RecordBatch:
    row, k, doc_id, text, lengths, counts, ids = zip(*rows, strict=True)
    arrays = [pa.array(row, pa.int64()), pa.array(k, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(text, pa.string()), *(pa.array(c, pa.binary()) for c in (lengths, counts, ids))]
    return pa.RecordBatch.from_arrays(arrays, ["row", "k", "doc_id", "text", "lengths", "counts", "ids"])


def _encoded(docs: DataFrame, tokenizer: str, part: int, fan: int, finish, schema: str) -> DataFrame:
    """``finish`` of each document's id and ids."""
    bounded_batches(docs.sparkSession)
    check(tokenizer)
    table = kinds()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer, table)
        for batch in batches:
            yield finish(bpe, batch.column(0), (bpe.encode(t.as_py() or "") for t in batch.column(1)))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer, table)
        for batch in batches:
            for i in range(batch.num_rows):
                yield finish(bpe, batch.column(0).slice(i, 1), [batch.column(1)[i].as_py()])

    size = F.coalesce(F.length("text"), F.lit(0))
    rows = docs.select("doc_id", "text")
    made = rows.where(size <= part).mapInArrow(short, schema)
    if rows.where(size > part).limit(1).count():
        made = made.unionByName(_long(rows.where(size > part), tokenizer, table, part, fan).mapInArrow(joined, schema))
    return made


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, part: int = PART, fan: int = FAN) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) for each row of ``docs`` (doc_id, text)."""

    def finish(bpe: Bpe, doc_id: pa.Array, found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_id, pa.array(list(found), pa.binary())], ["doc_id", "ids"])

    return _encoded(docs, tokenizer, part, fan, finish, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, decoded (bytes) for each row of ``encoded`` (doc_id, ids)."""
    table = kinds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer, table)
        for batch in batches:
            out = [bpe.decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digest(docs: DataFrame, tokenizer: str = TOKENIZER, part: int = PART, fan: int = FAN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what :func:`encode` and then :func:`decode` give, as hashes, in one pass."""

    def finish(bpe: Bpe, doc_id: pa.Array, found) -> pa.RecordBatch:
        rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(bpe.decode(x)).hexdigest()) for x in found]
        n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([doc_id, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, tokenizer, part, fan, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
