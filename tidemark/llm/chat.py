"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its assistant turns are
intersected with the sorted spans of its tokens by binary search. The mask is therefore exact to the character even
where a token straddles the end of a turn.

Template: ``<turn>ROLE\\nTEXT</turn>\\n`` per turn. Inside roles and texts a backslash becomes two and ``<`` becomes
``\\l`` (in roles a line feed becomes ``\\n``), so no control string can occur in them and :func:`parse` undoes it exactly.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of very many turns is encoded by many tasks. A task streams
its rows in order; what is rendered is flushed at a turn's end once it passes ``segment_chars``, so that memory is bounded by the longest
turn. The tokenizer never joins what stands on both sides of a turn's end, so the ids of a conversation's segments are those
of one pass over all of it. Only :func:`digest` brings a conversation together, since a hash reads its text in order: one task streams it.

Defined results: null text and null role are empty; rows with equal turn are ordered by role and text, repeated rows
are kept; rows with null turn come first; a null conv_id is a conversation of its own; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm._store import bounded_batches

OPEN, CLOSE = "<turn>", "</turn>\n"
LOSS_ROLE = "assistant"
TOKENIZER = "byte_bpe_50k"
SEGMENT_CHARS = 1 << 20
_TURN = re.compile(r"<turn>([^\n<]*)\n([^<]*)</turn>\n")
_ESCAPED = re.compile(r"\\([\\ln])")
_PLAIN = {"\\": "\\", "l": "<", "n": "\n"}

FORMATTED = "conv_id long, segment long, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"
READ = "conv_id long, segment long, n_turns long, turns string, loss string, formatted_chars long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<", "\\l")
    return text.replace("\n", "\\n") if role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of these turns, and where the texts that count for the loss stand in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns that :func:`render` got: role, text, and where the text stands."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        found.append((unescape(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    return found


def _touching(starts: np.ndarray, ends: np.ndarray, span: tuple[int, int]) -> slice:
    """The tokens that overlap a span, by binary search. Bytes of one character can be several tokens, each with its span."""
    a, b = span
    return slice(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))) if a < b else slice(0, 0)


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap one of the sorted ``spans``."""
    mask = np.zeros(len(starts), bool)
    for span in spans:
        mask[_touching(starts, ends, span)] = True
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
    """The characters of each span that the masked tokens cover. A span that they don't cover whole, or a masked
    token beside all spans, means that mask and offsets don't belong to this text."""
    out, used = [], np.zeros(len(mask), bool)
    for a, b in spans:
        if a == b:
            out.append("")
            continue
        near = _touching(starts, ends, (a, b))
        own = np.arange(near.start, near.stop)
        own = own[mask[own]]
        used[own] = True
        reach = np.maximum.accumulate(np.concatenate(([a], ends[own])))
        if not len(own) or (starts[own] > reach[:-1]).any() or reach[-1] < b:
            raise ValueError(f"the mask doesn't cover characters {a} to {b}")
        out.append(formatted[max(a, int(starts[own[0]])) : min(b, int(reach[-1]))])
    if (mask & ~used).any():
        raise ValueError(f"the mask covers token {int(np.flatnonzero(mask & ~used)[0])} outside all spans")
    return out


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    t.encode_special_tokens = True
    return t


def format_chats(conversations: DataFrame, tokenizer: str = TOKENIZER, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per segment of a conversation (mostly its only one); the numbers of a conversation's segments follow its turns."""
    bounded_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            conv, segment, text, ids, start, end, mask = zip(*rows, strict=True)
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            listed = lambda parts, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), kind))
            cols = [pa.array(conv, pa.int64()), pa.array(segment, pa.int64()), pa.array(text, pa.string()), *(listed(x, pa.int32()) for x in (ids, start, end)), listed(mask, pa.bool_())]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "segment", "formatted", "input_ids", "token_start", "token_end", "loss_mask"])

        def close(conv: int | None, turns: list) -> None:
            nonlocal number
            text, spans = render(turns)
            code = encoder.encode(text, add_special_tokens=False)
            places = np.array(code.offsets, np.int64).reshape(-1, 2)
            rows.append((conv, number, text, np.array(code.ids, np.int64), places[:, 0], places[:, 1], align(places[:, 0], places[:, 1], spans)))
            number += 1

        conv, turns, size, pending = None, [], 0, 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                role, text = role or "", text or ""
                if turns and (c != conv or size >= segment_chars):
                    close(conv, turns)
                    pending += size
                    turns, size = [], 0
                conv = c
                turns.append((role, text))
                size += len(role) + len(text)
                if rows and (pending >= segment_chars or len(rows) >= 256):
                    yield flush()
                    pending = 0
        if turns:
            close(conv, turns)
        if rows:
            yield flush()

    key = ["conv_id", "turn", "role", "text"]
    ordered = conversations.select(*key).repartitionByRange(*key).sortWithinPartitions(*key)
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per segment of :func:`format_chats`: its turns from the text, and the loss text from the mask and the offsets of the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            flat = [batch.column(n) for n in ("token_start", "token_end", "loss_mask")]
            for i, text in enumerate(batch.column("formatted").to_pylist()):
                turns = parse(text)
                start, end, mask = (c[i].values.to_numpy(zero_copy_only=False) for c in flat)
                spans = [(a, b) for role, _, a, b in turns if role == LOSS_ROLE]
                loss = "".join(map(unescape, masked_text(text, start, end, mask, spans)))
                out.append((len(turns), "".join(f"{role}\n{said}\n" for role, said, _, _ in turns), loss, len(text)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            made = [pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), *made], ["conv_id", "segment", "n_turns", "turns", "loss", "formatted_chars"])

    return formatted.select("conv_id", "segment", "formatted", "token_start", "token_end", "loss_mask").mapInArrow(run, READ)


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back of each conversation, as counts and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        conv, state = None, None
        names, types = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        ended = lambda: (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for batch in batches:
            out: list[tuple] = []
            for c, n, said, loss, chars in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "n_turns", "turns", "loss", "formatted_chars")), strict=True):
                if state is not None and c != conv:
                    out.append(ended())
                    state = None
                conv, state = c, state or new()
                state[0] += n
                state[1].update(said.encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(ended(), types, strict=True)], names)

    ordered = read_back(formatted).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, DIGEST)
