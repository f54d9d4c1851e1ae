import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import SF, ascii_lower, docs, edge_rows
from tidemark.llm import chat, licenses, packing
from tidemark.llm.queries import PROBE_CHAT, op3_chat_formatting


def check_packing(spark, d, rows):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            wanted[i, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    got = packing.pack(d).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == wanted
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(k[2] * n for k, n in wanted.items()) / (2048 * len(by))


def test_packing(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(packing, "RANK_BUCKET", 37)
    assert check_packing(spark, d, [(r["doc_id"], r["text"]) for r in d.collect()]) > 0.99


def test_packing_edges(spark):
    rows = [*edge_rows(), (9, "x <|endoftext|> y", None, None)]
    rows += [(10 + i, f"{a}{c * 2_000_000}{a}", None, None) for i, c in enumerate(" \t\n\u3000") for a in ("", "x")][:8]
    check_packing(spark, docs(spark, rows), [(i, t) for i, t, _, _ in rows])
    assert packing.pack(docs(spark, rows).where("false")).count() == 0


def test_packing_of_copies(spark):
    """A third of all rows are one document: its pieces are dealt out as counts."""
    rows = [(1, "the same words " * 40, None, None)] * 500 + [(i, f"document {i} " * (i % 90), None, None) for i in range(1000)] + [(None, "no id", None, None)] * 30
    d = docs(spark, rows).repartition(4)
    check_packing(spark, d, [(i, t) for i, t, _, _ in rows])
    plain = Counter(tuple(r) for r in packing.pack(d).collect())
    assert Counter(tuple(r) for r in packing.pack(d.repartition(3), copies=7).collect()) == plain


@settings(deadline=None, max_examples=200)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_histogram_packing(counts):
    patterns = packing.pack_histogram(counts, 64)
    used = Counter()
    for n, pattern in patterns:
        assert n > 0 and sum(a * b for a, b in pattern) <= 64
        for a, b in pattern:
            used[a] += n * b
    assert used == Counter(counts)
    for length, (ranks, sequences, offsets) in packing.slots(patterns).items():
        assert ranks[0] == 0 and len(sequences) == len(offsets) and (np.diff(ranks) > 0).all() and ranks[-1] < counts[length]


def digest(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


TURNS = st.lists(st.tuples(st.one_of(st.just("assistant"), st.text("a<\n\\ln", max_size=5)), st.text(max_size=40)), max_size=5)


def encoded(text):
    code = chat._tokenizer("byte_bpe_50k").encode(text, add_special_tokens=False)
    return code.ids, *np.array(code.offsets, int).reshape(-1, 2).T


@settings(deadline=None, max_examples=200)
@given(TURNS)
def test_chat_round_trip(turns):
    text, spans = chat.render(turns)
    assert [(r, t) for r, t, _, _ in chat.parse(text)] == turns
    _, start, end = encoded(text)
    mask = chat.align(start, end, spans)
    assert mask.tolist() == [any(s < b and e > a for a, b in spans) for s, e in zip(start, end, strict=True)]
    assert "".join(map(chat.unescape, chat.masked_text(text, start, end, mask, spans))) == "".join(t for r, t in turns if r == "assistant")


@settings(deadline=None, max_examples=100)
@given(TURNS)
def test_segments_encode_as_one(turns):
    """Turns encoded each for itself have the ids of one pass over the conversation."""
    assert [i for t in turns for i in encoded(chat.render([t])[0])[0]] == list(encoded(chat.render(turns)[0])[0])


def test_mask_and_offsets_make_the_loss_text():
    text, spans = chat.render([("user", "what is it"), ("assistant", "a plain answer of some words"), ("user", "thanks"), ("assistant", "bye then")])
    _, start, end = encoded(text)
    mask = chat.align(start, end, spans)
    read = lambda s, e, m: chat.masked_text(text, s, e, m, spans)
    assert read(start, end, mask) == ["a plain answer of some words", "bye then"]
    for shift in (-3, 3):
        with pytest.raises(ValueError, match="mask"):
            read(start + shift, end + shift, mask)
    for i in range(len(mask)):  # a bit more or less is seen
        other = mask.copy()
        other[i] = ~other[i]
        with pytest.raises(ValueError, match="mask"):
            read(start, end, other)


def test_one_huge_conversation(spark):
    """Most rows are one conversation, one turn is very long: ranges deal them, the result is the plain one."""
    rows = [(5, i, ("user", "assistant")[i % 2], f"turn {i} <b> \\ é漢🙂") for i in range(3000)] + [(5, 3000, "assistant", "word " * 300_000)] + [(100 + i, 0, "assistant", f"x{i}") for i in range(200)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    formatted = chat.format_chats(c, segment_chars=2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few MB would be one task's
    try:
        assert formatted.where("conv_id = 5").select(F.shiftright("segment", 32).alias("task")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(formatted).collect()}
    assert got[5] == digest([(r, t) for c_, _, r, t in rows if c_ == 5]) and len(got) == 201
    assert got[107] == digest([("assistant", "x7")])


def test_chats(spark):
    got = {r["conv_id"]: r for r in op3_chat_formatting(spark, SF).collect()}
    turns = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-7] = [("user", PROBE_CHAT), ("assistant", PROBE_CHAT)]
    assert set(got) == set(turns)
    for c, t in turns.items():
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == digest(t)
        assert got[c]["formatted_chars"] == len(chat.render(t)[0])


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|endoftext|> é漢🙂" * 50), (1, 2, None, "x"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (None, 0, "user", "n"), (3, None, "user", "first"), (3, 0, "user", "then"), (4, 0, "assistant", "")]
    c = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, last int")
    for segment in (1 << 20, 5):  # whole conversations, and a segment per turn
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(chat.format_chats(c, segment_chars=segment)).collect()}
        assert got[1] == digest([("user", ""), ("assistant", "<|endoftext|> é漢🙂" * 50), ("", "x")])
        assert got[2] == digest([("assistant", "a"), ("assistant", "b"), ("assistant", "b")])
        assert got[3] == digest([("user", "first"), ("user", "then")]) and got[None] == digest([("user", "n")]) and got[4] == digest([("assistant", "")])
    assert chat.digest(chat.format_chats(c.where("false"))).count() == 0


def scan_plainly(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base(spark):
    extra = [(100_000 + i, t, None, None) for i, t in enumerate(["MIT License mit-license MIT  LICENSE", "the general public license apache\nlicense", "mit", None, "", "smit license", "mit licensé", "MIT license " * 3000])]
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(docs(spark, [*extra, *edge_rows()]).select("doc_id", "text"))
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(d).collect())
    assert got == Counter((r["doc_id"], *scan_plainly(r["text"])) for r in d.collect())
    for r in licenses.scan(d).collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(d.where("false")).count() == 0


def plain_template(template):
    """A template as a regular expression over words that blanks part."""
    out = ""
    for mark, word in re.findall(r"<<([^>]*)>>|([0-9a-z]+)", template.lower()):
        if word:
            out += f" {word}(?= )"
        elif mark == "beginoptional":
            out += "(?:"
        elif mark == "endoptional":
            out += ")?"
        else:
            out += "(?: [^ ]+){%s,%s}" % tuple(mark.split(";")[1:])
    return re.compile(out)


def filled(template, rng):
    """A text that the template accepts."""
    keep, out = [True], []
    for mark, word in re.findall(r"<<([^>]*)>>|([0-9a-z]+)", template.lower()):
        if mark == "beginoptional":
            keep.append(keep[-1] and bool(rng.integers(2)))
        elif mark == "endoptional":
            keep.pop()
        elif keep[-1]:
            low, high = map(int, mark.split(";")[1:]) if mark else (0, 0)
            out += [word] if word else [f"x{k}" for k in range(rng.integers(low, high + 1))]
    return out


def test_labels_equal_regular_expressions(spark):
    rng = np.random.default_rng(12)
    texts = []
    for template in licenses.TEMPLATES.values():
        for _ in range(6):
            w = filled(template, rng)
            texts.append("some words " + ", ".join(w).title() + ".\nand more")
            w[rng.integers(len(w))] = "other"  # mandatory wording that differs, or a word in a replaceable region
            texts.append(" ".join(w))
            del w[rng.integers(len(w))]
            texts.append(" ".join(w))
    d = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]).select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 10_000, "text"))
    plain = {f"template:{n}": plain_template(t) for n, t in licenses.TEMPLATES.items()}
    text_of, seen = {r["doc_id"]: r["text"] for r in d.collect()}, Counter()
    for r in licenses.scan(d).collect():
        joined = f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', ascii_lower(text_of[r['doc_id']] or '')))} "
        wanted = {n for n, p in plain.items() if p.search(joined)} | set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == wanted
        seen.update(wanted)
    assert all(seen[n] >= 3 for n in plain)


@pytest.mark.parametrize(
    ("text", "accepted"),
    [("released under the mit license", True), ("This software is released under the terms of the MIT License!", True), ("released under mit license", False), ("released under the old mit license", False)],
)
def test_template(spark, text, accepted):
    r = licenses.scan(docs(spark, [(1, text, None, None)])).first()
    assert ("template:mit" in r["labels"].split(",")) == accepted


def test_automaton():
    a = licenses.Automaton("copyright <<var;1;3>> all rights<<beginOptional>> are<<beginOptional>> hereby<<endOptional>><<endOptional>> reserved")
    ok = lambda s: a.accepts(lambda i: dict(enumerate(s.split())).get(i))
    assert ok("copyright x all rights reserved") and ok("copyright a b c all rights are hereby reserved more") and ok("copyright a b all rights are reserved")
    assert not ok("copyright all rights reserved") and not ok("copyright a b c d all rights reserved") and not ok("copyright x all rights hereby reserved") and not ok("copyright x all rights")
    with pytest.raises(ValueError, match="begins"):
        licenses.Automaton("<<var;1;2>> x")
    with pytest.raises(ValueError, match="does not end"):
        licenses.Automaton("x <<beginOptional>> y")
