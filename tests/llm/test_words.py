import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import SPACE, ascii_lower, hashed, shingles
from tidemark.llm import _words as W

texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab Ac\t\n\x0bé漢 .1-"), max_size=40)), max_size=8)


@settings(deadline=None, max_examples=150)
@given(texts)
def test_words_equal_regex(ts):
    got = [[] for _ in ts]
    for part in W.slices(pa.array(ts, pa.string()), max_bytes=16):
        w = W.words(part, W.SPACE_WORDS)
        raw = part.data.tobytes()
        for a, b, d, h in zip(w.start, w.end, w.doc, w.hash, strict=True):
            word = raw[a:b].decode()
            assert W.word_hash(word) == h
            got[part.first + d].append(word)
    assert got == [SPACE.findall(ascii_lower(t or "")) for t in ts]


@settings(deadline=None, max_examples=100)
@given(texts)
def test_shingle_counts(ts):
    assert [len(s) for s in hashed(ts)] == [len(shingles(t)) for t in ts]
