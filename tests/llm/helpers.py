import re

import pyarrow as pa

from tidemark.llm import _words as W

SF = "/root/testdata/sf0.01"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, node string, size string, target string, label string, host string"
#: Names that operators would choose for columns of their own.
OWN = {f"__{n}": f"own {n}" for n in ("row", "old", "host", "lines", "k1", "k2", "n", "times", "more", "rank", "bucket", "first")}
DOCS += "".join(f", {n} string" for n in OWN)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def docs(spark, rows):
    """(doc_id, text, lang, source) with further columns whose names operators might use themselves."""
    full = [(i, t, lang, s, None if t is None else len(t), 1, "a", "b", "c", "d", "e", *OWN.values()) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


def edge_rows():
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one", "de", None), (5, "Ünï çödé 漢字 🙂 x", "fr", "b"), (6, long, "en", "b"), (7, "same text here " * 30, "en", "a"), (7, "same text here " * 30, "en", "a"), (None, "no id", "es", "c"), (8, "###$$$", "en", "c")]


def shingles(text, width=5):
    w = SPACE.findall(ascii_lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def hashed(texts):
    return [s for part in W.slices(pa.array(texts, pa.string())) for s in W.shingle_sets(part)]
