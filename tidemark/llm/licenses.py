"""License scans by template-markup matching.

Templates are license wordings with markup: ``<<beginOptional>> ... <<endOptional>>`` may be left out, and
``<<var;min;max>>`` stands for that many words of any kind. A template compiles to a token automaton; it accepts at a place where
all mandatory words stand exactly as worded, in order, with nothing between but what the markup allows. Automata start
only where one of their possible first words stands, found by hash over the whole batch and then compared as bytes.

Base finding: the places where the words of a plain phrase stand consecutively. Templates add labels ``template:NAME``.
The score is 1 where a template accepts, 0.5 with base phrases alone, else 0.

Defined results: a null or empty text has no words, null places, empty labels and score 0; repeated rows are scanned
each; a text of any length is scanned whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._store import bounded_batches
from tidemark.llm._words import ALNUM_WORDS, Texts, slices, word_hash, words

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wordings that licenses share.
_NO_LIABILITY = "in no event shall the <<var;1;8>> be liable for any "
_BSD_TERMS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<beginOptional>>1 <<endOptional>>redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<beginOptional>>2 <<endOptional>>redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
_BSD_END = "this software is provided by <<var;1;16>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software <<endOptional>>"
    "to deal in the software without restriction"
)

#: Notices and whole texts of public licenses, with markup.
TEMPLATES = {
    "mit": "<<beginOptional>>this software is <<endOptional>>released under the<<beginOptional>> terms of the<<endOptional>> mit license",
    "mit-grant": _MIT_GRANT,
    "mit-text": _MIT_GRANT
    + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice <<beginOptional>>including the next paragraph <<endOptional>>shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement " + _NO_LIABILITY + "claim damages or other liability whether in an action of contract tort or otherwise "
    "arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-2.0": "licensed under the apache license version 2 0<<beginOptional>> the license<<endOptional>>",
    "apache-2.0-grant": "you may not use this file except in compliance with the license",
    "apache-2.0-notice": "licensed under the apache license version 2 0 <<beginOptional>>the license <<endOptional>>you may not use this file except in compliance with the license "
    "you may obtain a copy of the license at http<<beginOptional>>s<<endOptional>> www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied",
    "gpl": "<<beginOptional>>this work is <<endOptional>>licensed under the<<beginOptional>> terms of the<<endOptional>> gnu<<beginOptional>> lesser<<endOptional>> general public license<<beginOptional>> version <<var;1;1>><<endOptional>>",
    "gpl-grant": "you can redistribute it and or modify it under the terms of the gnu<<beginOptional>> lesser<<endOptional>> general public license as published by the free software foundation",
    "gpl-notice": "you can redistribute it and or modify it under the terms of the gnu <<beginOptional>>lesser <<endOptional>>general public license as published by the free software foundation "
    "either version <<var;1;2>> of the license or <<beginOptional>>at your option <<endOptional>>any later version",
    "cc": "licensed under<<beginOptional>> a<<endOptional>> <<beginOptional>>the <<endOptional>>cc by<<beginOptional>> nc<<endOptional>><<beginOptional>> sa<<endOptional>><<beginOptional>> nd<<endOptional>> <<var;1;1>> 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that",
    "bsd-2-clause": _BSD_TERMS + _BSD_END,
    "bsd-3-clause": _BSD_TERMS + "<<beginOptional>>3 <<endOptional>>neither the name of <<var;1;12>> nor the names of <<beginOptional>>its <<endOptional>>contributors may be used "
    "to endorse or promote products derived from this software without specific prior written permission " + _BSD_END,
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
    "and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "rights": "copyright <<beginOptional>>c <<endOptional>><<var;1;8>> all rights reserved",
}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Automaton:
    """Edges by state: on a word, on any word (``None``), or on none at all (``free``)."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[str | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        at, opened = 0, []
        for mark, word in re.findall(r"<<([^>]*)>>|([0-9a-z\x80-\U0010ffff]+)", template.lower()):
            if word:
                at = self._step(at, word)
            elif mark == "beginoptional":
                opened.append(at)
            elif mark == "endoptional":
                self.free[opened.pop()].append(at)
            else:
                low, high = map(int, mark.split(";")[1:])
                for _ in range(low):
                    at = self._step(at, None)
                skip = [at]
                for _ in range(high - low):
                    at = self._step(at, None)
                    skip.append(at)
                for s in skip[:-1]:
                    self.free[s].append(at)
        if opened:
            raise ValueError("an optional region does not end")
        self.accept = at
        self.start = self._closed({0})
        if self.accept in self.start or any(w is None for s in self.start for w, _ in self.edges[s]):
            raise ValueError("a template begins with a mandatory or optional word")
        self.first = {w for s in self.start for w, _ in self.edges[s]}

    def _step(self, at: int, word: str | None) -> int:
        self.edges.append([])
        self.free.append([])
        self.edges[at].append((word, len(self.edges) - 1))
        return len(self.edges) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def accepts(self, at) -> bool:
        """``at(i)`` is the i-th word from the starting place, or None behind the last."""
        states, i = self.start, 0
        while states and self.accept not in states:
            word = at(i)
            if word is None:
                return False
            states = self._closed({t for s in states for w, t in self.edges[s] if w is None or w == word})
            i += 1
        return self.accept in states


@lru_cache(maxsize=4)
def _compiled(templates: tuple[tuple[str, str], ...]):
    automata = [(f"template:{name}", Automaton(text)) for name, text in templates]
    firsts: dict[str, list] = {}
    for label, a in automata:
        for word in a.first:
            firsts.setdefault(word, []).append((label, a))
    hashes = np.array(sorted(int(word_hash(w)) for w in firsts), np.uint64)
    return firsts, hashes


def scan_slice(texts: Texts, phrases: dict[str, str], templates: dict[str, str]) -> Iterator[tuple]:
    w = words(texts, ALNUM_WORDS)
    n = len(texts.offsets) - 1
    bounds = np.searchsorted(w.doc, np.arange(n + 1))
    raw = texts.data.tobytes()
    word = lambda i: raw[w.start[i] : w.end[i]].decode("utf-8", "replace")
    base: dict[int, list[tuple[int, str]]] = {}
    for phrase, label in phrases.items():
        parts = phrase.split()
        if len(w.hash) < len(parts):
            continue
        end = len(w.hash) - len(parts) + 1
        hit = w.doc[:end] == w.doc[len(parts) - 1 :]
        for j, p in enumerate(parts):
            hit &= w.hash[j : end + j] == word_hash(p)
        for i in np.flatnonzero(hit):
            if all(word(i + j) == p for j, p in enumerate(parts)):
                base.setdefault(int(w.doc[i]), []).append((int(i), label))
    found: dict[int, set[str]] = {}
    firsts, hashes = _compiled(tuple(templates.items()))
    near = np.searchsorted(hashes, w.hash)
    for i in np.flatnonzero(hashes[np.minimum(near, len(hashes) - 1)] == w.hash) if len(hashes) else ():
        d = int(w.doc[i])
        stop = bounds[d + 1]
        for label, automaton in firsts.get(word(i), ()):
            if label not in found.get(d, ()) and automaton.accepts(lambda k, i=i, stop=stop: word(i + k) if i + k < stop else None):
                found.setdefault(d, set()).add(label)
    for d in range(n):
        places = [i - int(bounds[d]) for i, _ in base.get(d, ())]
        plain = {label for _, label in base.get(d, ())}
        own = found.get(d, set())
        yield (int(bounds[d + 1] - bounds[d]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(plain)), ",".join(sorted(plain | own)), 1.0 if own else 0.5 if plain else 0.0)


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """License findings of ``docs`` (doc_id, text), a row each."""
    bounded_batches(docs.sparkSession)
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = [row for texts in slices(batch.column(1)) for row in scan_slice(texts, phrases, templates)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
