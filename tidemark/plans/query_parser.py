"""The query grammar: AND, OR, NOT, + and -, "phrases", field:term, field:[a TO b], word~edits, ^boost, parentheses.

A query becomes a small tree on the driver; :mod:`tidemark.operators.text_search` turns the tree into a DataFrame plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tidemark.errors import QueryError

_PART = re.compile(r"""\s*(?:(?P<op>[()+-])|(?P<range>(?P<rf>\w+):\[\s*(?P<lo>\S+)\s+TO\s+(?P<hi>[^\]\s]+)\s*\])|(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s()"^]+))|\^(?P<boost>\d+(?:\.\d+)?))""")

_NEAR = re.compile(r"([^~]+)~(\d?)")


@dataclass(frozen=True)
class Term:
    text: str
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy:
    """Any term within ``distance`` edits."""

    text: str
    distance: int = 2
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase:
    text: str
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Range:
    field: str
    low: str
    high: str
    boost: float = 1.0


@dataclass(frozen=True)
class Bool:
    must: tuple = field(default=())
    should: tuple = field(default=())
    must_not: tuple = field(default=())
    boost: float = 1.0


Node = Term | Fuzzy | Phrase | Range | Bool


def _scan(query: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    at = 0
    while at < len(query.rstrip()):
        m = _PART.match(query, at)
        if m is None or m.end() == at:
            raise QueryError(f"can't read {query[at:]!r}")
        at = m.end()
        if m["op"]:
            out.append((m["op"], None))
        elif m["range"]:
            out.append(("leaf", Range(m["rf"], m["lo"], m["hi"])))
        elif m["phrase"] is not None:
            out.append(("leaf", Phrase(m["phrase"], m["field"])))
        elif m["boost"]:
            out.append(("^", float(m["boost"])))
        elif m["word"] in ("AND", "OR", "NOT") and not m["field"]:
            out.append((m["word"], None))
        elif near := _NEAR.fullmatch(m["word"]):
            out.append(("leaf", Fuzzy(near[1], int(near[2] or 2), m["field"])))
        else:
            out.append(("leaf", Term(m["word"], m["field"])))
    return out


class _Parser:
    def __init__(self, parts: list[tuple[str, object]], conjunctive: bool):
        self.parts, self.at, self.conjunctive = parts, 0, conjunctive

    def peek(self) -> str | None:
        return self.parts[self.at][0] if self.at < len(self.parts) else None

    def take(self):
        self.at += 1
        return self.parts[self.at - 1]

    def expression(self) -> Node:
        """AND binds more tightly than OR; parts without an operator between them join by the default."""
        groups: list[list[tuple[str, Node]]] = [[]]
        joined = False
        while (kind := self.peek()) not in (None, ")"):
            if kind in ("AND", "OR"):
                self.take()
                if not groups[-1]:
                    raise QueryError(f"{kind} needs something before it")
                if kind == "OR":
                    groups.append([])
                joined = kind == "AND"
                continue
            sign = ""
            if kind in ("+", "-", "NOT"):
                sign = "-" if kind in ("-", "NOT") else "+"
                self.take()
            node = self.atom()
            if joined:
                last_sign, last = groups[-1][-1]
                groups[-1][-1] = (last_sign or "+", last)
                sign = sign or "+"
            elif not sign and self.conjunctive:
                sign = "+"
            groups[-1].append((sign, node))
            joined = False
        if joined or not groups[-1]:
            raise QueryError("the query ends where something must follow")
        nodes = [self.group(g) for g in groups]
        return nodes[0] if len(nodes) == 1 else Bool(should=tuple(nodes))

    def group(self, parts: list[tuple[str, Node]]) -> Node:
        if len(parts) == 1 and parts[0][0] != "-":
            return parts[0][1]
        pick = lambda s: tuple(n for t, n in parts if t == s)
        return Bool(pick("+"), pick(""), pick("-"))

    def atom(self) -> Node:
        kind, value = self.take() if self.peek() else (None, None)
        if kind == "(":
            node = self.expression()
            if self.peek() != ")":
                raise QueryError("a parenthesis isn't closed")
            self.take()
        elif kind == "leaf":
            node = value
        else:
            raise QueryError(f"{kind or 'the end'} stands where a term must be")
        if self.peek() == "^":
            boost = self.take()[1]
            node = type(node)(**{**node.__dict__, "boost": node.boost * boost})
        return node


def parse(query: str, conjunctive: bool = False) -> Node:
    """The tree of ``query``; ``conjunctive``: parts without an operator must all match."""
    parts = _scan(query)
    if not parts:
        raise QueryError("the query is empty")
    p = _Parser(parts, conjunctive)
    node = p.expression()
    if p.peek() is not None:
        raise QueryError("a parenthesis closes nothing")
    return node
