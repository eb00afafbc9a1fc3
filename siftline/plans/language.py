r"""The query language.

    query   := and
    and     := or (AND or)*          AND, and, &&
    or      := atom (OR atom)*       OR, or, || bind tighter than AND
    atom    := "quoted text" | word+ | ( and )

Words side by side are one phrase.  Quoted text may hold \t \u \n \" (which aren't decoded) and no
other backslash.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from siftline.plans.tree import And, Or, Phrase, QueryNode

_TOKEN = re.compile(r'\s*(?:(?P<quoted>"(?:[^"\\]|\\[tun"])*")|(?P<word>[^"\s()]+)|(?P<paren>[()]))')
_OPERATORS = {"AND": "and", "and": "and", "&&": "and", "OR": "or", "or": "or", "||": "or"}


class QuerySyntaxError(ValueError):
    """A query that isn't of the language; ``position`` is where."""

    def __init__(self, message: str, position: int) -> None:
        super().__init__(f"{message} at {position}")
        self.position = position


def lex(query: str) -> list[tuple[str, str, int]]:
    """Kind, text and position of each token."""
    out, at = [], 0
    while query[at:].strip():
        m = _TOKEN.match(query, at)
        if m is None:
            raise QuerySyntaxError("no token", at)
        kind, text = str(m.lastgroup), m.group(str(m.lastgroup))
        if kind == "word":
            kind = _OPERATORS.get(text, "word")
        elif kind == "paren":
            kind = text
        else:
            text = text[1:-1]
        out.append((kind, text, m.end()))
        at = m.end()
    return out


class _Parser:
    def __init__(self, query: str, analyze: Callable[[str], list[str]]) -> None:
        self.tokens, self.analyze, self.at, self.end = lex(query), analyze, 0, len(query)

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def fail(self, message: str) -> QuerySyntaxError:
        return QuerySyntaxError(message, self.tokens[self.at][2] if self.at < len(self.tokens) else self.end)

    def whole(self) -> QueryNode:
        node = self.all_of()
        if self.kind() != "end":
            raise self.fail("an operator is missing")
        return node

    def _chain(self, operator: str, part: Callable[[], QueryNode], join: type[And] | type[Or]) -> QueryNode:
        node = part()
        while self.kind() == operator:
            self.at += 1
            node = join(node, part())
        return node

    def all_of(self) -> QueryNode:
        return self._chain("and", self.any_of, And)

    def any_of(self) -> QueryNode:
        return self._chain("or", self.atom, Or)

    def atom(self) -> QueryNode:
        kind = self.kind()
        if kind == "(":
            self.at += 1
            node = self.all_of()
            if self.kind() != ")":
                raise self.fail("a parenthesis is missing")
            self.at += 1
            return node
        if kind == "quoted":
            self.at += 1
            return Phrase(*self.analyze(self.tokens[self.at - 1][1]))
        first = self.at
        while self.kind() == "word":
            self.at += 1
        if first == self.at:
            raise self.fail("a phrase is missing")
        return Phrase(*self.analyze(" ".join(t for _, t, _ in self.tokens[first : self.at])))


def parse(query: str, analyze: Callable[[str], list[str]]) -> QueryNode:
    """The tree of a query as written; raises :class:`QuerySyntaxError`."""
    return _Parser(query, analyze).whole()
