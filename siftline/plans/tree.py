"""Query trees: phrases and keywords under And and Or, with filters on any node."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

Starts = Callable[[tuple[str, ...]], Column]


class QueryNode:
    """A condition on one sentence.

    Subclasses give the leaves' phrases, whether a sentence matches, and the token ranges to
    highlight; so one may define its own.
    """

    def __init__(self) -> None:
        self.document_filter: Column | str | None = None
        self.sentence_filter: Column | str | None = None

    def children(self) -> tuple[QueryNode, ...]:
        return ()

    def phrases(self) -> tuple[tuple[str, ...], ...]:
        """The phrases of this node itself."""
        return ()

    def matches(self, found: Starts, flag: Callable[[QueryNode], Column]) -> Column:
        raise NotImplementedError

    def spans(self, found: Starts, span: Callable[[tuple[str, ...]], Column], flag: Callable[[QueryNode], Column]) -> list[Column]:
        """Arrays of highlighted ranges, of this node if it matches."""
        raise NotImplementedError

    def __and__(self, other: QueryNode) -> QueryNode:
        return And(self, other)

    def __or__(self, other: QueryNode) -> QueryNode:
        return Or(self, other)

    def filter_documents(self, condition: Column | str) -> QueryNode:
        """The node for documents alone whose metadata meet the condition."""
        made = copy.copy(self)
        made.document_filter = _both(self.document_filter, condition)
        return made

    def filter_sentences(self, condition: Column | str) -> QueryNode:
        """The node for sentences alone whose text or metadata meet the condition; of the whole query only."""
        made = copy.copy(self)
        made.sentence_filter = _both(self.sentence_filter, condition)
        return made

    def walk(self) -> Iterator[QueryNode]:
        yield self
        for child in self.children():
            yield from child.walk()


def _both(first: Column | str | None, second: Column | str) -> Column:
    new = F.expr(second) if isinstance(second, str) else second
    if first is None:
        return new
    return (F.expr(first) if isinstance(first, str) else first) & new


class Terms(QueryNode):
    """The terms from which phrases or keywords are made."""

    def __init__(self, *terms: str) -> None:
        super().__init__()
        self.terms = tuple(terms)

    def phrased(self) -> Phrase:
        return Phrase(*self.terms)

    def keywords(self) -> Keywords:
        return Keywords(*self.terms)


class Phrase(Terms):
    """All terms, in this order, side by side.  No terms match nothing."""

    def phrases(self) -> tuple[tuple[str, ...], ...]:
        return (self.terms,) if self.terms else ()

    def matches(self, found: Starts, flag: Callable[[QueryNode], Column]) -> Column:
        return (F.size(found(self.terms)) > 0) & flag(self) if self.terms else F.lit(False)

    def spans(self, found: Starts, span: Callable[[tuple[str, ...]], Column], flag: Callable[[QueryNode], Column]) -> list[Column]:
        return [_if(flag(self), span(self.terms))] if self.terms else []

    def __repr__(self) -> str:
        return f"Phrase({' '.join(self.terms)})"


class Keywords(Terms):
    """Any of the terms."""

    def phrases(self) -> tuple[tuple[str, ...], ...]:
        return tuple((t,) for t in dict.fromkeys(self.terms))

    def matches(self, found: Starts, flag: Callable[[QueryNode], Column]) -> Column:
        any_ = F.lit(False)
        for p in self.phrases():
            any_ = any_ | (F.size(found(p)) > 0)
        return any_ & flag(self)

    def spans(self, found: Starts, span: Callable[[tuple[str, ...]], Column], flag: Callable[[QueryNode], Column]) -> list[Column]:
        return [_if(flag(self), span(p)) for p in self.phrases()]

    def __repr__(self) -> str:
        return f"Keywords({' '.join(self.terms)})"


class _Several(QueryNode):
    def __init__(self, *nodes: QueryNode) -> None:
        super().__init__()
        if not nodes:
            raise ValueError("a node at least")
        self.nodes = nodes

    def children(self) -> tuple[QueryNode, ...]:
        return self.nodes

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(map(repr, self.nodes))})"


class And(_Several):
    """A sentence that all nodes match; otherwise nothing of it is highlighted on its behalf."""

    def matches(self, found: Starts, flag: Callable[[QueryNode], Column]) -> Column:
        all_ = flag(self)
        for n in self.nodes:
            all_ = all_ & n.matches(found, flag)
        return all_

    def spans(self, found: Starts, span: Callable[[tuple[str, ...]], Column], flag: Callable[[QueryNode], Column]) -> list[Column]:
        whole = self.matches(found, flag)
        return [_if(whole, s) for n in self.nodes for s in n.spans(found, span, flag)]


class Or(_Several):
    """A sentence that any node matches."""

    def matches(self, found: Starts, flag: Callable[[QueryNode], Column]) -> Column:
        any_ = F.lit(False)
        for n in self.nodes:
            any_ = any_ | n.matches(found, flag)
        return any_ & flag(self)

    def spans(self, found: Starts, span: Callable[[tuple[str, ...]], Column], flag: Callable[[QueryNode], Column]) -> list[Column]:
        return [_if(flag(self), s) for n in self.nodes for s in n.spans(found, span, flag)]


def _if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def flat(node: QueryNode) -> QueryNode:
    """The tree with nested nodes of a kind joined, which changes no result."""
    if not isinstance(node, _Several):
        return node
    nodes: list[QueryNode] = []
    for child in map(flat, node.nodes):
        plain = child.document_filter is None and child.sentence_filter is None
        nodes.extend(child.children() if type(child) is type(node) and plain else [child])
    made = copy.copy(node)
    made.nodes = tuple(nodes)
    return made
