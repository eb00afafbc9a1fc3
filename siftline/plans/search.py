"""From a query tree to one lazy DataFrame.

Index plan: the postings of all the query's terms, in one pruned scan, are grouped by sentence in one
shuffle, whatever the tree; matching sentences fetch their text last.  Scan plan: the same
columns over the sentences' term arrays, without a shuffle; filters that hold for the whole query are
applied before the texts of a lazy database are analysed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import highlight
from siftline.plans.tree import And, QueryNode, flat
from siftline.sources.index import Index


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _places(stem: str) -> Column:
    """Where a sentence's term array holds the term."""
    return F.filter(F.sequence(F.lit(0), F.size("stems") - 1), lambda i: F.get("stems", i) == stem)


def _grouped(stem: str) -> Column:
    """Where a sentence holds the term by its postings, which are several where an id was allowed to occur twice."""
    return F.sort_array(F.flatten(F.transform(F.filter("_found", lambda f: f.stem == stem), lambda f: f.positions)))


def _starts(phrase: tuple[str, ...], positions: dict[str, Column]) -> Column:
    """Sorted places at which the phrase begins; overlapping matches of itself are left out."""
    found = positions[phrase[0]]
    for i, stem in enumerate(phrase[1:], 1):
        found = F.array_intersect(found, _moved(positions[stem], i))
    return highlight.leftmost(found, len(phrase)) if highlight.overlaps_itself(phrase) else found


def _filters(node: QueryNode) -> tuple[list[Column], dict[int, Column]]:
    """Document filters that hold for all results, and those of single branches by node."""
    whole: list[Column] = []
    branch: dict[int, Column] = {}

    def visit(n: QueryNode, every: bool) -> None:
        if n.document_filter is not None:
            condition = F.expr(n.document_filter) if isinstance(n.document_filter, str) else n.document_filter
            if every:
                whole.append(condition)
            else:
                branch[id(n)] = condition
        for c in n.children():
            visit(c, every and isinstance(n, And))

    visit(node, True)
    return whole, branch


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _matching(index: Index, node: QueryNode, indexed: bool) -> tuple[DataFrame, dict[tuple[str, ...], str], dict[int, str]]:
    """Matching sentences with a column of starts for each phrase and one for each branch's filter."""
    phrases = list(dict.fromkeys(p for n in node.walk() for p in n.phrases()))
    stems = list(dict.fromkeys(s for p in phrases for s in p))
    whole, branch = _filters(node)
    base = index.postings.where(F.col("stem").isin(stems)) if indexed else index.sentences
    if whole and not indexed and index.sentences_of is not None:
        base = index.sentences_of(_all(whole))
    elif whole:
        base = base.join(index.doc_meta.where(_all(whole)).select("doc_id"), "doc_id", "left_semi")
    if not stems:
        base = base.where("false")
    nothing = F.array().cast("array<int>")
    if indexed:
        base = base.groupBy("doc_id", "sentence_idx").agg(F.collect_list(F.struct("stem", "positions")).alias("_found"))
        positions = {s: _grouped(s) for s in stems}
    else:
        base = base.where(F.arrays_overlap("stems", F.array(*map(F.lit, stems)))) if stems else base
        positions = {s: F.when(F.array_contains("stems", s), _places(s)).otherwise(nothing) for s in stems}
    names = {p: f"_p{i}" for i, p in enumerate(phrases)}
    keep = ["doc_id", "sentence_idx"] if indexed else index.sentences.columns
    base = base.select(*keep, *[_starts(p, positions).alias(n) for p, n in names.items()])
    flags = {n: f"_f{i}" for i, n in enumerate(branch)}
    if branch:
        base = base.join(index.doc_meta.select("doc_id", *[F.coalesce(branch[n], F.lit(False)).alias(c) for n, c in flags.items()]), "doc_id")
    found = base.where(node.matches(lambda p: F.col(names[p]), lambda n: F.col(flags[id(n)]) if id(n) in flags else F.lit(True)))
    return found, names, flags


def search(index: Index, node: QueryNode, plan: str = "auto", optimize: bool = True, ids: bool = False) -> DataFrame:
    """``(doc_id, sentence_idx, text, highlights, ...)`` of the matching sentences, in no order.

    ``plan``: ``index``, ``scan``, or ``auto`` for the index where there is one.  With ``ids`` the first two
    columns alone, for which the index plan reads no sentences unless a filter needs them.
    """
    node = flat(node) if optimize else node
    indexed = index.postings is not None if plan == "auto" else plan == "index"
    if indexed and index.postings is None:
        raise ValueError("nothing is indexed; build with a path, or scan")
    found, names, flags = _matching(index, node, indexed)
    if indexed and not (ids and node.sentence_filter is None):
        found = found.join(index.sentences, ["doc_id", "sentence_idx"])
    if any(n.sentence_filter is not None for c in node.children() for n in c.walk()):
        raise ValueError("a sentence filter belongs to the whole query")
    if node.sentence_filter is not None:
        found = found.where(node.sentence_filter)
    if ids:
        return found.select("doc_id", "sentence_idx")

    def span(phrase: tuple[str, ...]) -> Column:
        last = len(phrase) - 1
        return F.transform(F.col(names[phrase]), lambda s: F.struct(F.get("tokens", s)["start"].alias("start"), F.get("tokens", s + last)["end"].alias("end")))

    spans = node.spans(lambda p: F.col(names[p]), span, lambda n: F.col(flags[id(n)]) if id(n) in flags else F.lit(True))
    none = F.array().cast(highlight.RANGES)
    # ranges of one phrase are in order and apart already
    shown = none if not spans else spans[0] if len(spans) == 1 else highlight.collapse(F.concat(*spans))
    others = [c for c in index.sentences.columns if c not in ("doc_id", "sentence_idx", "text", "tokens", "stems")]
    return found.select("doc_id", "sentence_idx", "text", shown.alias("highlights"), *others)
