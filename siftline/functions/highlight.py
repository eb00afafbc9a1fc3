"""Highlighted ranges as columns: no Python at query time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = "array<struct<start:int,end:int>>"


def leftmost(starts: Column, size: int) -> Column:
    """Of sorted starts of matches of ``size`` terms: those that don't overlap the one kept before."""
    none = F.struct(F.lit(-size).alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(done: Column, start: Column) -> Column:
        return F.when(start >= done.last + size, F.struct(start.alias("last"), F.concat(done.kept, F.array(start)).alias("kept"))).otherwise(done)

    return F.aggregate(starts, none, step, lambda done: done.kept)


def overlaps_itself(phrase: tuple[str, ...]) -> bool:
    return any(phrase[i:] == phrase[:-i] for i in range(1, len(phrase)))


def collapse(ranges: Column) -> Column:
    """Sorted ranges, of which overlapping ones are joined; those that touch stay apart."""

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.end, r.end).alias("end"))))
        return F.when((F.size(done) > 0) & (F.coalesce(last.end, F.lit(0)) > r.start), longer).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(RANGES), step)


def parts(text: str, ranges: str) -> Column:
    """SQL names of a text and its sorted disjoint byte ranges -> array of (highlight, text); no empty plain parts."""

    def cut(start: str, end: str) -> str:
        return f"decode(substring(CAST({text} AS BINARY), {start} + 1, {end} - {start}), 'UTF-8')"

    plain = cut(f"IF(i = 0, 0, {ranges}[i - 1].end)", f"{ranges}[i].start")
    lit = cut(f"{ranges}[i].start", f"{ranges}[i].end")
    tail = cut(f"IF(size({ranges}) = 0, 0, element_at({ranges}, -1).end)", f"octet_length({text})")
    pairs = f"flatten(transform(sequence(0, size({ranges}) - 1), i -> array(named_struct('highlight', false, 'text', {plain}), named_struct('highlight', true, 'text', {lit}))))"
    last = f"array(named_struct('highlight', false, 'text', {tail}))"
    both = f"IF(size({ranges}) = 0, {last}, concat({pairs}, {last}))"
    return F.expr(f"filter({both}, p -> p.highlight OR p.text <> '')")


def marked(parts_column: str, before: str = "[", after: str = "]") -> Column:
    """One text of the parts, with marks around the highlighted."""
    return F.array_join(F.transform(F.col(parts_column), lambda p: F.when(p.highlight, F.concat(F.lit(before), p.text, F.lit(after))).otherwise(p.text)), "")
