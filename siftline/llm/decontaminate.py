"""Benchmark decontamination by a generalised suffix automaton of the test items.

The words of all test items go into one automaton.  A document's words are streamed through it,
which gives the longest match that ends at each word.  Every match that reaches an item's limit
is removed: ``MAX_WORDS`` words, or the share ``ITEM_SHARE`` of a shorter item, though never
fewer than ``LEAST_WORDS`` words.  A document that loses more than ``DOC_SHARE`` of its words
goes altogether.

Before the automaton, numpy finds the stretches of words whose neighbouring pairs all occur in
test items; matches of two words or more lie in such stretches, so the automaton, which is Python,
sees few words and misses none.

The automaton travels with the task.  It holds at most ``PART_WORDS`` words; larger benchmarks are
dealt into parts by item, and documents pass one part after the other (a match lies in one item).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import cluster
from siftline.llm import textkit as tk

MAX_WORDS = 13
LEAST_WORDS = 8
ITEM_SHARE = 0.8
DOC_SHARE = 0.5
PART_WORDS = 200_000


class Automaton:
    """Generalised suffix automaton over word numbers, with the longest removable suffix of each state."""

    def __init__(self, items: list[list[int]], limits: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.limit = [math.inf]  # least limit of the items in which the state's words occur
        for item, limit in zip(items, limits, strict=True):
            state = 0
            for word in item:
                state = self._extend(state, word)
                self.limit[state] = min(self.limit[state], limit)
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for v in reversed(order):
            up = self.link[v]
            self.limit[up] = min(self.limit[up], self.limit[v])
        self.best = [0] * len(self.size)
        for v in order:
            self.best[v] = self.size[v] if self.size[v] >= self.limit[v] else self.best[self.link[v]]

    def _new(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        self.limit.append(math.inf)
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of ``q`` that holds its suffixes reached from ``p``."""
        copy = self._new(self.size[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.limit[copy] = self.link[q], self.limit[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # from an earlier item
            return known if self.size[known] == self.size[last] + 1 else self._split(last, word, known)
        made = self._new(self.size[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[made] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
        return made

    def matches(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each word: the longest match that ends there, and the longest removable one."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state = length = 0
            yield length, (length if length >= self.limit[state] else self.best[self.link[state]] if state else 0)


class Matcher:
    """The automaton of some items, and the vocabulary and word pairs that lead to it."""

    def __init__(self, texts: list[str | None], max_words: int, least_words: int, item_share: float) -> None:
        w = tk.words(tk.strings(pa.array(texts, pa.string())))
        self.vocabulary, index = np.unique(w.hashes, return_inverse=True)
        items = [index[a:b].tolist() for a, b in zip(w.at[:-1], w.at[1:], strict=True)]
        limits = [min(max_words, max(least_words, math.ceil(item_share * len(i)))) for i in items]
        self.least = least_words
        self.automaton = Automaton(items, limits)
        pairs, _ = tk.gram_rows(w.at, 2, len(index))
        self.pairs = np.unique(index[pairs].astype(np.int64) * len(self.vocabulary) + index[pairs + 1]) if len(pairs) else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << 16, np.bool_)
        self.seen[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def flags(self, w: tk.Words) -> np.ndarray:
        """True at the words to remove."""
        flags = np.zeros(len(w.hashes), np.bool_)
        if len(self.pairs) == 0 or len(flags) < 2:
            return flags
        index = np.full(len(flags), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(w.hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, w.hashes[maybe]), len(self.vocabulary) - 1)
        found = self.vocabulary[at] == w.hashes[maybe]
        index[maybe[found]] = at[found]
        known = np.zeros(len(flags), np.bool_)  # the pair that begins here is in an item
        both = np.flatnonzero((index[:-1] >= 0) & (index[1:] >= 0))
        key = index[both] * len(self.vocabulary) + index[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known[both] = self.pairs[at] == key
        known[w.at[1:][w.at[1:] > 0] - 1] = False
        starts, ends = tk.runs(known, np.array([0, len(known)]))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a + 1 < self.least:
                continue
            for i, (_, cut) in enumerate(self.automaton.matches(index[a : b + 1].tolist()), a):
                if cut:
                    flags[i - cut + 1 : i + 1] = True
        return flags


def matchers(items: DataFrame, max_words: int = MAX_WORDS, least_words: int = LEAST_WORDS, item_share: float = ITEM_SHARE, part_words: int = PART_WORDS) -> list[Matcher]:
    """One matcher for each part of the benchmark; null and empty items match nothing."""
    if max_words < 2 or least_words < 2:
        raise ValueError("limits are of two words at least")
    texts = items.where(F.col("text").isNotNull()).select("text")
    total = texts.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    parts = max(1, math.ceil(total / part_words))
    made = []
    for part in range(parts):
        some = texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part) if parts > 1 else texts
        made.append(Matcher([r.text for r in some.distinct().sort("text").collect()], max_words, least_words, item_share))
    return made


def _text_without(text: str, flags: np.ndarray) -> tuple[str, int]:
    """The text without its flagged words and what lies between two of them; the number of gaps it leaves."""
    w = tk.words(pa.array([text], pa.string()), lower=False, hashed=False)
    starts, ends = tk.runs(flags, np.array([0, len(flags)]))
    raw, kept, last = w.data.tobytes(), [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.append(raw[last : w.starts[a]])
        last = int(w.ends[b - 1])
    return b"".join([*kept, raw[last:]]).decode(), len(starts)


def _found(column: pa.Array, parts: list[Matcher]) -> Iterator[tuple[int, int, int, int, str]]:
    """Row, words, removed words, spans and remaining text of the rows that lose words."""
    for first, piece in tk.chunks(column):
        w = tk.words(piece)
        flags = np.zeros(len(w.hashes), np.bool_)
        for m in parts:
            flags |= m.flags(w)
        lost = tk.row_sums(flags, w.at)
        for r in np.flatnonzero(lost).tolist():
            text, spans = _text_without(piece[r].as_py(), flags[w.at[r] : w.at[r + 1]])
            yield first + r, int(w.at[r + 1] - w.at[r]), int(lost[r]), spans, text


REPORT = "doc_id bigint, n_words bigint, removed_words bigint, n_spans bigint, dropped boolean, clean_text string"


def report(docs: DataFrame, parts: list[Matcher], doc_share: float = DOC_SHARE) -> DataFrame:
    """A row for each document that loses words: counts, whether it goes altogether, what remains.

    Null and empty texts match nothing.  Repeated rows are each reported.  Columns other than
    ``doc_id`` and ``text`` aren't read.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_found(b.column(1), parts))
            ids = b.column(0).cast(pa.int64()).take(pa.array([r[0] for r in rows], pa.int64()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            gone = [lost > doc_share * n for _, n, lost, _, _ in rows]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(gone, pa.bool_()), pa.array(columns[4], pa.string())], ["doc_id", "n_words", "removed_words", "n_spans", "dropped", "clean_text"])

    return docs.select("doc_id", "text").mapInArrow(cluster.releasing(made), REPORT)


def clean(docs: DataFrame, parts: list[Matcher], doc_share: float = DOC_SHARE) -> DataFrame:
    """``docs`` without the removed spans and without the documents that go altogether.

    All other columns stay as they are, whatever their names; a text that is null or matches nothing
    stays as it is.
    """
    at = docs.columns.index("text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_found(b.column(at), parts))
            if not rows:
                yield b
                continue
            mask = np.zeros(b.num_rows, np.bool_)
            mask[[r[0] for r in rows]] = True
            texts = pc.replace_with_mask(b.column(at), pa.array(mask), pa.array([r[4] for r in rows], b.column(at).type))
            gone = np.zeros(b.num_rows, np.bool_)
            gone[[r for r, n, lost, _, _ in rows if lost > doc_share * n]] = True
            yield b.set_column(at, b.schema.field(at), texts).filter(pa.array(~gone))

    return docs.mapInArrow(cluster.releasing(made), docs.schema)


#: DuckDB: the union of all item windows of the limit's length is what the automaton removes.
SQL = r"""
WITH item AS (SELECT list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
lim AS (SELECT w, least(13, greatest(8, CAST(ceil(0.8 * len(w)) AS INT))) AS k FROM item),
gram AS (SELECT DISTINCT k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lim)),
doc AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, string_split_regex(text, '[\p{L}\p{N}]+') AS gaps, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS lw FROM documents),
pos AS (SELECT doc_id, k, i, array_to_string(lw[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, lw, k, unnest(range(1, len(lw) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM gram))),
hit AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + pos.k)) AS p FROM pos JOIN gram ON pos.k = gram.k AND pos.g = gram.g)),
flag AS (SELECT doc_id, list(p) AS f, count(*) AS removed FROM hit GROUP BY doc_id),
span AS (SELECT h.doc_id, count(*) AS n FROM hit h LEFT JOIN hit b ON b.doc_id = h.doc_id AND b.p = h.p - 1 WHERE b.p IS NULL GROUP BY h.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(removed AS BIGINT) AS removed_words, CAST(span.n AS BIGINT) AS n_spans, removed > 0.5 * len(w) AS dropped,
  array_to_string(list_transform(range(1, len(w) + 1), lambda i: (CASE WHEN list_contains(f, i) AND list_contains(f, i - 1) THEN '' ELSE gaps[i] END) || (CASE WHEN list_contains(f, i) THEN '' ELSE w[i] END)), '') || gaps[len(w) + 1] AS clean_text
FROM doc JOIN flag USING (doc_id) JOIN span USING (doc_id)
"""
