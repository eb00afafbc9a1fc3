"""Repeated passages by a sparse suffix array.

Of all suffixes of a text's words only those that begin at minimiser positions are retained: where
the hash of the next ``KEY`` words is the least of ``WINDOW`` neighbouring ones.  Which these are
depends on the words alone, so two copies of ``WORDS`` = KEY + WINDOW - 1 words or more retain a
suffix at the same place.  Suffixes whose first words occur once go at once.  The others are
sorted by their words, then by the words before them, and once more the other way round, so that
copies edited on one side meet by the other; neighbours are compared and a match is extended right and
left.  A match of ``WORDS`` words or more is a repeated passage; longer passages are unions
of the matches at their minimisers.

In a run of one repeated n-gram every ``WINDOW``-th position is retained.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import cluster
from siftline.llm import textkit as tk

WORDS = 50
KEY = 20
WINDOW = WORDS - KEY + 1
#: Words that are compared on each side of a key: more can't be needed to reach the next minimiser.
SIDE = WORDS - KEY

U64 = np.uint64


def _sliding(values: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """The best of ``values[i:i + n]`` for every i where these exist."""
    span = 1
    while span * 2 <= n:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[: len(values) - (n - span)], values[n - span :]) if n > span else values


def minimisers(w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word number in the row, and key hash of the retained suffixes."""
    grams = tk.grams(w.hashes, KEY)
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    rows = w.rows()[: len(grams)]
    last = w.at[1:][rows] - KEY  # the row's last n-gram
    least = _sliding(grams, WINDOW, np.minimum)
    inside = np.arange(len(least)) + WINDOW - 1 <= last[: len(least)]
    least = np.where(inside, least, U64(0))
    padded = np.concatenate([np.zeros(WINDOW - 1, U64), least, np.zeros(WINDOW - 1, U64)])
    chosen = (_sliding(padded, WINDOW, np.maximum)[: len(grams)] == grams) & (np.arange(len(grams)) <= last)
    fresh = np.ones(len(grams), np.bool_)
    fresh[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(fresh)
    since = np.arange(len(grams)) - starts[np.cumsum(fresh) - 1]
    at = np.flatnonzero(chosen & (since % WINDOW == 0))
    return rows[at], at - w.at[:-1][rows[at]], grams[at]


def _suffixes(docs: DataFrame) -> DataFrame:
    """``(rid, pos, key)`` of every retained suffix."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, piece in tk.chunks(b.column(1)):
                rows, at, keys = minimisers(tk.words(piece))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + rows)), pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64))], ["rid", "pos", "key"])

    return cluster.row_id(docs.select("doc_id", "text")).select("_rid", "text").mapInArrow(made, "rid bigint, pos int, key bigint")


SUFFIX = "key bigint, right binary, left binary, doc_id bigint, rid bigint, pos int"


def _contexts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The suffixes at ``places(rid, spots)`` with the words on both sides of their keys."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, piece in tk.chunks(b.column(2)):
                w = tk.words(piece)
                spots = b.column(3).slice(first, len(piece))
                rows = np.repeat(np.arange(len(piece)), np.diff(spots.offsets.to_numpy()))
                at = np.asarray(spots.flatten(), np.int64)
                short = np.append((w.hashes >> U64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))  # the last: no word
                start, end = w.at[:-1][rows], w.at[1:][rows]
                step = np.arange(SIDE)
                right = (start + at + KEY)[:, None] + step
                left = (start + at - 1)[:, None] - step
                right = short[np.where(right < end[:, None], right, len(short) - 1)].astype(">u4")
                left = short[np.where(left >= start[:, None], left, len(short) - 1)].astype(">u4")
                keys = tk.grams(w.hashes, KEY)[start + at] if len(at) else np.zeros(0, U64)
                offsets = pa.py_buffer((np.arange(len(at) + 1) * 4 * SIDE).astype(np.int32).tobytes())
                sides = [pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(np.ascontiguousarray(s).tobytes())]) for s in (right, left)]
                take = pa.array(first + rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *sides, b.column(0).cast(pa.int64()).take(take), b.column(1).take(take), pa.array(at.astype(np.int32))], ["key", "right", "left", "doc_id", "rid", "pos"])

    joined = cluster.row_id(docs.select("doc_id", "text"), "rid")
    return joined.join(places, "rid").select("doc_id", "rid", "text", "spots").mapInArrow(made, SUFFIX)


def _length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that each row shares with the other's from the first on."""
    return ((a == b) & (a != 0)).cumprod(axis=1).sum(1)


def _matches(suffixes: DataFrame, words: int) -> DataFrame:
    """``(run, doc_id, rid, start, end)``: passages that sorted neighbours share; a run has one passage's."""

    def made(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
        part = (TaskContext.get().partitionId() * 2 + order) << 40
        run, tail = 0, None
        for b in batches:
            if b.num_rows == 0:
                continue
            key = b.column(0).to_numpy()
            right, left = (np.frombuffer(b"".join(b.column(c).to_pylist()), ">u4").astype(np.uint32).reshape(-1, SIDE) for c in (1, 2))
            ids, rid, pos = b.column(3), b.column(4).to_numpy(), b.column(5).to_numpy().astype(np.int64)
            if tail is not None:
                key, right, left, rid, pos = (np.concatenate([t, v]) for t, v in zip(tail[0], (key, right, left, rid, pos), strict=True))
                ids = pa.concat_arrays([tail[1], ids])
            tail = ([v[-1:].copy() for v in (key, right, left, rid, pos)], ids.slice(len(ids) - 1))
            if len(key) < 2:
                continue
            r, l = _length(right[1:], right[:-1]), _length(left[1:], left[:-1])
            linked = np.flatnonzero((key[1:] == key[:-1]) & (r + l + KEY >= words))
            runs = run + np.cumsum(np.append(0, (key[1:] != key[:-1]) | (r + l + KEY < words)))
            run = int(runs[-1])
            both = np.concatenate([linked, linked + 1])
            r, l = np.tile(r[linked], 2), np.tile(l[linked], 2)
            yield pa.RecordBatch.from_arrays([pa.array(part + runs[both]), ids.take(pa.array(both)), pa.array(rid[both]), pa.array((pos[both] - l).astype(np.int32)), pa.array((pos[both] + KEY + r).astype(np.int32))], ["run", "doc_id", "rid", "start", "end"])

    dealt = suffixes.repartition("key")
    orders = enumerate((("right", "left"), ("left", "right")))
    by_right, by_left = (dealt.sortWithinPartitions("key", *sides, "doc_id", "rid", "pos").mapInArrow(partial(made, order=n), "run bigint, doc_id bigint, rid bigint, start int, end int") for n, sides in orders)
    return by_right.union(by_left)


def _union(spans: str) -> str:
    """SQL: the union of an array of (start, end) spans, in order."""
    return f"""aggregate(array_sort({spans}), CAST(array() AS array<struct<start:int,end:int>>), (done, s) ->
        CASE WHEN size(done) > 0 AND s.start <= element_at(done, -1).end
        THEN concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
        ELSE concat(done, array(named_struct('start', s.start, 'end', s.end))) END)"""


def repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, rid, spans, copies)`` of every row that holds a repeated passage.

    Spans are ranges of word numbers.  ``copies`` are those of passages of which another occurrence
    comes first, in order of doc_id (null ids first), ``rid`` and place; removing them leaves one.
    """
    if words < WORDS:
        raise ValueError(f"passages are of {WORDS} words at least")
    each = Window.partitionBy("key")
    found = _suffixes(docs).withColumn("n", F.count("*").over(each)).where("n > 1")
    places = found.select("rid", "pos").distinct().groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("spots"))
    matches = _matches(_contexts(docs, places), words).withColumn("place", F.struct("doc_id", "rid", "start"))
    matches = matches.withColumn("copy", F.col("place") != F.min("place").over(Window.partitionBy("run")))
    span = F.struct("start", "end")
    by_row = matches.groupBy("rid", "doc_id").agg(F.collect_set(span).alias("spans"), F.collect_set(F.when(F.col("copy"), span)).alias("copies"))
    return by_row.select("doc_id", "rid", F.expr(_union("spans")).alias("spans"), F.expr(_union("copies")).alias("copies"))


def report(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, repeated_words, copied_words, spans)`` of every row that holds a repeated passage.

    Texts of fewer words, null and empty ones hold none.  Rows that repeat, id and text, count as one
    row whose passages occur twice, and are reported once.  Columns other than ``doc_id`` and ``text``
    aren't read.
    """
    total = "aggregate({0}, 0L, (n, s) -> n + s.end - s.start)"
    return repeats(docs, words).select("doc_id", F.expr(total.format("spans")).alias("repeated_words"), F.expr(total.format("copies")).alias("copied_words"), "spans")
