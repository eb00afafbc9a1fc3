"""Near-duplicate documents by SetSketch registers.

A document is its set of word 3-grams (all its words, if there are fewer).  For each of ``M``
registers every element has an exponential value; these come in ascending order, each by an
exponential step, so most elements stop after a few.  A register holds the truncated logarithm of
the least value, floor(1 - log_B x).  Registers of a union are the larger ones of its parts'.
(Ertl, "SetSketch: Filling the Gap between MinHash and HyperLogLog", 2021.)

Two documents' registers are equal with about the Jaccard similarity as probability.  Documents that
agree on all registers of one of ``BANDS`` bands are candidates.  The similarity of a candidate pair
is estimated from all registers jointly, by maximum likelihood; pairs not too far below ``SIMILARITY``
are verified on their words.  Connected documents are one group (see
:func:`siftline.llm.cluster.grouped` for the pairs within a group that needn't be looked at).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import cluster
from siftline.llm import textkit as tk
from siftline.llm.line_dedup import sequence_hashes

SIMILARITY = 0.7
SHINGLE = 3
M = 128
BANDS = 25
B = 1.02
A = 20.0
TOP = (1 << 15) - 1
#: How far below SIMILARITY an estimate may be for a pair to be verified: four standard errors.
SLACK = 0.16

U64 = np.uint64


def shingles(w: tk.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each row's n-grams, in the rows' order, and where the rows begin."""
    where, first = tk.gram_rows(w.at, n, len(w.hashes))
    size = np.diff(w.at)
    few = np.flatnonzero((size > 0) & (size < n))
    grams = tk.grams(w.hashes, n)[where] if len(where) else np.zeros(0, U64)
    if len(few) == 0:
        return grams, first
    whole = sequence_hashes(w.hashes, w.at)[few]
    counts = np.diff(first)
    counts[few] = 1
    return np.insert(grams, first[few], whole), np.concatenate(([0], np.cumsum(counts)))


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of ``M`` registers for each row of elements; rows without elements have 0."""
    n = len(at) - 1
    least = np.full(n * M, np.inf)
    rows = np.repeat(np.arange(n), np.diff(at))
    element = tk.mix(hashes + U64(0x9E3779B97F4A7C15))
    turn, step = (element & U64(M - 1)).astype(np.int64), ((element >> U64(20)) & U64(M - 1) | U64(1)).astype(np.int64)
    x = np.zeros(len(element))
    for j in range(M):
        if len(element) == 0:
            break
        u = (tk.mix(element + U64((j + 1) * 0xD1342543DE82EF95 % (1 << 64))) >> U64(11)).astype(np.float64) * 2.0**-53
        x += -np.log1p(-u) / (A * (M - j))
        np.minimum.at(least, rows * M + ((turn + j * step) & (M - 1)), x)
        more = x < least.reshape(n, M).max(1)[rows]
        if not more.all():
            rows, element, turn, step, x = rows[more], element[more], turn[more], step[more], x[more]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least.reshape(n, M)) / np.log(B))
    return np.clip(k, 0, TOP).astype(np.int16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of unions."""
    return np.maximum(a, b)


_BAND = np.random.default_rng(7).integers(1 << 40, 1 << 62, M, dtype=np.uint64) | U64(1)


def bands(k: np.ndarray) -> np.ndarray:
    """The keys of each row of registers, one for each band."""
    wide = M // BANDS
    some = (k[:, : wide * BANDS].astype(U64) + U64(1)) * _BAND[: wide * BANDS]
    return tk.mix(some.reshape(len(k), BANDS, wide).sum(2, dtype=U64) + np.arange(BANDS, dtype=U64))


def _step(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


def estimate(k1: np.ndarray, k2: np.ndarray, n1: np.ndarray, n2: np.ndarray, points: int = 128) -> np.ndarray:
    """The Jaccard similarity of most likelihood, of rows of registers and sizes of sets."""
    more, less = (k1 > k2).sum(1)[:, None], (k1 < k2).sum(1)[:, None]
    same = k1.shape[1] - more - less
    u = (n1 / (n1 + n2))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, points)[None]
    up, down = _step(np.maximum(u - v * j, 0)), _step(np.maximum(v - u * j, 0))
    like = more * np.log(up + 1e-12) + less * np.log(down + 1e-12) + same * np.log(np.maximum(1 - up - down, 1e-12))
    return j[np.arange(len(j)), like.argmax(1)]


def _sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, rid, h, n, k, keys)`` of every row with words: ``n`` elements, registers ``k``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, piece in tk.chunks(b.column(2)):
                w = tk.words(piece)
                full = np.flatnonzero(np.diff(w.at) > 0)
                hashes, at = shingles(w)
                k = registers(hashes, at)[full]
                flat = pa.py_buffer(np.ascontiguousarray(k).tobytes())
                offsets = pa.py_buffer((np.arange(len(full) + 1) * 2 * M).astype(np.int32).tobytes())
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(bands(k).reshape(-1).view(np.int64)))
                take = pa.array(first + full)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(take), b.column(1).take(take), pa.array(sequence_hashes(w.hashes, w.at)[full].view(np.int64)), pa.array(tk.distinct_counts(hashes, at)[full]), pa.Array.from_buffers(pa.binary(), len(full), [None, offsets, flat]), keys], ["doc_id", "rid", "h", "n", "k", "keys"])

    return cluster.row_id(docs.select("doc_id", "text")).select("doc_id", "_rid", "text").mapInArrow(cluster.releasing(made), "doc_id bigint, rid bigint, h bigint, n bigint, k binary, keys array<bigint>")


def _texts(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """``(h, text)`` of the rows in ``spots(h, rid)``; a filter of their ids spares the others the shuffle."""
    table = cluster.position_filter(spots.select("rid", F.lit(0).alias("part")))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy()
            yield b.filter(pa.array(cluster.in_filter(table, rid, np.zeros(len(rid), np.int64))))

    some = cluster.row_id(docs.select("doc_id", "text"), "rid").select("rid", "text").mapInArrow(cluster.releasing(made), "rid bigint, text string")
    return some.join(spots, "rid").groupBy("h").agg(F.first("text").alias("text"))


def jaccard(a: tk.Words, b: tk.Words) -> np.ndarray:
    """The similarity of each row's n-grams with the other's."""
    (x, at), (y, to) = shingles(a), shingles(b)
    out = np.zeros(len(at) - 1)
    for i in range(len(out)):
        s, t = np.unique(x[at[i] : at[i + 1]]), np.unique(y[to[i] : to[i + 1]])
        both = len(np.intersect1d(s, t, assume_unique=True))
        out[i] = both / max(len(s) + len(t) - both, 1)
    return out


def _verifier(docs: DataFrame, rows: DataFrame, similarity: float) -> Callable[[DataFrame], Callable[[DataFrame], DataFrame]]:
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k1, k2 = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int16).reshape(-1, M) for c in ("ka", "kb"))
                found = np.concatenate([estimate(k1[i : i + 4096], k2[i : i + 4096], b.column("na").to_numpy()[i : i + 4096], b.column("nb").to_numpy()[i : i + 4096]) for i in range(0, len(k1), 4096)])
                yield b.select(["a", "b"]).filter(pa.array(found >= similarity - SLACK))

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = tk.strings(b.column("ta")), tk.strings(b.column("tb"))
            for first in range(0, b.num_rows, 64):
                part = b.select(["a", "b"]).slice(first, 64)
                yield part.filter(pa.array(jaccard(tk.words(left.slice(first, 64)), tk.words(right.slice(first, 64))) >= similarity - 1e-12))

    def prepare(ids: DataFrame) -> Callable[[DataFrame], DataFrame]:
        own = rows.join(ids, rows.h == ids.id, "left_semi").select("h", "rid", "n", "k")
        texts = cluster.written(_texts(docs, own.select("h", "rid")))

        def verify(pairs: DataFrame) -> DataFrame:
            for c in "ab":
                pairs = pairs.join(own.select(F.col("h").alias(c), F.col("k").alias(f"k{c}"), F.col("n").alias(f"n{c}")), c)
            pairs = pairs.mapInArrow(cluster.releasing(likely), "a bigint, b bigint")
            for c in "ab":
                pairs = pairs.join(texts.select(F.col("h").alias(c), F.col("text").alias(f"t{c}")), c)
            return pairs.mapInArrow(cluster.releasing(true), "a bigint, b bigint")

        return verify

    return prepare


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, rid, first, n)`` of every row with words: its group's first row and number of rows.

    Texts of the same words are in one group.  ``first`` has ``doc_id`` and ``rid`` (see
    :func:`siftline.llm.cluster.row_id`) of the row with the least id, null ids last; ties go by ``rid``.
    """
    sketches = cluster.written(_sketches(docs))
    rows = cluster.written(sketches.groupBy("h").agg(F.min_by(F.struct("rid", "n", "k", "keys"), "rid").alias("r")).select("h", "r.*"))
    keys = rows.select(F.explode("keys").alias("key"), F.col("h").alias("id"), F.col("n").alias("size"))
    found = cluster.grouped(keys, similarity, _verifier(docs, rows, similarity))
    placed = sketches.select("doc_id", "rid", "h").join(found, F.col("h") == found.node, "left").select("doc_id", "rid", F.coalesce("root", "h").alias("g"))
    placed = cluster.written(placed)
    firsts = placed.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return placed.join(firsts, "g").select("doc_id", "rid", "first", "n")


def report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, group_doc_id, n_docs, kept)`` of every row in a group of two rows or more.

    ``group_doc_id`` is the least id of the group, whose row is kept.  A text that is null, empty or
    without words is in no group.  Repeats of the kept row are all marked kept here; :func:`clean`
    leaves one of them.  Columns other than ``doc_id`` and ``text`` aren't read.
    """
    found = groups(docs, similarity)
    return found.select("doc_id", F.col("first.doc_id").alias("group_doc_id"), F.col("n").alias("n_docs"), (F.col("rid") == F.col("first.rid")).alias("kept"))


def clean(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group, all columns as they are; rows without words stay."""
    found = groups(docs, similarity)
    marks = cluster.written(found.groupBy("rid").agg(F.count("*").alias("times"), F.max(F.col("rid") == F.col("first.rid")).alias("kept")).where("NOT kept OR times > 1"))
    rid, kept = cluster.free(docs, "_rid"), cluster.free(docs, "_kept")
    marked = cluster.row_id(docs, rid).join(marks.select(F.col("rid").alias(rid), F.col("kept").alias(kept)), rid, "left")
    stay = marked.where(F.col(kept).isNull()).select(docs.columns)
    if marks.where("kept").isEmpty():
        return stay
    return stay.union(marked.where(kept).dropDuplicates([rid]).select(docs.columns))
