"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time, on histograms of binned
features; the sum of a feature's trees is its lookup table.  The feature pairs whose
two-way tables lower the loss most then get tables of their own.  A document's score is a
sum of table entries, added for a whole Arrow batch at a time.

Only the training rows are bounded (``SAMPLE_ROWS`` labelled documents, those with the least
hashed ids); every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import cluster
from siftline.llm import textkit as tk

#: Labelled documents that the model is fitted on, at most (in expectation).
SAMPLE_ROWS = 12_000
#: A document is kept if its probability of good quality is at least this.
CUTOFF = 0.5

FEATURES = ["symbols", "bangs", "upper", "bars", "digits", "blanks", "non_ascii", "stops", "word_length", "log_words", "distinct", "repeats", "distinct_pairs", "short_words", "line_words", "longest_word"]


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, np.bool_)
    out[[ord(c) for c in chars]] = True
    return out


_CLASSES = [_mask("#$%&*+/<=>@[\\]^_`{}~"), _mask("!"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("|\t"), _mask("0123456789"), _mask(" \r\n"), np.arange(256) >= 128, _mask(".,;:?"), _mask("abcdefghijklmnopqrstuvwxyz"), _mask("\n")]


def features(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text; null and empty texts have the features of no words."""
    parts = [_features(piece) for _, piece in tk.chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)


def _features(piece: pa.Array) -> np.ndarray:
    raw, at = tk.buffers(piece)
    size = np.maximum(np.diff(at), 1).astype(np.float64)
    symbols, bangs, upper, bars, digits, blanks, high, stops, lower, breaks = (tk.row_sums(c[raw], at) for c in _CLASSES)
    w = tk.words(piece)
    n = np.diff(w.at)
    some = np.maximum(n, 1).astype(np.float64)
    length = w.ends - w.starts
    where, pair_at = tk.gram_rows(w.at, 2, len(w.hashes))
    same = w.hashes[where] == w.hashes[where + 1]
    pairs = tk.distinct_counts(tk.grams(w.hashes, 2)[where], pair_at)
    longest = np.zeros(len(n))
    if len(length):
        longest[n > 0] = np.maximum.reduceat(length, w.at[:-1][n > 0])
    columns = [
        symbols / size, bangs / size, upper / np.maximum(upper + lower, 1), bars / size, digits / size, blanks / size, high / size, stops / some,
        tk.row_sums(length, w.at) / some, np.log1p(n), tk.distinct_counts(w.hashes, w.at) / some, tk.row_sums(same, pair_at) / some, pairs / np.maximum(n - 1, 1),
        tk.row_sums(length <= 3, w.at) / some, np.log1p(n / (breaks + 1)), np.log1p(longest),
    ]
    return np.stack(columns, 1).astype(np.float32)


@dataclass
class Gam:
    """Lookup tables over binned features and feature pairs."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for i, j, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges at quantiles of the distinct values' sample."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree over one feature's bins, grown best split first; its value in each bin."""
    spans = [(0, len(g))]
    gs, hs = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))

    def split(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        at = np.arange(lo + 1, hi)
        left, right = (gs[at] - gs[lo], hs[at] - hs[lo]), (gs[hi] - gs[at], hs[hi] - hs[at])
        gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - (gs[hi] - gs[lo]) ** 2 / (hs[hi] - hs[lo] + ridge)
        best = int(np.argmax(gain))
        return float(gain[best]), int(at[best])

    while len(spans) < leaves:
        found = [(*split(*s), s) for s in spans]
        gain, at, (lo, hi) = max(found, key=lambda f: f[0])
        if gain <= 1e-9:
            break
        spans.remove((lo, hi))
        spans += [(lo, at), (at, hi)]
    out = np.zeros(len(g))
    for lo, hi in spans:
        out[lo:hi] = (gs[hi] - gs[lo]) / (hs[hi] - hs[lo] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 32, leaves: int = 3, pairs: int = 6, pair_bins: int = 8, ridge: float = 2.0) -> Gam:
    """Cyclic boosting on 0/1 labels.  No rows or a single class give a constant model."""
    y = y.astype(np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(share / (1 - share))), [], [])
    wide = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        model.edges, model.tables = [np.zeros(0)] * wide, [np.zeros(1)] * wide
        return model
    model.edges = [_edges(x[:, j], bins) for j in range(wide)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    index = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(wide):
            g, h = slopes()
            k = len(model.tables[j])
            step = rate * _tree(np.bincount(index[j], g, k), np.bincount(index[j], h, k), leaves, ridge)
            model.tables[j] += step
            total += step[index[j]]
    coarse = [_edges(x[:, j], pair_bins) for j in range(wide)]
    spot = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    g, h = slopes()

    def table(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(spot[i] * shape[1] + spot[j], v, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((float((table(i, j, g) ** 2 / (table(i, j, h) + ridge)).sum()), i, j) for i in range(wide) for j in range(i)), reverse=True)
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in gains[:pairs]]
    for _ in range(rounds // 4):
        for i, j, t in chosen:
            g, h = slopes()
            step = rate * table(i, j, g) / (table(i, j, h) + ridge)
            t += step
            total += step[spot[i], spot[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for i, j, t in chosen]
    return model


def sampled(labels: DataFrame, column: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, column)`` of about ``rows`` labelled documents at most, chosen by hashed id.

    A document with several labels counts as labelled with the least; null ids and labels are left out.
    """
    kept = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).alias(column))
    count = kept.count()
    share = min(1.0, rows / max(count, 1))
    return kept.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sampled labelled documents, in order of id."""
    some = sampled(labels, "quality", rows)
    # the sample is bounded by its parameter, so that it can be broadcast and the texts stay where they are
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("quality").cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), pa.float32()), len(FEATURES)).cast(pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    table = joined.mapInArrow(cluster.releasing(made), "doc_id bigint, quality int, x array<float>").toArrow()
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    x = np.asarray(table.column("x").combine_chunks().flatten(), np.float32).reshape(-1, len(FEATURES))
    return x[order], table.column("quality").to_numpy()[order]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Gam:
    return fit(*training_rows(docs, labels, rows))


def score(docs: DataFrame, model: Gam, cutoff: float = CUTOFF) -> DataFrame:
    """``(doc_id, quality_score, kept)`` for every row of ``docs``.

    Reads ``doc_id`` and ``text`` alone, so other columns may have any name.  A null or empty text is
    scored as a text without words; repeated rows are scored alike; a null id stays null.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s), pa.array(s >= cutoff)], ["doc_id", "quality_score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(cluster.releasing(made), "doc_id bigint, quality_score double, kept boolean")


def keep_good(docs: DataFrame, model: Gam, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches the cutoff."""
    at = docs.columns.index("text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(features(b.column(at))) >= cutoff))

    return docs.mapInArrow(cluster.releasing(made), docs.schema)
