"""Toxicity: a logistic classifier regularised by counterfactuals.

Features are the words of a text, present or absent.  Training swaps each identity term of a
labelled text for the other terms of its group and penalises the squared change of the score, so
that what the labels happen to say about texts that mention a group doesn't become weight of its
name.  Score of a text: logistic of the sum of its words' weights.

The training rows are bounded: ``SAMPLE_ROWS`` labelled documents, those with the least hashed ids,
of which copies count once.  Every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import textkit as tk
from siftline.llm.quality_gam import sampled
from siftline.llm.vocab import Vocabulary, word_hashes

SAMPLE_ROWS = 12_000
#: Words with weights, at most: those whose presence tells most about the label.
FEATURES = 512
#: Texts in which a word must occur to get a weight.
LEAST_TEXTS = 5
#: A document is toxic if its probability is at least this.
CUTOFF = 0.5
#: Weight of the squared change of the score under a swap, against the log loss.
FAIRNESS = 10.0
#: Words that may be expected to get a weight by chance, without a tie to the label.
CHANCE_WORDS = 30
RIDGE = 1e-4
#: Minima of n-grams by which copies among the training rows are told.
MINIMA = 16

#: Terms of one group are swapped for one another.
IDENTITIES: list[list[str]] = [
    ["women", "men", "woman", "man", "girls", "boys"],
    ["muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "arab", "african", "european"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["immigrant", "immigrants", "refugee", "refugees", "native", "foreigner"],
    ["frauen", "männer", "muslime", "christen", "juden"],
    ["femmes", "hommes", "musulmans", "chrétiens", "juifs"],
    ["mujeres", "hombres", "musulmanes", "cristianos", "judíos"],
]


@dataclass
class Classifier:
    vocabulary: Vocabulary
    weights: np.ndarray
    intercept: float

    def logits(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, piece in tk.chunks(column):
            w = tk.words(piece)
            rows, features = self.vocabulary.present(w.hashes, w.at)
            out.append(np.bincount(rows, self.weights[features], len(piece)) if len(rows) else np.zeros(len(piece)))
        return self.intercept + (np.concatenate(out) if out else np.zeros(0))

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(column), -30, 30)))


def _minima(w: tk.Words, n: int = 4) -> np.ndarray:
    """``MINIMA`` minima of each row's ``n``-grams, most of which copies share; of its words where it has fewer."""
    size = np.diff(w.at)
    out = np.zeros((len(size), MINIMA), np.uint64)
    for few in (True, False):
        where, at = tk.gram_rows(w.at, 1 if few else n, len(w.hashes))
        mine = np.flatnonzero((np.diff(at) > 0) & ((size < n) == few))
        if len(mine) == 0:
            continue
        hashes = (w.hashes if few else tk.grams(w.hashes, n))[where]
        for i in range(MINIMA):
            least = np.minimum.reduceat(tk.mix(hashes * np.uint64(2 * i + 3)), at[:-1][np.diff(at) > 0])
            spread = np.zeros(len(size), np.uint64)
            spread[np.diff(at) > 0] = least
            out[mine, i] = spread[mine]
    return out


def _once(minima: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows without the copies of earlier ones of the same label: those that share half of the minima with one."""
    n = len(y)
    first = np.zeros(minima.shape, np.int64)  # the first row that has a minimum
    for i in range(minima.shape[1]):
        _, start, which = np.unique(np.stack([minima[:, i], y.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
        first[:, i] = start[which.reshape(-1)]
    shared = np.zeros(n, np.int64)
    for i in range(minima.shape[1]):
        same = (first == first[:, i : i + 1]).sum(1)
        shared = np.maximum(shared, np.where(first[:, i] < np.arange(n), same, 0))
    return np.flatnonzero(2 * shared < minima.shape[1])


def _chosen(rows: np.ndarray, words: np.ndarray, y: np.ndarray, most: int, least: int) -> np.ndarray:
    """Numbers of the words whose texts' labels differ most from all texts', by likelihood ratio."""
    n, total, good = len(y), np.bincount(words).astype(float), np.bincount(words, y[rows])
    share = y.mean()
    some = np.flatnonzero((total >= least) & (total < n))
    with np.errstate(divide="ignore", invalid="ignore"):
        a, t = good[some], total[some]
        told = 2 * (np.nan_to_num(a * np.log(a / (t * share))) + np.nan_to_num((t - a) * np.log((t - a) / (t * (1 - share)))))
    sure = told > 2 * np.log(max(len(some) / CHANCE_WORDS, 2))
    return some[sure][np.argsort(-told[sure], kind="stable")[:most]]


def fit(texts: list[str | None], labels: list[int], fairness: float = FAIRNESS, identities: list[list[str]] = IDENTITIES, most: int = FEATURES, least: int = LEAST_TEXTS, rounds: int = 400) -> Classifier:
    """A classifier from texts with labels 0 or 1; no rows or one class give a constant one."""
    w, y = tk.words(tk.strings(pa.array(texts, pa.large_string()))), np.asarray(labels, np.float64)
    keep = _once(_minima(w), y)
    return _fit(_rows_of(w.hashes, w.at, keep), y[keep], fairness, identities, most, least, rounds)


def _rows_of(hashes: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tk.Words:
    """The words of the kept rows alone, without their text."""
    sizes = np.diff(at)[keep]
    inside = np.repeat(at[keep], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.concatenate(([0], np.cumsum(sizes)))
    return tk.Words(np.zeros(0, np.uint8), own, own, own, own, hashes[inside])


def _fit(w: tk.Words, y: np.ndarray, fairness: float, identities: list[list[str]], most: int, least: int, rounds: int) -> Classifier:
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    intercept = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Classifier(Vocabulary(np.zeros(0)), np.zeros(0), intercept)
    rows = w.rows()
    known, index = np.unique(w.hashes, return_inverse=True)
    key = np.unique(index * np.int64(n) + rows)
    index, rows = key // n, key % n
    groups = [word_hashes(g) for g in identities]
    names = np.concatenate([*groups, np.zeros(0, np.uint64)])
    vocabulary = Vocabulary(np.concatenate([known[_chosen(rows, index, y, most, least)], names[np.isin(names, known)]]))
    at, feature = vocabulary.find(known[index])
    rows = rows[at]
    x = np.zeros((n, len(vocabulary)), np.float32)
    x[rows, feature] = 1
    # a swap of term s for t changes the score by the difference of their weights; how often it can be made
    swaps = []
    for group in groups:
        known_at = vocabulary.find(group)
        for s in known_at[1]:
            for t in known_at[1]:
                if s != t:
                    count = float(np.sum(x[:, s] * (1 - x[:, t])))
                    if count:
                        swaps.append((int(s), int(t), count / (len(known_at[1]) - 1)))
        # a term that the sample lacks has no weight; swapping for it drops the term's own
        lacking = len(group) - len(known_at[1])
        swaps += [(int(s), -1, float(x[:, s].sum()) * lacking / max(len(group) - 1, 1)) for s in known_at[1] if lacking]
    s, t, c = (np.array(v) for v in zip(*swaps, strict=True)) if swaps else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    weights = np.zeros(len(vocabulary) + 1)  # the last is the weight of absent terms, 0
    step_bound = 0.25 * float(np.max(x.sum(1), initial=1) + 1) + RIDGE + 2 * fairness * (4 * c.max(initial=0) / n) * 8
    before, velocity = (weights.copy(), intercept), 1.0
    look, look_b = weights.copy(), intercept
    for _ in range(rounds):  # Nesterov's accelerated descent
        p = 1 / (1 + np.exp(-np.clip(x @ look[:-1].astype(np.float32) + look_b, -30, 30)))
        g = np.append(x.T @ (p - y).astype(np.float32) / n, 0) + RIDGE * look
        change = 2 * fairness * c * (look[s] - look[t]) / n
        np.add.at(g, s, change)
        np.add.at(g, t, -change)
        g[-1] = 0
        now, now_b = look - g / step_bound, look_b - float((p - y).mean()) / step_bound
        faster = (1 + np.sqrt(1 + 4 * velocity**2)) / 2
        momentum = (velocity - 1) / faster
        look, look_b = now + momentum * (now - before[0]), now_b + momentum * (now_b - before[1])
        before, velocity = (now, now_b), faster
    return Classifier(vocabulary, before[0][:-1], before[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, fairness: float = FAIRNESS, identities: list[list[str]] = IDENTITIES) -> Classifier:
    """A classifier fitted on ``labels(doc_id, toxic)``; null ids, labels and texts teach nothing."""
    some = sampled(labels, "toxic", rows)
    # the sample is bounded by its parameter, so that it can be broadcast and the texts stay where they are
    joined = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id").select("doc_id", "toxic", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, piece in tk.chunks(b.column("text")):
                w = tk.words(piece)
                key = [np.unique(w.hashes[i:j]).view(np.int64) for i, j in zip(w.at[:-1], w.at[1:], strict=True)]
                at = np.concatenate(([0], np.cumsum([len(k) for k in key]))).astype(np.int32)
                flat = np.concatenate(key) if key else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(piece)).cast(pa.int64()), b.column("toxic").slice(first, len(piece)).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.FixedSizeListArray.from_arrays(pa.array(_minima(w).reshape(-1).view(np.int64)), MINIMA).cast(pa.list_(pa.int64()))], ["doc_id", "toxic", "words", "minima"])

    table = joined.mapInArrow(made, "doc_id bigint, toxic int, words array<bigint>, minima array<bigint>").toArrow()
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    lists = table.column("words").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    at = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy())))).astype(np.int64)
    hashes = np.asarray(lists.flatten(), np.int64).view(np.uint64)
    y = table.column("toxic").to_numpy().astype(np.float64)
    minima = np.asarray(table.column("minima").combine_chunks().flatten(), np.int64).view(np.uint64).reshape(-1, MINIMA)
    keep = _once(minima, y)
    return _fit(_rows_of(hashes, at, keep), y[keep], fairness, identities, FEATURES, LEAST_TEXTS, 400)


def score(docs: DataFrame, model: Classifier, cutoff: float = CUTOFF) -> DataFrame:
    """``(doc_id, toxicity, toxic)`` of every row of ``docs``.

    Reads ``doc_id`` and ``text`` alone, so other columns may have any name.  A null or empty text has
    no words and so the base rate's score; repeated rows are scored alike; a null id stays null.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s, pa.float64()), pa.array(s >= cutoff, pa.bool_())], ["doc_id", "toxicity", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(made, "doc_id bigint, toxicity double, toxic boolean")
