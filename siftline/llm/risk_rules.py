"""Quality rules with risk-controlled thresholds.

A rule rejects a text whose feature lies beyond a cutoff, low or high.  How strict the rules are is
one number, the tightness: at tightness t the cutoffs of a stratum are the t and 1 - t quantiles of
its good labelled documents in the design half; a negative tightness adds a margin to the extremes,
that share of the way from the median.  The holdout half tests, in each stratum, tightness
after tightness from the loosest on: the share of good documents that any rule rejects is at most
``RISK`` unless a binomial count as small as the observed has a probability of at most
``ERROR / strata``.  The first test that fails ends the sequence, so that testing many tightnesses
costs nothing (fixed sequence), and strata are corrected by Bonferroni.  With probability
1 - ``ERROR`` the guarantee holds in all strata together, for every tightness that passed.  Of these
the one is taken that rejects the most bad documents and fewest good ones, as shares; ties: the loosest.

Quantiles and counts cover all labelled documents, and the rules all documents.  Quantiles are
read off histograms of ``BINS`` bins, a bin's edge towards the looser side, so they are bounded in
size whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import cluster
from siftline.llm.quality_gam import FEATURES, features

#: Largest share of good documents that may be rejected in a stratum, and the chance that it is exceeded.
RISK = 0.02
ERROR = 0.05
#: From the loosest to the strictest.
TIGHTNESS = [-2.0, -1.0, -0.5, -0.25, -0.1, 0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05]
BINS = 4096
STRATUM = "lang"
#: Feature and the side on which it is rejected (-1 low, 1 high).
RULES = [("symbols", 1), ("bangs", 1), ("upper", 1), ("bars", 1), ("digits", 1), ("stops", 1), ("word_length", -1), ("word_length", 1), ("distinct", -1), ("repeats", 1), ("distinct_pairs", -1), ("short_words", 1), ("longest_word", 1)]
#: What a feature may reach, for its bins; larger values share the last bin.
REACH = {"stops": 8.0, "word_length": 64.0, "longest_word": 16.0}


def binomial_tail(k: int, n: int, p: float) -> float:
    """The probability of ``k`` or fewer of ``n`` at a chance of ``p`` each."""
    if n <= 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i.tolist()])
    return float(min(1.0, np.exp(log + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def tightest(rejected: np.ndarray, n: int, risk: float, error: float) -> int:
    """Index of the last tightness that passes, of ``n`` good texts and those each rejects; -1: none."""
    for i, k in enumerate(rejected.tolist()):
        if binomial_tail(int(k), n, risk) > error:
            return i - 1
    return len(rejected) - 1


def bins(x: np.ndarray) -> np.ndarray:
    """The bin of each rule's feature, turned so that larger is worse."""
    out = np.zeros((len(x), len(RULES)), np.int32)
    for r, (name, side) in enumerate(RULES):
        scaled = np.clip(x[:, FEATURES.index(name)].astype(np.float64) / REACH.get(name, 1.0), 0, 1)
        at = np.minimum((scaled * BINS).astype(np.int32), BINS - 1)
        out[:, r] = at if side > 0 else BINS - 1 - at
    return out


@dataclass
class Rules:
    """Each stratum's last bin that every rule accepts; strata without a guarantee have none."""

    cutoffs: dict[str, np.ndarray]
    tightness: dict[str, float]


def cutoffs(counts: np.ndarray) -> np.ndarray:
    """``(tightness, rule)`` bins beyond which a text is rejected, of design counts ``(rule, bin)``."""
    total = counts.sum(1)
    up = np.cumsum(counts, axis=1)
    out = np.zeros((len(TIGHTNESS), len(counts)), np.int64)
    for i, t in enumerate(TIGHTNESS):
        need, half = np.ceil((1 - max(t, 0)) * total), np.ceil(total / 2)
        out[i] = [int(np.searchsorted(up[r], need[r])) if total[r] else BINS - 1 for r in range(len(counts))]
        if t < 0:
            out[i] += np.ceil(-t * (out[i] - [int(np.searchsorted(u, h)) for u, h in zip(up, half, strict=True)])).astype(np.int64)
    return out


def _binned(docs: DataFrame, stratum: str) -> DataFrame:
    """``(doc_id, stratum, bins)`` of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = bins(features(b.column(2))).astype(np.int16)
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(RULES))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.ListArray.from_arrays(at, pa.array(found.reshape(-1)))], ["doc_id", "stratum", "bins"])

    named = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    return named.mapInArrow(made, "doc_id bigint, stratum string, bins array<smallint>")


def calibrate(binned: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> Rules:
    """Rules from ``labels(doc_id, quality)``: documents with quality 1 are good.

    Conflicting labels of a document count as the least; null ids and labels are left out.  Halves are
    by hashed id, so that repeated rows are on one side.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    rows = cluster.written(binned.join(known, "doc_id").select("stratum", "bins", "good", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)) == 0).alias("design")))
    counted = rows.where("good AND design").select("stratum", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin").count().toPandas()
    designs: dict[str, np.ndarray] = {}
    for s, part in counted.groupby("stratum"):
        designs[s] = np.zeros((len(RULES), BINS), np.int64)
        np.add.at(designs[s], (part["rule"].to_numpy(), part["bin"].to_numpy()), part["count"].to_numpy())
    tried = {s: cutoffs(c) for s, c in designs.items()}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The loosest tightness at which a text is rejected, by stratum."""
        for b in batches:
            names = b.column(0).to_pylist()
            found = np.asarray(b.column(1).flatten(), np.int64).reshape(-1, len(RULES))
            at = np.array([int(np.argmax(m)) if (m := (v > tried[s]).any(1)).any() else len(TIGHTNESS) for s, v in zip(names, found, strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(at, pa.int32())], ["stratum", "good", "design", "at"])

    placed = rows.where(F.col("stratum").isin(list(tried))) if tried else rows.where("false")
    seen = placed.select("stratum", "bins", "good", "design").mapInArrow(first, "stratum string, good boolean, design boolean, at int").groupBy("stratum", "good", "design", "at").count().toPandas()

    def rejected(part: pd.DataFrame) -> tuple[np.ndarray, int]:
        hits = np.bincount(part["at"], part["count"], len(TIGHTNESS) + 1).astype(np.int64)
        return np.cumsum(hits)[:-1], int(hits.sum())

    made = Rules({}, {})
    for s, part in seen.groupby("stratum"):
        holdout, n = rejected(part[part.good & ~part.design])
        last = tightest(holdout, n, risk, error / max(len(tried), 1))
        if last >= 0:
            (bad, n_bad), (fine, n_fine) = rejected(part[~part.good]), rejected(part[part.good & part.design])
            best = int(np.argmax((bad / max(n_bad, 1) - fine / max(n_fine, 1))[: last + 1]))
            made.cutoffs[s], made.tightness[s] = tried[s][best], TIGHTNESS[best]
    return made


def apply(binned: DataFrame, rules: Rules) -> DataFrame:
    """``(doc_id, stratum, failed)`` of every row; failed: the numbers of the rules that reject it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(1).to_pylist()
            found = np.asarray(b.column(2).flatten(), np.int64).reshape(-1, len(RULES))
            known = sorted(set(names))
            limits = np.array([rules.cutoffs.get(s, np.full(len(RULES), BINS)) for s in known]).reshape(-1, len(RULES))
            beyond = found > limits[np.searchsorted(known, names)] if names else found > 0
            at = np.concatenate(([0], np.cumsum(beyond.sum(1)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(np.nonzero(beyond)[1].astype(np.int32)))], ["doc_id", "stratum", "failed"])

    return binned.mapInArrow(made, "doc_id bigint, stratum string, failed array<int>")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = STRATUM, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``(doc_id, stratum, failed)`` of every row of ``docs``, by rules calibrated on its labelled rows.

    Null strata are one stratum, named ''.  A stratum with too few labelled documents for a guarantee
    rejects nothing.  Null and empty texts are judged as texts without words; repeated rows alike.
    Reads ``doc_id``, ``text`` and the stratum's column alone.
    """
    binned = cluster.written(_binned(docs, stratum))
    return apply(binned, calibrate(binned, labels, risk, error))
