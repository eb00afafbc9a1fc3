"""Sparse features: the words or n-grams of a batch that a vocabulary holds."""

from __future__ import annotations

import numpy as np

from siftline.llm import textkit as tk


class Vocabulary:
    """Sorted 64-bit hashes; a small table of their low bits turns most other hashes away."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(np.asarray(hashes, np.uint64))
        self.seen = np.zeros(1 << 16, np.bool_)
        self.seen[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that the vocabulary holds, and their feature numbers."""
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(self.hashes) == 0 or len(maybe) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        found = self.hashes[at] == hashes[maybe]
        return maybe[found], at[found]

    def present(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``(row, feature)`` pairs, in order, of rows that begin at ``at``."""
        where, feature = self.find(hashes)
        rows = np.searchsorted(at, where, "right") - 1
        key = np.unique(rows * np.int64(max(len(self), 1)) + feature)
        return key // max(len(self), 1), key % max(len(self), 1)


def word_hashes(words: list[str]) -> np.ndarray:
    """The hash of each single word (0 for a text that isn't one word)."""
    w = tk.words(tk.strings(tk.pa.array(words, tk.pa.string())))
    out = np.zeros(len(words), np.uint64)
    one = np.diff(w.at) == 1
    out[one] = w.hashes[w.at[:-1][one]]
    return out
