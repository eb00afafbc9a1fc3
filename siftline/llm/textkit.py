"""Vectorised text analysis over Arrow string columns.

Operators receive Arrow batches (``mapInArrow``) and work on the contiguous
UTF-8 buffer with numpy, so no Python object is made per word.

A *word* is a maximal run of letters, digits and other non-ASCII characters,
where Latin-1, general and CJK punctuation count as separators, lower-cased.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are analysed at a time; a longer single text is taken whole.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = int(_rng.integers(1 << 40, 1 << 62)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = _rng.integers(1 << 40, 1 << 62, 256, dtype=np.uint64) | U64(1)

_WORD = np.zeros(256, np.bool_)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WORD_BYTES = _WORD.tobytes()
_LATIN1 = np.zeros(256, np.bool_)  # second bytes after C2 that are letters or digits
_LATIN1[[0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE]] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(n, base, U64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = (made[0], made[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One Arrow string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its row offsets, starting at 0."""
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole rows of at most ``most`` bytes (one row at least), with their first row."""
    column = strings(column)
    _, at = buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, column.slice(first, last - first)
        first = last


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the row ranges ``at[i]:at[i+1]``; empty rows have 0."""
    out = np.zeros(len(at) - 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    full = at[1:] > at[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, at[:-1][full], dtype=out.dtype)
    return out


def word_mask(data: np.ndarray) -> np.ndarray:
    """True at the bytes of words."""
    mask = np.frombuffer(bytearray(data.tobytes().translate(_WORD_BYTES)), np.bool_)
    n = len(data)
    high = np.flatnonzero(data >= 0xC2)
    if len(high) == 0:
        return mask
    kind = data[high]
    lead = high[kind == 0xC2]
    lead = lead[lead + 1 < n]
    lead = lead[~_LATIN1[data[lead + 1]]]
    mask[lead] = mask[lead + 1] = False
    lead = high[kind == 0xC3]
    lead = lead[lead + 1 < n]
    lead = lead[(data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)]
    mask[lead] = mask[lead + 1] = False
    for first, seconds in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        lead = high[kind == first]
        lead = lead[lead + 2 < n]
        second, third = data[lead + 1], data[lead + 2]
        sep = np.isin(second, seconds)
        if first == 0xE2:
            sep &= (second == 0x80) | (third < 0xB0)
        else:
            sep &= (third < 0x84) | ((third >= 0x88) & (third <= 0x91))
        lead = lead[sep]
        mask[lead] = mask[lead + 1] = mask[lead + 2] = False
    return mask


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none of which crosses a row."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros(n, np.bool_)
    before[1:] = mask[:-1]
    before[at[:-1][at[:-1] < n]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.zeros(n, np.bool_)
    after[:-1] = mask[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, by prefix sums of a polynomial."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    own = np.take(_BYTE, data)
    own *= up[: len(data)]
    np.cumsum(own, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def joined_hashes(data: np.ndarray, start: np.ndarray, cut: np.ndarray, after: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The :func:`span_hashes` of byte ranges without what lies from ``cut`` to ``after`` in them."""
    if len(start) == 0:
        return np.zeros(0, U64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    left, right = (sums[cut] - sums[start]) * down[start], (sums[end] - sums[after]) * down[start + after - cut]
    return mix(left + right + (end - start - after + cut).astype(U64))


@dataclass
class Words:
    """The words of some rows: byte ranges, hashes, and each row's first word in ``at``."""

    data: np.ndarray
    row_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    hashes: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def words(column: pa.Array, lower: bool = True, hashed: bool = True) -> Words:
    """The words of a string array (see :func:`chunks` for bounded pieces)."""
    if lower:
        column = pc.utf8_lower(column)
    data, at = buffers(column)
    starts, ends = runs(word_mask(data), at)
    return Words(data, at, starts, ends, np.searchsorted(starts, at), span_hashes(data, starts, ends) if hashed else np.zeros(0, U64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive words at every position but the last n - 1; rows aren't regarded."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    total = np.zeros(size, U64)
    for i in range(n):
        total += hashes[i : i + size] * _GRAM[i]
    return mix(total)


def gram_rows(at: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``n`` words lie in one row, and each row's first index among these."""
    size = np.maximum(np.diff(at) - n + 1, 0)
    first = np.concatenate(([0], np.cumsum(size)))
    where = np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], size)
    return where, first


def distinct_counts(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distinct hashes of each row, as told by 44 bits of them."""
    n = len(at) - 1
    rows = np.repeat(np.arange(n), np.diff(at))
    out = np.zeros(n, np.int64)
    for first in range(0, n, 1 << 20):
        last = min(n, first + (1 << 20))
        key = ((rows[at[first] : at[last]] - first).astype(U64) << U64(44)) | (hashes[at[first] : at[last]] >> U64(20))
        key.sort()
        new = np.ones(len(key), np.bool_)
        new[1:] = key[1:] != key[:-1]
        out[first:last] = np.bincount((key[new] >> U64(44)).astype(np.int64), minlength=last - first)
    return out
