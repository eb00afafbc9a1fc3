"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, groups.

A line is normalised to its lower-cased words with single spaces.  Lines without words are left
alone.  Of each group of lines that are equal or chained by an edit similarity of ``SIMILARITY``
at least, the occurrence with the least (doc_id, line number) stays.  Equal lines are told by a 64-bit
hash of their words.

Lines are candidates if they share blocks.  Lines of ``FEW`` words at most have ``CLASSES`` of them: the
telling words, of ``TELLING`` bytes at least (all words, if none is), are dealt by hash into classes, each
with its own 64-bit SimHash; short words would outvote the others.  By the pigeonhole principle few changed
words leave some class as it was.  A class of few letters says little; it is joined with the
next ones until it holds ``LETTERS``.  These lines also have a key for every word left out, of the other words
in their places, if these hold ``FEW_LETTERS``, and one for each piece, a run of words of ``LETTERS`` letters.

A tenth of a long line's letters may be edited, and that changes a quarter of the bits of a SimHash of
it (see the README for figures), too many for blocks of any use.  So lines of more than ``SOME`` words have
smaller blocks: the telling words in the order of their hashes, each two neighbours of which are a block.
A changed word breaks three blocks at most, so some stay equal if fewer than a third are changed.  Of more
than ``PAIRS`` blocks those with the least hashes count, about; the limit depends on the number of
telling words alone.  Lines that have less than ``MIDDLE`` telling words also have blocks of a word and the next but
one, which make up that number; lines of less than ``TOLD`` have pieces as well.  Two lines of ``MANY`` telling words and more than ``FEW``
words are candidates if they share two keys at least; other lines, if they share one.

Lines of ``SHORT`` words at most, among them clauses written without spaces, are keyed by their
characters as well.  Where one edit is allowed, below 20 characters, all characters but one are a key,
whichever it is.  Beyond, a line that allows k edits has k + 1 parts between them, one of which holds
``RUN`` characters at least, so its runs of ``RUN`` are keys, and of a long line ``RUNS`` of them, about: k edits
leave 4 of 10 runs as they are.

Keys go through one shuffle as packed arrays, not as rows, and are sorted in numpy.  A key's lines are
sorted by size, so that each meets only those of sizes that ``SIMILARITY`` allows, and in which the key's words
lie where they may after so many edits.  Where these are more than ``NEAR``, a line first meets one of them; what
isn't in its group after that is compared too, so nothing is lost.  The edit distance of every candidate
pair decides (:mod:`siftline.llm.edits`), but pairs whose lines are in one group already needn't be looked at,
nor those whose counts of characters, a small sketch of each line, differ by more than the edits allowed can change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.llm import cluster, edits
from siftline.llm import textkit as tk

SIMILARITY = 0.9
CLASSES = 6
LETTERS = 12
TELLING = 5
FEW = 16
FEW_LETTERS = 6
#: Lines of more words than this have blocks of two words, of which those are keys that ``PAIRS`` says.
SOME = 10
PAIRS = 40
#: Telling words up to which blocks of every word and the next but one make up the number of blocks, about.
MIDDLE = 32
#: Telling words below which pieces are keys too, about ``PAIRS`` of them.
TOLD = 12
#: Telling words from which two lines must share two keys.
MANY = 13
#: Words of the lines that are keyed by their characters, at most.
SHORT = 3
#: Characters of a run, and runs of a line that are keys.
RUN = 6
RUNS = 64
#: Lines of a key that a line meets at once.
NEAR = 16
#: Keys that a task sorts at a time.
FLUSH = 1 << 20
#: Keys whose lines meet at a time, pairs that a task holds before it deals them, and pairs of dense keys that it looks at at a time.
SLICE = 1 << 18
HELD = 1 << 22
LOOKED = 1 << 18
#: Bits of the keys by which lines meet.
KEY_BITS = 48
#: Steps of the logarithm by which sizes are told.
LOG = 1024
#: Bits for each place in the tables by which the lines that go are told from others, and places that they leave open at most.
TOLD_BITS = 64
OPEN = 1 << 16

U64 = np.uint64


def line_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of the rows begin, with the end of all; and each row's first line.

    Every row has a line more than it has line feeds.
    """
    feeds = np.flatnonzero(data == 10)
    rows = np.searchsorted(at, feeds, "right") - 1
    starts = np.concatenate((at[:-1], feeds + 1))
    order = np.lexsort((starts, np.concatenate((np.arange(len(at) - 1), rows))))
    first = np.concatenate(([0], np.cumsum(1 + np.bincount(rows, minlength=len(at) - 1))))
    return np.append(starts[order], len(data)), first


def sequence_hashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the word sequences of rows."""
    up, down = tk.powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return tk.mix((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]] + np.diff(at).astype(U64))


def blocks(hashes: np.ndarray, letters: np.ndarray, at: np.ndarray, classes: int = CLASSES, least: int = LETTERS) -> np.ndarray:
    """The block keys of each line, ``classes`` of them, equal ones repeated."""
    n = len(at) - 1
    which = (tk.mix(hashes ^ U64(0xA5A5A5A5A5A5A5A5)) >> U64(40)) % U64(classes)
    prints = np.zeros((classes, n), U64)
    held = np.zeros((classes, n), np.int64)
    some = np.zeros((classes, n), np.bool_)
    for c in range(classes):
        mine = np.flatnonzero(which == c)
        edge = np.searchsorted(mine, at)
        full = edge[1:] > edge[:-1]
        some[c] = full
        if not full.any():
            continue
        held[c] = tk.row_sums(letters[mine], edge)
        bits = np.unpackbits(hashes[mine].view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, edge[:-1][full], axis=0, dtype=np.int32)
        prints[c, full] = np.packbits(ones * 2 > (edge[1:] - edge[:-1])[full, None], axis=1).view(U64)[:, 0]
    out = np.zeros((n, classes), U64)
    for c in range(classes):
        key, sum_, count = np.zeros(n, U64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d in range(classes):
            e = (c + d) % classes
            take = sum_ < least
            # a sum, so that it doesn't matter at which class the walk began
            key += np.where(take & some[e], tk.mix(prints[e] + U64(e + 1)), U64(0))
            sum_ += np.where(take, held[e], 0)
            count += take
        out[:, c] = tk.mix(key)
    return out


def left_out(hashes: np.ndarray, letters: np.ndarray, at: np.ndarray, most: int = FEW, least: int = FEW_LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Lines and keys of all words but one, for each word of a line of ``most`` words at most."""
    size = np.diff(at)
    lines = np.flatnonzero((size > 1) & (size <= most))
    n = size[lines]
    line = np.repeat(lines, n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    word = at[line] + place
    term = hashes[word] * tk.powers(most + 1)[0][place + 1]
    total, held = np.zeros(len(size), U64), np.zeros(len(size), np.int64)
    np.add.at(total, line, term)
    np.add.at(held, line, letters[word])
    keys = tk.mix(total[line] - term + tk.mix((place * 64 + size[line]).astype(U64)))
    enough = held[line] - letters[word] >= least
    return line[enough], keys[enough]


def _below(hashes: np.ndarray, count: np.ndarray, most: int | np.ndarray) -> np.ndarray:
    """Which of ``count`` hashes a line has are among about ``most`` of the least; all, if it has no more."""
    return hashes <= (np.minimum(most / np.maximum(count, 1), 1.0) * (1 << 53)).astype(U64) * U64(1 << 11) - U64(1)


def pieces(hashes: np.ndarray, letters: np.ndarray, at: np.ndarray, lines: np.ndarray, least: int = LETTERS) -> tuple[np.ndarray, ...]:
    """Line, key and first word of pieces of the marked lines, about ``PAIRS`` of each.

    A piece begins at any word and goes on until it holds ``least`` letters; one that the line's end
    cuts short is none.
    """
    up, down = tk.powers(len(hashes) + 1)
    sums, held = np.zeros(len(hashes) + 1, U64), np.concatenate(([0], np.cumsum(letters)))
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    size = np.diff(at)
    line = np.repeat(np.flatnonzero(lines), size[lines])
    start = np.flatnonzero(np.repeat(lines, size))
    end = np.searchsorted(held, held[start] + least)
    whole = end <= at[1:][line]
    line, start, end = line[whole], start[whole], end[whole]
    key = tk.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
    use = _below(key, size[line], PAIRS)
    return line[use], key[use], start[use]


def pairs(hashes: np.ndarray, letters: np.ndarray, at: np.ndarray, least: int = SOME) -> tuple[np.ndarray, ...]:
    """Line, key and both words of the blocks of two words of lines of more than ``least``; and each line's telling words."""
    size = np.diff(at)
    use = np.flatnonzero((letters >= TELLING) & np.repeat(size > least, size))
    line = np.repeat(np.arange(len(size)), size)[use]
    order = np.argsort((line.astype(U64) << U64(40)) | (hashes[use] >> U64(24)))
    line, word = line[order], use[order]
    own = hashes[word]
    new = np.ones(len(line), np.bool_)
    new[1:] = (line[1:] != line[:-1]) | (own[1:] != own[:-1])
    # of a word that a line has again the first place, in whatever order they are sorted
    line, word = line[new], np.minimum.reduceat(word, np.flatnonzero(new)) if len(word) else word
    told = np.bincount(line, minlength=len(size))
    next_ = np.flatnonzero(line[1:] == line[:-1])
    over = np.flatnonzero((line[2:] == line[:-2]) & (told[line[2:]] <= MIDDLE) & (size[line[2:]] > FEW))
    line, first, second = np.concatenate([line[next_], line[over]]), word[np.concatenate([next_, over])], word[np.concatenate([next_ + 1, over + 2])]
    key = tk.mix(tk.mix(hashes[first]) + hashes[second] + (first < second).astype(U64))
    few = _below(key, told[line], np.where(np.arange(len(line)) < len(next_), PAIRS, np.maximum(MIDDLE - told[line], 0)))
    return line[few], key[few], first[few], second[few], told


def short_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, key and place of the characters' keys of normalised lines.

    Lines of less than 9 characters have none: no edit is allowed in 9, and 10 may lose one.
    """
    data, at = tk.buffers(pa.array(lines, pa.string()))
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(chars, at)
    size = np.diff(first)
    line = np.repeat(np.arange(len(lines)), size)
    place = np.arange(len(line)) - first[:-1][line]
    # 18 may come of 20, of which two are edited
    run = np.flatnonzero((size[line] >= 18) & (place <= size[line] - RUN))
    key = tk.span_hashes(data, chars[run], chars[run + RUN])
    use = _below(key, size[line[run]] - RUN + 1, RUNS)
    run, key = run[use], key[use]
    small = np.flatnonzero((size >= 9) & (size < 20))
    whole = tk.span_hashes(data, at[small], at[small + 1])
    one = np.flatnonzero((size[line] >= 9) & (size[line] < 20))
    start, end, here, after = at[line[one]], at[line[one] + 1], chars[one], chars[one + 1]
    left = tk.joined_hashes(data, start, here, after, end)
    none = np.zeros(len(small) + len(one), np.int64)
    return np.concatenate((line[run], small, line[one])), np.concatenate((key, whole, left)), np.concatenate((place[run], none))


def keys_of(hashes: np.ndarray, letters: np.ndarray, at: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, ...]:
    """Line, key, and places of a first and a second word of all keys; and which lines must share two.

    ``spots``: the words' places.  Keys of whole lines have place 0.
    """
    size = np.diff(at)
    tell = letters >= TELLING
    use = np.flatnonzero((tell | np.repeat(tk.row_sums(tell, at) == 0, size)) & np.repeat(size <= FEW, size))
    made = blocks(hashes[use], letters[use], np.searchsorted(use, at))
    made.sort(axis=1)
    new = ((size > 0) & (size <= FEW))[:, None] & np.ones(made.shape[1], np.bool_)
    new[:, 1:] &= made[:, 1:] != made[:, :-1]
    some, left = left_out(hashes, letters, at)
    two, block, first, second, told = pairs(hashes, letters, at)
    more, piece, start = pieces(hashes, letters, at, (size <= FEW) | (told < TOLD))
    line, key = np.concatenate([np.nonzero(new)[0], some, two, more]), np.concatenate([made[new], left, block, piece])
    none = np.zeros(len(line) - len(two) - len(more), np.int64)
    many = (size > FEW) & (told >= MANY)
    return line, key, np.concatenate([none, spots[first], spots[start]]), np.concatenate([none, spots[second], spots[start]]), many


def _shift(code: np.ndarray) -> np.ndarray:
    """The power of two of the characters by which places in a line of this size are told, so that they fit in a byte."""
    return np.maximum(np.floor(code / LOG / np.log(2)).astype(np.int64) - 7, 0)


FOUND = "kind int, part int, blob binary, x bigint, y bigint, z bigint, n int"
#: Kinds of rows: first occurrences, later ones, keys or pairs in blobs, and keys whose lines are many.
FIRST, LATER, BLOB, DENSE = range(4)
_LINE = ["u8", "i8", "i8", "i4", "u1"]
_KEY = ["u4", "u8", "u4"]
_PAIR = ["u8", "u8", "u1", "u1"]


def _rows(kind: int, size: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """Rows of ``FOUND``; columns that aren't given are null."""
    kinds = {"part": pa.int32(), "blob": pa.binary(), "x": pa.int64(), "y": pa.int64(), "z": pa.int64(), "n": pa.int32()}

    def column(name: str) -> pa.Array:
        v = columns.get(name)
        if v is None:
            return pa.nulls(size, kinds[name])
        if isinstance(v, np.ndarray) and v.dtype == U64:
            v = v.view(np.int64)
        return v if isinstance(v, pa.Array) else pa.array(v).cast(kinds[name])

    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *map(column, kinds)], ["kind", *kinds])


def _dealt(kind: int, key: np.ndarray, parts: int, columns: list[np.ndarray], keyed: bool = False) -> Iterator[pa.RecordBatch]:
    """The records as blobs for each part of the keys' range; ``kind`` tells what they hold.

    Where they are ``keyed``, the first of ``columns`` is the lines' hashes; before it a column has what the upper ``KEY_BITS`` of the keys add to the one before, and a
    blob ends where that takes more than 32 bits.
    """
    order = np.argsort(key)
    key, columns = key[order], [c[order] for c in columns]
    if keyed:  # most keys of lines that occur again go
        new = np.ones(len(key), np.bool_)
        new[1:] = (key[1:] != key[:-1]) | (columns[0][1:] != columns[0][:-1])
        key, columns = key[new], [c[new] for c in columns]
    part = (((key >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int32)
    cut = part[1:] != part[:-1]
    if keyed:
        top = key >> U64(64 - KEY_BITS)
        step = np.diff(top, prepend=U64(0))
        cut |= step[1:] >> U64(32) > 0
    start = np.concatenate(([0], np.flatnonzero(cut) + 1)) if len(key) else np.zeros(0, np.int64)
    edge = np.append(start, len(key)).tolist()
    if keyed:
        step[start] = 0
        columns = [step.astype(np.uint32), *columns]
    blobs = [b"".join([c[x:y].tobytes() for c in columns]) for x, y in zip(edge[:-1], edge[1:], strict=True)]
    if blobs:
        first = top[start] if keyed else None
        yield _rows(BLOB, len(blobs), part=part[start], blob=pa.array(blobs, pa.binary()), n=np.full(len(blobs), kind), x=first)


def _gathered(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The columns of all blobs."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    found: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        n, at = len(blob) // sum(sizes), 0
        for own, kind, size in zip(found, kinds, sizes, strict=True):
            own.append(np.frombuffer(blob, kind, n, at))
            at += n * size
    return [np.concatenate(f) for f in found]


def _analysed(ids: pa.Array, rids: np.ndarray, texts: pa.Array) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """The line records and the key records of pieces of a batch."""
    none = np.asarray(ids.is_null())
    docs = tk.pc.fill_null(ids, 0).to_numpy()
    for start, piece in tk.chunks(texts):
        piece = tk.pc.utf8_lower(piece)
        data, row_at = tk.buffers(piece)
        starts, row_first = line_starts(data, row_at)
        s, e = tk.runs(tk.word_mask(data), starts)
        at = np.searchsorted(s, starts)
        hashes = tk.span_hashes(data, s, e)
        h = sequence_hashes(hashes, at)
        rows = np.repeat(np.arange(len(piece)), np.diff(row_first))
        number = (np.arange(len(rows)) - row_first[rows]).astype(np.int32)
        full = np.flatnonzero(np.diff(at) > 0)
        row = start + rows[full]
        yield [h[full], docs[row], rids[row], number[full], none[row].view(np.uint8)], []
        once = np.zeros(len(at) - 1, np.bool_)
        once[full[np.unique(h[full], return_index=True)[1]]] = True
        words = np.repeat(once, np.diff(at))
        s, e, hashes, h, lines = s[words], e[words], hashes[words], h[once], np.flatnonzero(once)
        at = np.concatenate(([0], np.cumsum(np.diff(at)[once])))
        # places in the normalised line, where one character lies between words
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        inner = np.concatenate(([0], np.cumsum(chars[e] - chars[s] + 1)))
        size = inner[at[1:]] - inner[at[:-1]] - 1
        line, key, p, q, many = keys_of(hashes, e - s, at, inner[:-1] - np.repeat(inner[at[:-1]], np.diff(at)))
        short = np.flatnonzero(np.diff(at) <= SHORT)
        if len(short):
            raw = data.tobytes()
            spans = [zip(s[i:j].tolist(), e[i:j].tolist(), strict=True) for i, j in zip(at[short].tolist(), at[short + 1].tolist(), strict=True)]
            few, more, place = short_keys([b" ".join([raw[x:y] for x, y in own]).decode() for own in spans])
            line, key, p, q = (np.concatenate(v) for v in ((line, short[few]), (key, more), (p, place), (q, place)))
        code = np.rint(np.log(np.maximum(size, 1)) * LOG).astype(np.int64)
        shift = _shift(code)[line]
        p, q = (np.minimum(v >> shift, 255).astype(np.uint32) for v in (p, q))
        p |= q << np.uint32(8)
        p <<= np.uint32(16)
        p |= (code + (many.astype(np.int64) << 15)).astype(np.uint32)[line]
        yield [], [key, h[line], p]


def _local(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of line records: the first occurrence of each hash, and all others that aren't at the same place."""
    h, doc, rid, number, none = lines
    order = np.lexsort((number, rid, doc, none, h))
    new = np.ones(len(order), np.bool_)
    new[1:] = h[order[1:]] != h[order[:-1]]
    first = order[new]
    own = first[np.cumsum(new) - 1] if len(order) else order
    apart = (rid[order] != rid[own]) | (number[order] != number[own])
    return first, order[apart]


def _scattered(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of ``FOUND``: later occurrences of a task's lines, and blobs of first occurrences and of keys."""

    def flushed(lines: list[list[np.ndarray]], keys: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if lines:
            own = [np.concatenate(c) for c in zip(*lines, strict=True)]
            first, later = _local(own)
            yield _rows(LATER, len(later), part=(own[2][later] & 0x7FFF).astype(np.int32), y=own[2][later], n=own[3][later])
            yield from _dealt(FIRST, own[0][first], parts, [c[first] for c in own])
        if keys:
            key, h, packed = (np.concatenate(c) for c in zip(*keys, strict=True))
            yield from _dealt(DENSE, key, parts, [h, packed], keyed=True)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[list[np.ndarray]] = []
        keys: list[list[np.ndarray]] = []
        held = 0
        for b in batches:
            for line, key in _analysed(b.column(0).cast(pa.int64()), b.column(1).to_numpy(), b.column(2)):
                lines += [line] if line else []
                keys += [key] if key else []
                held += len(key[0]) if key else 0
                if held > FLUSH:
                    yield from flushed(lines, keys)
                    lines, keys, held = [], [], 0
        yield from flushed(lines, keys)

    return cluster.row_id(docs.select("doc_id", "text")).select("doc_id", "_rid", "text").mapInArrow(cluster.releasing(made), FOUND)


def _near(i: np.ndarray, j: np.ndarray, code: np.ndarray, p: np.ndarray, q: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the key's words lie near enough in lines i and j, of which j is the longer."""
    big = np.exp(code[j] / LOG) * 1.001
    unit = 1 << _shift(code)
    far = big * (1 - similarity) + 2 + np.maximum(unit[i], unit[j])
    return (np.abs(p[i] * unit[i] - p[j] * unit[j]) <= far) & (np.abs(q[i] * unit[i] - q[j] * unit[j]) <= far)


def _together(key: np.ndarray, ids: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The order of keys, sizes and ids, without repeats and without keys of one line."""
    order = np.argsort(key)
    sorted_ = key[order]
    same = np.zeros(len(key) + 1, np.bool_)
    same[1:-1] = sorted_[1:] == sorted_[:-1]
    order = order[same[1:] | same[:-1]]
    order = order[np.lexsort((ids[order], code[order], key[order]))]
    if len(order) == 0:
        return order
    new = np.ones(len(order), np.bool_)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])
    order = order[new]
    same = np.zeros(len(order) + 1, np.bool_)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    return order[same[1:] | same[:-1]]


def _group(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of sorted keys is a new one, and the number of it."""
    new = np.ones(len(key), np.bool_)
    new[1:] = key[1:] != key[:-1]
    return new, np.cumsum(new) - 1


def _slices(key: np.ndarray, size: int) -> Iterator[slice]:
    """Slices of about ``size`` of sorted keys; none is cut."""
    start = np.flatnonzero(_group(key)[0])
    if len(start):
        at = np.unique(start[np.minimum(np.searchsorted(start, np.arange(0, len(key), size)), len(start) - 1)])
        yield from map(slice, at.tolist(), [*at[1:].tolist(), len(key)])


def _met(key: np.ndarray, ids: np.ndarray, code: np.ndarray, p: np.ndarray, q: np.ndarray, many: np.ndarray, similarity: float, near: int):
    """Pairs of lines that meet by a key, as indexes, and which lines belong to keys with more to compare."""
    window = int(np.ceil(-np.log(similarity) * LOG)) + 1
    new, group = _group(key)
    sized = group * (1 << 16) + code
    low = np.searchsorted(sized, group * (1 << 16) + np.maximum(code - window, 0))
    n = np.arange(len(key))
    before = n - low
    dense = before > near
    left, right = [], []
    for d in range(1, near + 1):
        j = np.flatnonzero((before >= d) & ~dense)
        if len(j) == 0:
            break
        left.append(j - d)
        right.append(j)
    more = np.zeros(len(key) + 1, np.int64)
    if dense.any():
        np.add.at(more, low[dense], 1)
        np.add.at(more, n[dense] + 1, -1)
        # each meets the least line of its sizes and that of the sizes before
        band = group * (1 << 16) + code // window
        start = np.flatnonzero(_group(band)[0])
        of = _group(band)[1]
        least = np.minimum.reduceat(ids, start)
        lead = np.flatnonzero(ids == least[of])  # one of each band, since a key's lines differ
        j = n[dense]
        for back in (0, 1):
            i = lead[np.maximum(of[j] - back, 0)]
            # before the first band there is none, and its own would count twice
            fit = (of[j] >= back) & (group[i] == group[j]) & (i != j) & (np.maximum(i, j) - np.minimum(i, j) > 0) & (sized[i] + window >= sized[j])
            left.append(np.minimum(i, j)[fit])
            right.append(np.maximum(i, j)[fit])
    i, j = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (left, right))
    use = _near(i, j, code, p, q, similarity)
    return i[use], j[use], np.cumsum(more)[:-1] > 0, dense


def _counts(a: np.ndarray, b: np.ndarray, n: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, with the sum of ``n``."""
    order = np.lexsort((b, a))
    a, b, n, need = a[order], b[order], n[order], need[order]
    start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return a[start], b[start], np.add.reduceat(n.astype(np.int64), start) if len(a) else n.astype(np.int64), need[start]


def _compared(scattered: DataFrame, parts: int, similarity: float, near: int) -> DataFrame:
    """Rows of ``FOUND``: the first and the later occurrences of all lines, blobs of pairs, and dense keys."""

    def of_part(lines: list[bytes], keys: list[tuple[int, bytes]], met: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        own = _gathered(lines, _LINE)
        lines.clear()
        first, later = _local(own)
        yield _rows(LATER, len(later), y=own[2][later], n=own[3][later])
        docs = pa.array(own[1][first], mask=own[4][first] > 0)
        yield _rows(FIRST, len(first), x=own[0][first], y=own[2][first], z=docs, n=own[3][first])
        del own
        step, ids, packed = _gathered([data for _, data in keys], _KEY)
        if len(ids) == 0:
            return
        size = np.array([len(data) for _, data in keys]) // sum(np.dtype(k).itemsize for k in _KEY)
        key = np.cumsum(step, dtype=U64)
        start = np.cumsum(size) - size
        key += np.repeat(np.array([top for top, _ in keys], np.int64).view(U64) - key[start], size)
        keys.clear()
        del step
        order = _together(key, ids, packed & 0x7FFF)
        key, ids, packed = key[order], ids[order], packed[order]
        del order
        for own in _slices(key, SLICE):
            yield from of_keys(key[own], ids[own], packed[own].astype(np.int64), met)

    def of_keys(key: np.ndarray, ids: np.ndarray, packed: np.ndarray, met: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        code, many, p, q = packed & 0x7FFF, ((packed >> 15) & 1).astype(np.uint16), (packed >> 16) & 255, packed >> 24
        i, j, more, dense = _met(key, ids, code, p, q, many, similarity, near)
        a, b, n, need = _counts(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.ones(len(i), np.int64), 1 + (many[i] & many[j]))
        met.append((a, b, n.astype(np.int32), need.astype(np.uint8)))
        n = np.flatnonzero(more)
        packed = code[n] | (p[n] << 16) | (q[n] << 24) | (dense[n].astype(np.int64) << 32)
        yield _rows(DENSE, len(n), x=key[n], y=ids[n], z=packed, n=many[n])
        if sum(len(m[0]) for m in met) > HELD:
            yield from dealt(met)

    def dealt(met: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        a, b, n, need = _counts(*(np.concatenate(c) for c in zip(*met, strict=True)))
        met.clear()
        yield from _dealt(BLOB, tk.mix(a + tk.mix(b)), parts, [a, b, np.minimum(n, 255).astype(np.uint8), need.astype(np.uint8)])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has several parts, whose keys differ, so that one is sorted at a time
        lines: dict[int, list[bytes]] = {}
        keys: dict[int, list[tuple[int, bytes]]] = {}  # with the first key of each
        for b in batches:
            blob = b.filter(tk.pc.equal(b.column(0), BLOB))
            rest = b.filter(tk.pc.equal(b.column(0), LATER))
            if rest.num_rows:
                yield rest
            for part, top, what, data in zip(*(blob.column(c).to_pylist() for c in (1, 3, 6, 2)), strict=True):
                if what == FIRST:
                    lines.setdefault(part, []).append(data)
                else:
                    keys.setdefault(part, []).append((top, data))
        met: list[tuple[np.ndarray, ...]] = []
        for part in sorted(lines.keys() | keys.keys()):
            yield from of_part(lines.pop(part, []), keys.pop(part, []), met)
        if met:
            yield from dealt(met)

    return scattered.repartition("part").mapInArrow(cluster.releasing(made), FOUND)


PAIRED = "a bigint, b bigint, n int, need int"


def _paired(a: np.ndarray, b: np.ndarray, n: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (a.view(np.int64), b.view(np.int64), n.astype(np.int32), need.astype(np.int32))], ["a", "b", "n", "need"])


def _counted(found: DataFrame) -> DataFrame:
    """The pairs of all blobs, each once, with the number of keys that they share."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [data for b in batches for data in b.column(1).to_pylist()]
        yield _paired(*_counts(*_gathered(blobs, _PAIR)))

    return found.where(F.col("kind") == BLOB).select("part", "blob").repartition("part").mapInArrow(cluster.releasing(made), PAIRED)


def _once(i: np.ndarray, j: np.ndarray, group: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the pairs of each key for each two groups."""
    low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
    order = np.lexsort((j, i, high, low, group[i]))
    new = np.ones(len(order), np.bool_)
    for v in (group[i], low, high):
        new[1:] &= v[order[1:]] == v[order[:-1]]
    new[1:] = ~new[1:]
    return i[order[new]], j[order[new]]


def _across_keys(t: pa.Table, similarity: float, few: bool) -> pa.RecordBatch:
    """The pairs that :func:`_across` finds by the keys of ``t``; so many at a time are looked at that memory doesn't grow with a key's lines."""
    window = int(np.ceil(-np.log(similarity) * LOG)) + 1
    key, ids, packed, many, root = (np.asarray(t.column(c).to_numpy()) for c in ("x", "y", "z", "n", "root"))
    ids = ids.view(U64)
    order = np.lexsort((ids, packed & 0xFFFF, key))
    key, ids, packed, many, root = key[order], ids[order], packed[order], many[order], root[order]
    sketch = np.concatenate([edits.sketch_rows(c) for c in t.column("sketch").chunks])[order]
    code, p, q, flag = packed & 0xFFFF, (packed >> 16) & 255, (packed >> 24) & 255, packed >> 32
    _, group = _group(key)
    # of each key the lines outside its commonest group meet all in reach of their sizes
    by = np.lexsort((root, group))
    new = np.ones(len(by), np.bool_)
    new[1:] = (group[by[1:]] != group[by[:-1]]) | (root[by[1:]] != root[by[:-1]])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(by)))
    best = np.zeros(int(group[-1]) + 1, np.int64)
    rank = np.lexsort((count, group[by[start]]))
    best[group[by[start]][rank]] = root[by[start]][rank]
    other = np.flatnonzero(root != best[group])
    sized = group * (1 << 16) + code
    low = np.searchsorted(sized, group * (1 << 16) + np.maximum(code - window, 0))[other]
    high = np.searchsorted(sized, sized[other] + window, "right")
    outside = root != best[group]
    at = np.concatenate(([0], np.cumsum(high - low)))  # all the pairs of ``other`` in one row
    found = [np.zeros(0, np.int64)]
    for first in range(0, int(at[-1]), LOOKED):
        n = np.arange(first, min(first + LOOKED, int(at[-1])))
        of = np.searchsorted(at, n, "right") - 1
        i, j = other[of], n - at[of] + low[of]
        # a pair of lines that are both outside is looked at once
        use = (group[i] == group[j]) & (root[i] != root[j]) & ((j < i) | ~outside[j])
        i, j = np.minimum(i, j)[use], np.maximum(i, j)[use]
        use = flag[j] > 0
        i, j = i[use], j[use]
        use = _near(i, j, code, p, q, similarity)
        i, j = i[use], j[use]
        use = ~edits.far(sketch, i, j, similarity)
        i, j = i[use], j[use]
        if few:
            i, j = _once(i, j, group, root)
        found.append(i * len(key) + j)
    pair = np.sort(np.concatenate(found))
    i, j = pair // len(key), pair % len(key)
    if few:
        i, j = _once(i, j, group, root)
    return _paired(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.ones(len(i)), 1 + (many[i] & many[j]))


def _across(dense: DataFrame, similarity: float, few: bool) -> DataFrame:
    """The pairs of different groups that meet by a dense key of ``dense(x, y, z, n, sketch, root)``, but those that are far.

    ``few``: of every key one pair for each two groups that meet.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows == 0:
                continue
            keys = b.column(0).to_numpy()
            last = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])  # where the last key begins
            if held and (last or held[-1].column(0)[-1].as_py() != keys[0]):
                yield _across_keys(pa.Table.from_batches([*held, b.slice(0, last)]), similarity, few)
                held, b = [], b.slice(last)
            held.append(b)
        if held:
            yield _across_keys(pa.Table.from_batches(held), similarity, few)

    mixed = dense.groupBy("x").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("x")
    return dense.join(mixed, "x").select("x", "y", "z", "n", "sketch", "root").repartition("x").sortWithinPartitions("x").mapInArrow(cluster.releasing(made), PAIRED)


def _fetched(docs: DataFrame, spots: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(h, norm, sketch)``: the normalised lines at ``spots(h, rid, part)``, and few others; and the tables that it reads.

    Bit tables of the places and of the hashes tell what to fetch, so that no text goes through a shuffle.
    """
    context = docs.sparkSession.sparkContext
    table = context.broadcast(cluster.position_filter(spots))
    lines = context.broadcast(cluster.position_filter(spots.select(F.col("h").alias("rid"), F.lit(0).alias("part"))))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy()
            for first, piece in tk.chunks(b.column(1)):
                piece = tk.pc.utf8_lower(piece)
                data, row_at = tk.buffers(piece)
                starts, row_first = line_starts(data, row_at)
                rows = np.repeat(np.arange(len(piece)), np.diff(row_first))
                number = np.arange(len(rows)) - row_first[rows]
                line_rid = rid[first + rows]
                hit = np.flatnonzero(cluster.in_filter(table.value, line_rid, number))
                flat = np.where(tk.word_mask(data), data, np.uint8(32)).tobytes()
                ends = starts[hit + 1].tolist()
                texts = pa.array([b" ".join(flat[x:y].split()).decode() for x, y in zip(starts[hit].tolist(), ends, strict=True)], pa.string())
                w = tk.words(texts, lower=False)
                h = sequence_hashes(w.hashes, w.at).view(np.int64)
                mine = pa.array(np.flatnonzero(cluster.in_filter(lines.value, h, np.zeros(len(h), np.int64))))
                texts = texts.take(mine)
                yield pa.RecordBatch.from_arrays([pa.array(h).take(mine), texts, edits.sketches(texts)], ["h", "norm", "sketch"])

    some, _ = cluster.split(cluster.row_id(docs.select("doc_id", "text")), "_rid", spots.select("rid").distinct())
    rows = cluster.written(some.select("_rid", "text").mapInArrow(cluster.releasing(made), "h bigint, norm string, sketch binary"))
    # lines of repeated rows, and later occurrences that pass by chance, are there more than once
    twice = cluster.written(rows.groupBy("h").count().where("count > 1").select(F.col("h").alias("rid")))
    again, once = cluster.split(rows, "h", twice)
    again = cluster.written(again.groupBy("h").agg(F.first("norm").alias("norm"), F.first("sketch").alias("sketch")))
    return once.union(again), [rows, twice, again]


def _plausible(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The ``(a, b, n, need)`` of pairs whose lines aren't told to be far apart by their sketches."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.concatenate([edits.sketch_rows(b.column(c)) for c in (4, 5)])
            i = np.arange(b.num_rows)
            yield b.select(["a", "b", "n", "need"]).filter(pa.array(~edits.far(rows, i, i + b.num_rows, similarity)))

    for c in "ab":
        pairs = pairs.join(texts.select(F.col("h").alias(c), F.col("sketch").alias(f"s{c}")), c)
    return pairs.select("a", "b", "n", "need", "sa", "sb").mapInArrow(cluster.releasing(made), PAIRED)


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The ``(a, b)`` of the written ``pairs`` whose lines are similar."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = tk.strings(b.column(2)), tk.strings(b.column(3))
            most = edits.limits(*(tk.pc.utf8_length(t).to_numpy() for t in (left, right)), similarity)
            maybe = np.flatnonzero(edits.alike(left, right, most))
            true = edits.within(left.take(pa.array(maybe)), right.take(pa.array(maybe)), most[maybe])
            yield b.select(["a", "b"]).take(pa.array(maybe[true]))

    texts, _ = cluster.split(texts.select("h", "norm"), "h", pairs.select(F.col("a").alias("rid")).union(pairs.select("b")))
    for c in "ab":
        pairs = pairs.join(texts.select(F.col("h").alias(c), F.col("norm").alias(f"t{c}")).hint("shuffle_hash"), c)
    return pairs.select("a", "b", "ta", "tb").mapInArrow(cluster.releasing(made), "a bigint, b bigint")


def _groups(docs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """``(node, root)`` of the lines that are grouped with others."""
    counted = cluster.written(_counted(found))
    enough = counted.where("n >= need")
    dense = found.where(F.col("kind") == DENSE).select("x", "y", "z", "n")
    ids = enough.select(F.col("a").alias("h")).union(enough.select(F.col("b").alias("h"))).union(dense.select(F.col("y").alias("h"))).distinct()
    ids = cluster.written(ids)
    first, _ = cluster.split(found.where(F.col("kind") == FIRST), "x", ids.select(F.col("h").alias("rid")))
    spots = first.select(F.col("x").alias("h"), F.col("y").alias("rid"), F.col("n").alias("part"))
    spots = cluster.written(spots.join(ids, "h", "left_semi"))
    texts, fetched = _fetched(docs, spots)
    some = not dense.isEmpty()
    met = cluster.written(_plausible(counted if some else enough, texts, similarity))
    enough = met.where("n >= need")
    dense = cluster.written(dense.join(texts.select(F.col("h").alias("y"), "sketch"), "y").select("x", "y", "z", "n", "sketch"))
    # of each line first the pair that shares most keys
    best = cluster.written(enough.groupBy("b").agg(F.min_by("a", F.struct(-F.col("n"), "a")).alias("a")).select("a", "b"))
    edges = cluster.written(_similar(best, texts, similarity))
    groups = cluster.written(cluster.connected(edges))
    cluster.discard(edges)
    tried, made = best, []
    # then one pair for each two groups, and at last all pairs that aren't in one group yet, again one for each two at first
    for few in (True, False):
        rest = enough
        if some:
            rest = met.union(_across(_rooted(dense, groups, "y", "root"), similarity, few))
            rest = rest.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("need").alias("need")).where("n >= need")
        rest = _rooted(_rooted(rest.select("a", "b", "n"), groups, "a", "ra"), groups, "b", "rb").where("ra <> rb")
        if few:
            rest = _one_each(rest)
        else:
            rest = rest.join(tried, ["a", "b"], "left_anti")
        rest = cluster.written(rest.select("a", "b", "n", "ra", "rb"))
        tried = tried.union(rest.select("a", "b"))
        made += [rest]
        if not few:
            own = cluster.written(_one_each(rest))
            groups, joined = _joined(groups, own, texts, similarity)
            rest = rest.join(own, ["a", "b"], "left_anti").select("a", "b", "n", "ra", "rb")
            for c in ("ra", "rb"):
                rest = _rooted(rest, joined, c, "root").drop(c).withColumnRenamed("root", c)
            rest = cluster.written(rest.where("ra <> rb").select("a", "b", "n", "ra", "rb"))
            made += [own, joined, rest]
        groups, joined = _joined(groups, rest, texts, similarity)
        made += [joined]
    cluster.discard(counted, ids, spots, met, dense, best, *fetched, *made)
    return groups


def _one_each(pairs: DataFrame) -> DataFrame:
    """Of ``(a, b, n, ra, rb)`` the pair of most shared keys for each two groups."""
    pairs = pairs.groupBy(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"))
    return pairs.agg(F.min_by(F.struct("a", "b", "n"), F.struct(-F.col("n"), "a", "b")).alias("p")).select("p.a", "p.b", "p.n", "ra", "rb")


def _joined(groups: DataFrame, pairs: DataFrame, texts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The groups that result where pairs ``(a, b, ra, rb)`` are similar, in place of ``groups``; and ``(node, root)`` of those that were joined."""
    true = _similar(pairs.select("a", "b"), texts, similarity)
    links = cluster.written(true.join(pairs, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    joined = cluster.written(cluster.connected(links))
    merged = groups.join(joined.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
    merged = merged.select("node", F.coalesce("new", "root").alias("root")).union(joined.select("node", "root"))
    after = cluster.written(merged.groupBy("node").agg(F.min("root").alias("root")))
    cluster.discard(groups, links)
    return after, joined


def _rooted(rows: DataFrame, groups: DataFrame, name: str, root: str) -> DataFrame:
    """``rows`` with the group of a line as a column; a line in none is its own."""
    return rows.join(groups.select(F.col("node").alias(name), F.col("root").alias(root)), name, "left").withColumn(root, F.coalesce(root, name))


def _marks(rid: np.ndarray, line: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the places of lines, other ones on each level."""
    return tk.mix(rid.view(U64) ^ tk.mix(line.astype(U64) + U64(level << 32))).view(np.int64)


def _in_table(table: np.ndarray, rid: np.ndarray, line: np.ndarray, level: int) -> np.ndarray:
    return cluster.in_filter(table, _marks(rid, line, level), np.zeros(len(rid), np.int64))


def _going(told: list, rid: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Whether the lines with words at these places go, as :func:`_told` tells."""
    *tables, (open_rid, open_line) = told
    out, at = np.zeros(len(rid), np.bool_), np.arange(len(rid))
    for level, table in enumerate(tables):
        at = at[_in_table(table, rid[at], line[at], level)]
        out[at] = level % 2 == 0
    if len(at) and len(open_rid):
        lost = set(zip(open_rid.tolist(), open_line.tolist(), strict=True))
        out[at] = [place in lost for place in zip(rid[at].tolist(), line[at].tolist(), strict=True)]
    return out


def _told(lost: DataFrame, first: DataFrame, most: int = OPEN) -> list:
    """Broadcast bit tables that tell the places ``lost(rid, line, first)`` from all others; and the ``most`` places that they leave open, or fewer.

    ``first(rid, line)``: the places of first occurrences; that of a lost one has ``first`` in ``lost``.  The first table holds the lost places, the
    second the others that pass it by chance, the third the lost ones that pass the second, and so on, two at a time; the last item holds the lost ones that pass all.
    """
    context = lost.sparkSession.sparkContext
    told, sets = [], [lost, first]
    while len(told) == 0 or sets[0].count() > most:
        for own, other in ((0, 1), (1, 0)):
            level = len(told)

            def marked(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    mark = _marks(b.column(0).to_numpy(), b.column(1).to_numpy(), level)
                    yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(np.zeros(len(mark), np.int32))], ["rid", "part"])

            bits = cluster.table_bits(sets[own].count(), TOLD_BITS)
            table = context.broadcast(cluster.position_filter(sets[own].select("rid", "line").mapInArrow(marked, "rid bigint, part int"), bits))

            def passing(batches: Iterator[pa.RecordBatch], level: int = level, table=table) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                for b in batches:
                    yield b.filter(pa.array(_in_table(table.value, b.column(0).to_numpy(), b.column(1).to_numpy(), level)))

            rest = sets[other].select("rid", "line").mapInArrow(passing, "rid bigint, line int")
            if level == 0:
                rest = rest.join(lost.where("first").select("rid", "line"), ["rid", "line"], "left_anti")
            sets[other] = cluster.written(rest)
            told.append(table)
    left = sets[0].toArrow()
    cluster.discard(*sets)
    return [*told, context.broadcast((left.column("rid").to_numpy(), left.column("line").to_numpy()))]


def _lost(docs: DataFrame, similarity: float, near: int = NEAR) -> list:
    """What :func:`_told` says of the lines that go."""
    parts = max(16, 8 * cluster.partitions(docs))
    found = cluster.written(_compared(_scattered(docs, parts), parts, similarity, near))
    groups = _groups(docs, found, similarity)
    every = found.where(F.col("kind") == FIRST)
    first, _ = cluster.split(every, "x", groups.select(F.col("node").alias("rid")))
    first = first.select("x", F.struct(F.isnull("z").alias("none"), F.col("z").alias("doc"), F.col("y").alias("rid"), F.col("n").alias("line")).alias("p"))
    placed = cluster.written(first.join(groups, first.x == groups.node).select("root", "p"))
    kept = placed.groupBy("root").agg(F.min("p").alias("kept"))
    lost = placed.join(kept, "root").where("p <> kept").select("p.rid", "p.line", F.lit(True).alias("first"))
    lost = cluster.written(lost.union(found.where(F.col("kind") == LATER).select(F.col("y").alias("rid"), F.col("n").alias("line"), F.lit(False).alias("first"))))
    told = _told(lost, every.select(F.col("y").alias("rid"), F.col("n").alias("line")))
    cluster.discard(found, groups, placed, lost)
    return told


def _cleaned(column: pa.Array, going: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, int, bool, str]]:
    """Row, lines, removed lines, whether it goes altogether, and what remains of the rows that lose lines.

    ``going(rows, lines)`` tells of lines by their numbers which ones go; those without words stay.
    """
    for first, piece in tk.chunks(column):
        _, row_first = line_starts(*tk.buffers(piece))
        rows = np.repeat(np.arange(len(piece)), np.diff(row_first))
        lost = going(first + rows, np.arange(len(rows)) - row_first[rows])
        hit = tk.row_sums(lost, row_first) > 0
        if not hit.any():
            continue
        lost, hit = lost[hit[rows]], np.flatnonzero(hit)
        data, row_at = tk.buffers(piece.take(pa.array(hit)))
        starts, row_first = line_starts(data, row_at)
        full = np.diff(np.searchsorted(tk.runs(tk.word_mask(data), starts)[0], starts)) > 0
        stay = ~(lost & full)
        gone = tk.row_sums(~stay, row_first)
        left = tk.row_sums(full & stay, row_first)
        raw = data.tobytes()
        for r in np.flatnonzero(gone).tolist():
            lines = row_first[r] + np.flatnonzero(stay[row_first[r] : row_first[r + 1]])
            ends = starts[lines + 1] - (lines + 1 < row_first[r + 1])  # without the line feed
            text = b"\n".join([raw[x:y] for x, y in zip(starts[lines].tolist(), ends.tolist(), strict=True)]).decode()
            yield first + int(hit[r]), int(row_first[r + 1] - row_first[r]), int(gone[r]), bool(left[r] == 0), text


def _without(docs: DataFrame, similarity: float, made: Callable[[pa.RecordBatch, list[tuple]], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """``made(batch, found)`` of the rows of ``docs``, with what :func:`_cleaned` finds in each batch; no text goes through a shuffle."""
    names, at = docs.columns, docs.columns.index("text")
    lost = _lost(docs, similarity)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [t.value for t in lost]
        for b in batches:
            rid = b.column(len(names)).to_numpy()
            yield made(b, list(_cleaned(b.column(at), lambda rows, lines, rid=rid: _going(told, rid[rows], lines))))

    rid = cluster.free(docs, "_rid")
    return cluster.row_id(docs, rid).select(*names, rid).mapInArrow(cluster.releasing(every), schema)


REPORT = "doc_id bigint, n_lines bigint, removed_lines bigint, dropped boolean, clean_text string"


def report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document that loses lines: counts, whether no line with words is left, what remains.

    Null and empty texts and lines without words lose nothing.  Repeats of a row, with the same id
    and text, keep the same lines.  Ties go to the least (doc_id, hash of the row, line number), null
    ids last.  Other columns aren't read.
    """

    def made(b: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        rows, *rest = list(zip(*found, strict=True)) if found else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        ids = b.column(0).cast(pa.int64()).take(pa.array(rows, pa.int64()))
        columns = [ids, *(pa.array(v, k) for v, k in zip(rest, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "removed_lines", "dropped", "clean_text"])

    return _without(docs.select("doc_id", "text"), similarity, made, REPORT)


def clean(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without repeated lines; documents go that keep no line with words of those they had.

    Other columns stay as they are, whatever their names.
    """
    names, at = docs.columns, docs.columns.index("text")

    def made(b: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        mask, gone = np.zeros(b.num_rows, np.bool_), np.zeros(b.num_rows, np.bool_)
        mask[[f[0] for f in found]] = True
        gone[[f[0] for f in found if f[3]]] = True
        text = tk.pc.replace_with_mask(b.column(at), pa.array(mask), pa.array([f[4] for f in found], b.column(at).type))
        columns = [text if i == at else b.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(~gone))

    return _without(docs, similarity, made, docs.schema)
