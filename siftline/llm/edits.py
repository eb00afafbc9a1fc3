"""Edit distance of many pairs at a time: banded bit-parallel columns (Hyyrö, 2003) over numpy.

Bit r of a column j stands for row j - K + r, so that a word of 64 bits goes down the diagonal.  Of k edits those that
leave the diagonals between the first and the last cell must come back, so K is half of what k exceeds these by, and
words hold the k + 1 diagonals on which all cells lie.  What both texts share at their ends isn't looked at.  The distance is
summed along the diagonal of the last cell, on which it never falls; so a pair is given up as soon as its sum exceeds its limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from siftline.llm import textkit as tk

U64 = np.uint64
#: Bytes of the tables of places by character of a batch of pairs.
TABLE_BYTES = 16 << 20
#: Classes of trigrams by which pairs are told to be too far apart, and pairs that are so at a time.
PROFILE_BITS = 9
TOGETHER = 256
#: Pairs for each word of a column and one more, below which each pair is compared by itself, in whole numbers of any length.
FEW = 20
#: Bytes of texts whose trigrams are counted at a time; a longer pair is taken whole.
PIECE_BYTES = 1 << 20
#: Characters by which texts are told to share their ends at a time.
SHARED = 1 << 17
#: Columns between two looks at which pairs are done.
LOOK = 32
#: Classes of characters that a sketch counts: the letters a to z, and others by their numbers.
KINDS = 32
#: Bytes of a sketch: a count of each class, modulo 256, and the number of characters.
SKETCH_BYTES = KINDS + 4
#: Pairs of sketches that are compared at a time.
SKETCHED = 1 << 16


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """The characters of all texts as small numbers, where each text begins, and how many numbers there are."""
    size = np.asarray(tk.pc.utf8_length(texts), np.int64)
    data, _ = tk.buffers(texts)
    points = data if len(data) == size.sum() else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    seen = np.flatnonzero(np.bincount(points)) if len(points) else np.zeros(1, np.int64)
    number = np.zeros(int(seen[-1]) + 1, np.int32)
    number[seen] = np.arange(len(seen))
    return number[points], np.concatenate(([0], np.cumsum(size))), len(seen)


def _inside(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every character of these texts: which of them it is in, its place there, and its index."""
    line = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
    return line, place, np.repeat(start, size) + place


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """How many characters of each pair are the same from ``a`` and ``b`` on, of ``size`` at most, as one goes by ``step``."""
    out, sums, first = np.zeros(len(size), np.int64), np.cumsum(size), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(sums, sums[first] + SHARED, "right")))
        x, y, own = a[first:last], b[first:last], size[first:last]
        start = np.cumsum(own) - own
        place = (np.arange(own.sum()) - np.repeat(start, own)) * step
        other = np.append(np.flatnonzero(data[np.repeat(x, own) + place] != data[np.repeat(y, own) + place]), len(place))
        out[first:last] = np.minimum(other[np.searchsorted(other, start)] - start, own)
        first = last
    return out


def alike(left: pa.Array, right: pa.Array, most: np.ndarray) -> np.ndarray:
    """Whether the trigrams of each pair of texts differ by no more than ``most`` edits can change.

    An edit changes three trigrams on each side.  False is certain, True isn't.
    """
    left, right = tk.strings(left), tk.strings(right)
    at = tk.buffers(left)[1] + tk.buffers(right)[1]
    found, first = [np.zeros(0, np.bool_)], 0
    while first < len(left):
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE_BYTES, "right")) - 1)
        found.append(_alike(left.slice(first, last - first), right.slice(first, last - first), most[first:last]))
        first = last
    return np.concatenate(found)


def _alike(left: pa.Array, right: pa.Array, most: np.ndarray) -> np.ndarray:
    n = len(left)
    data, at, _ = codes(pa.concat_arrays([left, right]))
    if len(data) < 3:
        return np.ones(n, np.bool_)
    wide = data.astype(np.uint32)
    code = wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)
    code = (code >> np.uint32(32 - PROFILE_BITS)).astype(np.int32)
    out = np.zeros(n, np.bool_)
    kinds = 1 << PROFILE_BITS
    for first in range(0, n, TOGETHER):
        last = min(n, first + TOGETHER)
        counts = np.zeros((last - first) * kinds, np.int64)
        for begin, sign in ((0, 1), (n, -1)):
            start, end = at[first + begin : last + begin], np.maximum(at[first + begin + 1 : last + begin + 1] - 2, at[first + begin : last + begin])
            size = end - start
            line = np.repeat(np.arange(len(size)), size)
            here = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + start[line]
            counts += sign * np.bincount(line * kinds + code[here], minlength=len(counts))
        out[first:last] = np.abs(counts.reshape(-1, kinds)).sum(1) <= 6 * most[first:last]
    return out


def sketches(texts: pa.Array) -> pa.Array:
    """A sketch of each text, by which :func:`far` tells pairs that are too far apart."""
    size = np.asarray(tk.pc.utf8_length(texts), np.int64)
    data, _ = tk.buffers(texts)
    points = data if len(data) == size.sum() else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    letter = (points >= 97) & (points < 123)
    kind = np.where(letter, points - 97, 26 + points % (KINDS - 26)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(size)), size) * KINDS + kind, minlength=len(size) * KINDS)
    made = np.concatenate([counts.reshape(-1, KINDS).astype(np.uint8), size.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
    offsets = np.arange(len(size) + 1, dtype=np.int32) * SKETCH_BYTES
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(made.tobytes())])


def sketch_rows(column: pa.Array) -> np.ndarray:
    """The sketches of a column as rows of bytes."""
    return tk.buffers(column)[0].reshape(-1, SKETCH_BYTES)


def limits(left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """The edits that texts of these sizes may be apart."""
    return np.floor(np.maximum(left, right) * (1 - similarity) + 1e-9)


def far(rows: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sketches of each pair of rows differ by more than the allowed edits can change.

    An edit takes a character away, or adds one, or both.  True is certain, False isn't.
    """
    out = np.zeros(len(i), np.bool_)
    for first in range(0, len(i), SKETCHED):
        a, b = rows[i[first : first + SKETCHED]], rows[j[first : first + SKETCHED]]
        m, n = (np.ascontiguousarray(v[:, KINDS:]).view("<u4")[:, 0].astype(np.int64) for v in (a, b))
        apart = a[:, :KINDS] - b[:, :KINDS]
        apart = np.minimum(apart, -apart).sum(1, dtype=np.int64)  # modulo 256, so no more than it is
        out[first : first + SKETCHED] = apart + np.abs(m - n) > 2 * limits(m, n, similarity)
    return out


def within(left: pa.Array, right: pa.Array, most: np.ndarray) -> np.ndarray:
    """Whether each pair of texts is at most ``most`` edits of single characters apart."""
    pairs = len(left)
    data, at, kinds = codes(pa.concat_arrays([tk.strings(left), tk.strings(right)]))
    size = np.diff(at)
    a, b = np.arange(pairs), np.arange(pairs) + pairs
    swap = size[a] < size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)  # a is the longer
    most = np.asarray(most, np.int64)
    out = np.zeros(pairs, np.bool_)
    todo = np.flatnonzero(size[a] - size[b] <= most)
    a, b, most = a[todo], b[todo], most[todo]
    n, m, a, b = size[a], size[b], at[a], at[b]
    head = _same(data, a, b, m, 1)
    tail = _same(data, a + n - 1, b + m - 1, m - head, -1)
    a, b, n, m = a + head, b + head, n - head - tail, m - head - tail
    out[todo[n <= most]] = True  # with an edit for each character
    side = (most - n + m) // 2
    words = (n - m + 2 * side) // 64 + 1
    rest = np.flatnonzero(n > most)
    rest = rest[np.lexsort((m[rest], words[rest]))]
    first = 0
    while first < len(rest):
        # the longest text of a batch is three times as long as its shortest, about
        last = int(np.searchsorted(words[rest], words[rest[first]], "right"))
        last = first + int(np.searchsorted(m[rest[first:last]], m[rest[first]] * 3 + 8, "right"))
        wide = int((m[rest[first:last]] + 64 * words[rest[first]]).max()) // 64 + 2
        last = min(last, first + max(1, TABLE_BYTES // (8 * kinds * wide)))
        part = rest[first:last]
        if len(part) < FEW * (1 + words[part[0]]):
            for i in part.tolist():
                out[todo[i]] = _single(data[a[i] : a[i] + n[i]], data[b[i] : b[i] + m[i]], int(most[i]))
        else:
            out[todo[part]] = _batch(data, kinds, a[part], n[part], b[part], m[part], most[part], side[part], int(words[part[0]]))
        first = last
    return out


def _single(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """The same for two texts, of which ``a`` is the longer, but by less than ``most`` edits."""
    total = len(a) - len(b)
    side = (most - total) // 2
    mask = (1 << (total + 2 * side + 1)) - 1
    table = {}
    for kind in np.unique(b).tolist():
        places = np.packbits(np.concatenate([np.zeros(side, np.bool_), a == kind]), bitorder="little")
        table[kind] = int.from_bytes(places.tobytes(), "little")
    vp, vn = mask ^ ((1 << side) - 1), 0
    last = 1 << (total + side)
    for j, kind in enumerate(b.tolist()):
        e = (table[kind] >> j) & mask
        d0 = ((((e & vp) + vp) ^ vp) | e | vn) & mask
        hp = vn | ((d0 | vp) ^ mask)
        if not d0 & last:
            total += 1
            if total > most:
                return False
        down = d0 >> 1
        vp, vn = (d0 & vp) | ((down | hp) ^ mask), down & hp
    return True


def _batch(data: np.ndarray, kinds: int, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, most: np.ndarray, side: np.ndarray, words: int) -> np.ndarray:
    """The same for texts of ``n`` and ``m`` characters, ascending, from ``a`` and ``b`` on, with ``side`` diagonals before the first cell's in ``words``."""
    end = int(m.max())
    # bit i of a character's row: whether the longer text has it at place i - side
    wide = (end + 64 * words) // 64 + 2
    table = np.zeros(len(a) * kinds * wide, U64)
    line, place, index = _inside(a, n)
    place += side[line]
    np.add.at(table, (line * kinds + data[index]) * wide + (place >> 6), U64(1) << (place & 63).astype(U64))
    line, place, index = _inside(b, m)
    spelt = np.zeros((end, len(b)), np.int32)  # the shorter text's characters, by column
    spelt[place, line] = data[index]
    start = np.arange(len(a)) * (kinds * wide)
    ahead = n - m + side  # the bit of the last cell's diagonal
    spot, shift = ahead // 64, (ahead % 64).astype(U64)
    sums = n - m
    out = np.zeros(len(a), np.bool_)
    live = np.arange(len(a))
    every = ~U64(0)
    vp = [np.where(side < 64 * w + 64, every << np.clip(side - 64 * w, 0, 63).astype(U64), U64(0)) for w in range(words)]
    vn = [np.zeros(len(a), U64) for _ in range(words)]
    done = 0
    for j in range(end):
        ended = int(np.searchsorted(m, j, "right"))
        if ended > done:  # texts that end here are decided
            out[live[done:ended]] = sums[done:ended] <= most[done:ended]
            done = ended
        if j % LOOK == 0:
            # they go, and those over their limit are given up
            stay = np.flatnonzero((m > j) & (sums <= most))
            if len(stay) < len(m):
                live, start, m, most, sums, spot, shift = (v[stay] for v in (live, start, m, most, sums, spot, shift))
                vp, vn = [v[stay] for v in vp], [v[stay] for v in vn]
                done = 0
        if done == len(live):
            return out
        own = start + spelt[j, live] * np.int64(wide) + (j >> 6)
        low, turn = [table[own + w] for w in range(words + 1)], j & 63
        d0, hp, carry = [], [], None
        for w in range(words):
            e, p, v = low[w], vp[w], vn[w]
            if turn:
                e = (e >> U64(turn)) | (low[w + 1] << U64(64 - turn))
            t = e & p
            t += p
            over = t < p if words > 1 else None
            if carry is not None:
                t += carry
                over |= t < carry
            carry = over.astype(U64) if words > 1 else None
            t ^= p
            t |= e
            t |= v
            d0.append(t)
            h = t | p
            np.invert(h, out=h)
            h |= v
            hp.append(h)
        if words == 1:
            sums = sums + (((d0[0] >> shift) & U64(1)) ^ U64(1)).astype(np.int64)
        else:
            own = np.choose(spot, d0) if words <= 32 else np.stack(d0)[spot, np.arange(len(spot))]
            sums = sums + (((own >> shift) & U64(1)) ^ U64(1)).astype(np.int64)
        for w in range(words):
            down = d0[w] >> U64(1)
            if w + 1 < words:
                down |= d0[w + 1] << U64(63)
            p = down | hp[w]
            np.invert(p, out=p)
            p |= d0[w] & vp[w]
            vn[w] = down & hp[w]
            vp[w] = p
    out[live[done:]] = sums[done:] <= most[done:]
    return out
