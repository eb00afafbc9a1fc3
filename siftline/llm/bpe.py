"""Byte-level BPE as a monoid: encode halves, join neighbours at a re-encoded boundary window.

An encoded text is an element of a monoid whose product joins two neighbouring pieces.  Pieces of a
text are cut anywhere; leaves are encoded by the library.  To join two, a window of tokens around
the boundary is decoded and encoded again.  It grows, doubling, on each side until it begins and
ends at a *stable* place: a visible ASCII character followed by ASCII white space.  No pre-token of
the pattern holds white space behind another character, and none depends on what precedes it, so
every such place is a boundary of pre-tokens in any surroundings, and tokens outside the window
are those of the whole text.  A text without such places grows its window to the whole.

Decoding concatenates the tokens' bytes up the tree.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from siftline.llm import cluster
from siftline.llm import textkit as tk

#: The file of ranks: a base64 token and its number on each line.  It is read by the driver alone.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are split into pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are encoded as one leaf.
LEAF = 16_384
#: Tokens on each side of a boundary that the first window holds.
WINDOW = 8

_SPACE = frozenset(b" \t\n\r\x0b\x0c")


class Codec:
    """A vocabulary's leaf encoder, with the join and the tree over it."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pieces: list[bytes] = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.pieces[rank] = token

    def leaf(self, text: str) -> list[int]:
        return self.library.encode_ordinary(text)

    def bytes_of(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, tokens))

    def _stable_before(self, tokens: list[int], most: int) -> int | None:
        """The last of ``tokens[-most:]`` that begins at a stable place: all before it stay."""
        for i in range(len(tokens) - 1, max(len(tokens) - most, 1) - 1, -1):
            if self.pieces[tokens[i]][0] in _SPACE and 0x20 < self.pieces[tokens[i - 1]][-1] < 0x7F:
                return i
        return None

    def _stable_after(self, tokens: list[int], most: int) -> int | None:
        """The first of ``tokens[:most]`` that begins at a stable place: it and all after it stay."""
        for i in range(1, min(len(tokens), most)):
            if self.pieces[tokens[i]][0] in _SPACE and 0x20 < self.pieces[tokens[i - 1]][-1] < 0x7F:
                return i
        return None

    def join(self, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
        """The tokens of the two texts' concatenation."""
        if not left or not right:
            return left or right
        size = window
        while (a := self._stable_before(left, size)) is None and size < len(left):
            size *= 2
        size = window
        while (b := self._stable_after(right, size)) is None and size < len(right):
            size *= 2
        a, b = a or 0, len(right) if b is None else b
        middle = (self.bytes_of(left[a:]) + self.bytes_of(right[:b])).decode()
        return left[:a] + self.leaf(middle) + right[b:]

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """The tokens of ``text``, by halves down to ``leaf`` characters.

        Cuts keep to characters, so that leaves are texts; any place between two will do.
        """
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.encode(text[:half], leaf), self.encode(text[half:], leaf))

    def decode(self, tokens: list[int]) -> bytes:
        """The bytes of the tokens, by halves."""
        if len(tokens) <= LEAF:
            return self.bytes_of(tokens)
        half = len(tokens) // 2
        return self.decode(tokens[:half]) + self.decode(tokens[half:])


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str = PATTERN) -> Codec:
    return Codec(ranks, pattern)


def _shared(spark: SparkSession, vocabulary: str, pattern: str) -> Callable[[], Codec]:
    """The codec as the workers get it: the file's bytes are broadcast, at their fixed size."""
    ranks = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    return lambda: codec(ranks.value, pattern)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, tokens: str = "tokens") -> DataFrame:
    """``docs`` and the ``tokens`` of their whole texts, of type array<int>.

    A null text has null tokens, an empty one none; repeated rows are encoded alike.  Where ``docs``
    has a column of that name, underscores go before the new one's.
    """
    while tokens.lower() in {c.lower() for c in docs.columns}:
        tokens = f"_{tokens}"
    get, at = _shared(docs.sparkSession, vocabulary, pattern), docs.columns.index("text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for b in batches:
            found = [None if t is None else own.encode(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], [*b.schema.names, tokens])

    return docs.mapInArrow(cluster.releasing(made), StructType([*docs.schema.fields, StructField(tokens, ArrayType(IntegerType()))]))


def decode(docs: DataFrame, tokens: str = "tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN, text: str = "decoded") -> DataFrame:
    """``docs`` and the ``text`` of their tokens; null tokens have a null text, no tokens an empty one.

    Bytes that aren't UTF-8, as a part of a text's tokens may give, become replacement characters.
    """
    while text.lower() in {c.lower() for c in docs.columns}:
        text = f"_{text}"
    get, at = _shared(docs.sparkSession, vocabulary, pattern), docs.columns.index(tokens)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for b in batches:
            found = [None if t is None else own.decode(t).decode(errors="replace") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, text])

    return docs.mapInArrow(cluster.releasing(made), StructType([*docs.schema.fields, StructField(text, StringType())]))


REPORT = "doc_id bigint, n_bytes bigint, n_tokens bigint, tokens array<int>, exact boolean"


def report(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Each document's tokens, and whether decoding them gives the text's bytes again.

    A null text has null tokens and counts; only ``doc_id`` and ``text`` are read.
    """
    get = _shared(docs.sparkSession, vocabulary, pattern)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for b in batches:
            for first, piece in _pieces(b.column(1)):
                texts = piece.to_pylist()
                found = [None if t is None else own.encode(t) for t in texts]
                sizes = [None if t is None else len(t.encode()) for t in texts]
                exact = [None if t is None else own.decode(f) == t.encode() for t, f in zip(texts, found, strict=True)]
                counts = [None if f is None else len(f) for f in found]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(piece)).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), _lists(found), pa.array(exact, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "tokens", "exact"])

    return docs.select("doc_id", "text").mapInArrow(cluster.releasing(made), REPORT)


def _lists(found: list[list[int] | None]) -> pa.Array:
    """An Arrow list array by way of one flat numpy array."""
    at = np.concatenate(([0], np.cumsum([0 if f is None else len(f) for f in found]))).astype(np.int32)
    flat = np.fromiter((t for f in found if f for t in f), np.int32, int(at[-1]))
    mask = pa.array([f is None for f in found], pa.bool_()) if any(f is None for f in found) else None
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat), mask=mask)


def _pieces(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of the column with its nulls, of bounded bytes."""
    first = 0
    for first, piece in tk.chunks(column):
        yield first, column.slice(first, len(piece))
