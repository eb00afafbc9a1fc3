"""The tables of an index: sentences, postings, vocabulary, document metadata and payloads.

Sentences come from one Arrow pass over the texts, without a shuffle.  Postings are made where the sentences
are read, in runs that are sorted by (term, document, sentence), so a frequent term spreads over all files and a
term lookup reads the pages whose statistics hold it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import analysis

TABLES = ["sentences", "postings", "vocabulary", "doc_meta", "documents"]
SENTENCES = "doc_id bigint, sentence_idx int, text string, tokens array<struct<start:int,end:int>>, stems array<string>"
POSTINGS = "stem string, doc_id bigint, sentence_idx int, positions array<int>"
#: Words of a sorted run of postings, about.
RUN_WORDS = 1 << 20


@dataclass
class Index:
    """The tables; ``postings`` and ``vocabulary`` are None while nothing is written.

    ``sentences_of``, then, makes the sentences of the documents alone whose metadata meet a condition.
    """

    sentences: DataFrame
    doc_meta: DataFrame
    documents: DataFrame
    analyzer: str
    postings: DataFrame | None = None
    vocabulary: DataFrame | None = None
    sentences_of: Callable[[Column], DataFrame] | None = None


def sentences(docs: DataFrame, analyzer: str = "english") -> DataFrame:
    """The sentences of ``docs(doc_id, text)``: lines with their words' byte ranges and terms.

    A null or empty text has none.
    """
    make = analyzer  # a name, so that workers resolve it

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = analysis.ANALYZERS[make]
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                ids: list[int | None] = []
                numbers, texts, counts, starts, ends, terms = [], [], [0], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for i, line in enumerate(analysis.lines(text)):
                        spans, found = analysis.tokens(line, term)
                        ids.append(doc)
                        numbers.append(i)
                        texts.append(line)
                        counts.append(len(spans))
                        starts += [a for a, _ in spans]
                        ends += [z for _, z in spans]
                        terms += found
                at = pa.array(np.cumsum(counts).astype(np.int32))
                ranges = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.ListArray.from_arrays(at, ranges), pa.ListArray.from_arrays(at, pa.array(terms, pa.string()))], ["doc_id", "sentence_idx", "text", "tokens", "stems"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(made, SENTENCES)


def _sorted_terms(ids: pa.Array, numbers: pa.Array, stems: pa.ListArray) -> pa.RecordBatch:
    """The postings of some sentences, sorted by (term, document, sentence)."""
    n, at = len(ids), stems.offsets.to_numpy().astype(np.int64)
    size, words = np.diff(at), stems.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    rank = np.empty(len(words.dictionary), np.int64)
    rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(rank))
    by_id = np.empty(n, np.int64)
    by_id[np.lexsort((numbers.to_numpy(), pc.fill_null(ids, 0).to_numpy()))] = np.arange(n)
    row = np.repeat(np.arange(n), size)
    code = words.indices.to_numpy()
    key = rank[code] * n + by_id[row]
    order = np.argsort(key, kind="stable")  # so places stay in order
    key = key[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    place = (np.arange(len(row)) - np.repeat(at[:-1] - at[0], size)).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(place[order]))
    first = order[start]
    return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[first])), ids.take(pa.array(row[first])), numbers.take(pa.array(row[first])), places], ["stem", "doc_id", "sentence_idx", "positions"])


def postings(found: DataFrame, words: int = RUN_WORDS) -> DataFrame:
    """``(stem, doc_id, sentence_idx, positions)``: one row for each term of each sentence.

    A sentence has all its words, so nothing is grouped or shuffled; runs of about ``words`` words are sorted.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            if count:
                whole = pa.Table.from_batches(held).combine_chunks()
                run = _sorted_terms(*[c.chunk(0) for c in whole.columns])
                for i in range(0, run.num_rows, 1 << 16):
                    yield run.slice(i, 1 << 16)

        for b in batches:
            at = b.column(2).offsets.to_numpy().astype(np.int64)
            first = 0
            while first < b.num_rows:
                # a sentence at least, however long it is
                last = max(int(np.searchsorted(at, at[first] + words - count, "right")) - 1, first + 1)
                held.append(b.slice(first, last - first))
                count += int(at[last] - at[first])
                first = last
                if count >= words or first < b.num_rows:
                    yield from flushed()
                    held, count = [], 0
        yield from flushed()

    return found.select("doc_id", "sentence_idx", "stems").mapInArrow(made, POSTINGS)


def vocabulary(found: DataFrame) -> DataFrame:
    """``(stem, df)``: the terms and in how many sentences each occurs."""
    return found.groupBy("stem").agg(F.count("*").alias("df"))


def numbered(found: DataFrame, parts: int = 256) -> DataFrame:
    """``(stem, term_id)`` of postings: terms numbered from 1 in the order in which they first occur.

    Terms are numbered within ``parts`` ranges of document ids; how many terms come before each range is
    counted apart.  The ranges depend on the ids alone, so that a task that runs again numbers alike.
    """
    # one number for all three, of 38 digits at most: rows that a minimum of structs would sort are hashed
    place = F.expr(f"CAST(sentence_idx AS BIGINT) * {1 << 31} + element_at(positions, 1)")
    first = F.min(F.expr(f"CAST(doc_id AS DECIMAL(19, 0)) * CAST({1 << 62} AS DECIMAL(19, 0))") + place.cast("decimal(19, 0)")).alias("first")
    bounds = found.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = (bounds.low, bounds.high) if bounds.low is not None else (0, 0)
    part = F.expr(f"CAST((CAST(low_id AS DECIMAL(20, 0)) - {low}) DIV {(high - low) // parts + 1} AS INT)")
    terms = found.groupBy("stem").agg(first, F.min("doc_id").alias("low_id")).withColumn("part", part)
    counts = terms.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # ``parts`` rows
    own = terms.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("first")))
    return own.join(F.broadcast(before), "part").select("stem", (F.col("place") + F.col("before")).cast("int").alias("term_id"))


def write(index: Index, path: str, mode: str = "errorifexists") -> Index:
    """The index as Parquet tables under ``path``, with a manifest; read back."""
    spark = index.sentences.sparkSession
    at = path.rstrip("/")
    index.sentences.write.mode(mode).parquet(f"{at}/sentences")
    stored = spark.read.parquet(f"{at}/sentences")
    postings(stored).write.mode(mode).parquet(f"{at}/postings")
    vocabulary(spark.read.parquet(f"{at}/postings")).write.mode(mode).parquet(f"{at}/vocabulary")
    index.doc_meta.write.mode(mode).parquet(f"{at}/doc_meta")
    index.documents.write.mode(mode).parquet(f"{at}/documents")
    schemas = {t: spark.read.parquet(f"{at}/{t}").schema.jsonValue() for t in TABLES}
    manifest = json.dumps({"version": 1, "analyzer": index.analyzer, "schemas": schemas})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode(mode).text(f"{at}/manifest")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Index:
    """The index under ``path``, lazily; the manifest's schemas save the inference."""
    from pyspark.sql.types import StructType

    at = path.rstrip("/")
    manifest = json.loads(spark.read.text(f"{at}/manifest").first()[0])
    t = {name: spark.read.schema(StructType.fromJson(manifest["schemas"][name])).parquet(f"{at}/{name}") for name in TABLES}
    return Index(t["sentences"], t["doc_meta"], t["documents"], manifest["analyzer"], t["postings"], t["vocabulary"])


def union(parts: list[Index]) -> Index:
    """One index of several with different documents."""

    def all_of(name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])

    if len({p.analyzer for p in parts}) != 1:
        raise ValueError("the indexes differ in their analyzers")
    made = Index(all_of("sentences"), all_of("doc_meta"), all_of("documents"), parts[0].analyzer)
    if all(p.postings is not None for p in parts):
        joined = all_of("vocabulary").groupBy("stem").agg(F.sum("df").alias("df"))
        made = replace(made, postings=all_of("postings"), vocabulary=joined)
    return made
