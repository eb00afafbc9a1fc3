"""The search database: build, save, load, parse, query, look up."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import analysis, highlight
from siftline.plans import language
from siftline.plans.search import search
from siftline.plans.tree import Phrase, QueryNode, Terms
from siftline.sources import index as tables


class DatabaseBuilder:
    """Collects documents and builds a :class:`SearchDatabase` of them."""

    def __init__(self, spark: SparkSession, analyzer: str = "english") -> None:
        if analyzer not in analysis.ANALYZERS:
            raise ValueError(f"no analyzer {analyzer}")
        self.spark, self.analyzer = spark, analyzer
        self._added: list[DataFrame] = []
        self._creator: Callable[[Column], Column] | None = None

    def add_documents(self, docs: DataFrame, id: str = "id", text: str = "text", metadata: list[str] | None = None, data: list[str] | None = None) -> DatabaseBuilder:
        """Add rows; ``metadata`` are the columns that queries may filter by, ``data`` those to look up."""

        def struct(names: list[str] | None) -> Column:
            return F.struct(*[F.col(c) for c in names]) if names else F.struct(F.lit(None).cast("string").alias("_"))

        if any(name.lower() == "doc_id" for name in metadata or []):
            raise ValueError("metadata can't be called doc_id, which is the document's id; rename the column")
        self._added.append(docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), struct(metadata).alias("meta"), struct(data).alias("data")))
        return self

    def sentence_metadata(self, creator: Callable[[Column], Column]) -> DatabaseBuilder:
        """A column of each sentence's text that is kept with the sentence, as ``metadata``."""
        self._creator = creator
        return self

    def build(self, path: str | None = None, on_duplicate: str = "error", mode: str = "errorifexists") -> SearchDatabase:
        """The database: written to ``path`` and indexed, or lazy and scanned where there is none.

        Two documents of one id are an error, or with ``on_duplicate="last"`` the one added last stays,
        of those added by one call the one of the greatest text (``"any"`` skips the check; filters then
        take each document by its own metadata where it is lazy, by that of any of its id where it is written).
        """
        if not self._added:
            raise ValueError("no documents")
        added = [d.withColumn("_n", F.lit(i)) for i, d in enumerate(self._added)]
        docs = reduce(DataFrame.unionByName, added)
        if on_duplicate == "error":
            if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
                raise ValueError("a document id occurs twice")
        elif on_duplicate == "last":
            docs = docs.groupBy("doc_id").agg(F.max_by(F.struct("text", "meta", "data"), F.struct("_n", "text")).alias("d")).select("doc_id", "d.*")
        elif on_duplicate != "any":
            raise ValueError("on_duplicate is error, last or any")

        def sentences(some: DataFrame) -> DataFrame:
            found = tables.sentences(some, self.analyzer)
            return found if self._creator is None else found.withColumn("metadata", self._creator(F.col("text")))

        made = tables.Index(sentences(docs), docs.select("doc_id", "meta.*"), docs.select("doc_id", "data"), self.analyzer)
        named = docs.select("doc_id", F.col("text").alias("_of_text"), "meta.*")
        made.sentences_of = lambda condition: sentences(named.where(condition).select("doc_id", F.col("_of_text").alias("text")))
        return SearchDatabase(tables.write(made, path, mode) if path else made)


class SearchDatabase:
    """An immutable corpus that answers phrase and boolean queries sentence by sentence."""

    def __init__(self, index: tables.Index) -> None:
        self.index = index

    @staticmethod
    def builder(spark: SparkSession, analyzer: str = "english") -> DatabaseBuilder:
        return DatabaseBuilder(spark, analyzer)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SearchDatabase:
        return SearchDatabase(tables.read(spark, path))

    def persist(self, path: str, mode: str = "errorifexists") -> SearchDatabase:
        """Write the database to ``path``, with its index."""
        return SearchDatabase(tables.write(self.index, path, mode))

    def tokenize_phrase(self, text: str) -> list[str]:
        return analysis.phrase(text, self.index.analyzer)

    def term(self, word: str) -> str | None:
        """The term of a word if any sentence holds it."""
        stems = self.tokenize_phrase(word)
        if len(stems) != 1 or self.index.vocabulary is None:
            return stems[0] if len(stems) == 1 and not self.query(Phrase(stems[0]), ids=True).isEmpty() else None
        return None if self.index.vocabulary.where(F.col("stem") == stems[0]).isEmpty() else stems[0]

    def terms(self, text: str) -> Terms:
        """The text's terms, to be made phrase or keywords."""
        return Terms(*self.tokenize_phrase(text))

    def phrase_query(self, text: str) -> QueryNode:
        """The text as one phrase; operators in it are words."""
        return Phrase(*self.tokenize_phrase(text))

    def parse_query(self, query: str, document_filter: Column | str | None = None, strict: bool = False) -> QueryNode | None:
        """The tree of a query string; None if it isn't one, or with ``strict`` an error that says where."""
        try:
            node = language.parse(query, self.tokenize_phrase)
        except language.QuerySyntaxError:
            if strict:
                raise
            return None
        return node if document_filter is None else node.filter_documents(document_filter)

    def query(self, node: QueryNode, plan: str = "auto", optimize: bool = True, parts: bool = False, ordered: bool = False, highlights: bool = True, ids: bool = False) -> DataFrame:
        """Matching sentences with their highlights; ``parts`` adds the split text, ``ordered`` sorts them.

        With ``ids`` there are ``doc_id`` and ``sentence_idx`` alone, and by the index no text is read.
        """
        found = search(self.index, node, plan, optimize, ids)
        if ids:
            pass
        elif not highlights:
            found = found.drop("highlights")
        elif parts:
            found = found.withColumn("parts", highlight.parts("text", "highlights"))
        return found.orderBy("doc_id", "sentence_idx") if ordered else found

    def postings(self, word: str) -> DataFrame:
        """``(doc_id, sentence_idx, positions)`` of one word's term."""
        if self.index.postings is None:
            raise ValueError("nothing is indexed")
        stem = self.tokenize_phrase(word)
        found = self.index.postings.where(F.col("stem").isin(stem) if len(stem) == 1 else F.lit(False))
        return found.select("doc_id", "sentence_idx", "positions")

    def get_doc(self, doc_id: int) -> DataFrame:
        """The payload of one document: no row or one."""
        return self.index.documents.where(F.col("doc_id") == doc_id)

    def with_payload(self, results: DataFrame) -> DataFrame:
        return results.join(self.index.documents, "doc_id")
