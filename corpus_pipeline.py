"""A training corpus from raw documents, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import bpe, cluster, decontaminate, line_dedup, quality_gam, setsketch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_gam.keep_good(docs, quality_gam.train(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each fuzzily repeated line stays; documents without lines left go."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return setsketch.clean(docs)


def test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items go, and documents that are mostly such."""
    return decontaminate.clean(docs, decontaminate.matchers(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, and whether these decode to the text."""
    return bpe.report(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", test_passages),
    ("BPE encoding and decoding", tokens),
]

#: SQL can't express the trained and iterative stages; tests compare the stages' rows with the operators' reports.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cluster.written(stage(spark, docs, sf_dir))
    return docs
