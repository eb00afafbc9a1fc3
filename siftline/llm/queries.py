"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import bpe, decontaminate, licenses, line_dedup, quality_gam, risk_rules, setsketch, sharding, sparse_suffix, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds passages of test items: what goes and what remains."""
    parts = decontaminate.matchers(_table(spark, sf_dir, "benchmark"))
    return decontaminate.report(_table(spark, sf_dir, "documents"), parts)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every toxic document, with its score."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("toxic").select("doc_id", "toxicity")


def op3_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that no quality rule rejects, with its stratum."""
    judged = risk_rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.where("size(failed) = 0").select("doc_id", "stratum")


def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a group of near duplicates, and which one is kept."""
    return setsketch.report(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that loses fuzzily repeated lines: what goes and what remains."""
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard; documents of one text stay together."""
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, and whether they decode to its text."""
    return bpe.report(_table(spark, sf_dir, "documents"))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the quality classifier keeps, with its score."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_gam.train(docs, _table(spark, sf_dir, "labels"))
    return quality_gam.score(docs, model).where("kept").select("doc_id", "quality_score")


def op9_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage that is repeated in the table, with its spans."""
    return sparse_suffix.report(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document that states a licence, with its family."""
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.train())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_decontaminate, op2_toxicity, op3_risk_rules, op4_setsketch, op5_line_dedup, op6_sharding, op7_bpe, op8_quality_gam, op9_sparse_suffix, op10_licenses]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.SQL}
