"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolcraft.llm import mixing, tokens
from poolcraft.session import load


def _sized(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents", "doc_id", "source", "text")
    return documents.select(mixing.clean_source(F.col("source")).alias("source"), "doc_id", tokens.token_counts(spark, F.col("text")).cast("bigint").alias("tokens"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Per source: the documents' tokens, the uses, and target and actual share."""
    return mixing.report(*mixing.mixture(_sized(spark, d), load(spark, d, "mix_targets")))


def p8_uses(spark: SparkSession, d: str) -> DataFrame:
    """Per document of the mixture: how often it is used."""
    mixed, _ = mixing.mixture(_sized(spark, d), load(spark, d, "mix_targets"))
    return mixed.groupBy("source", "doc_id").agg(F.countDistinct("use").alias("uses"), F.sum(F.col("to_token") - F.col("from_token")).alias("tokens_used"))


QUERIES = {"p8_mix": p8_mix, "p8_uses": p8_uses}
SQL: dict[str, str] = {}
