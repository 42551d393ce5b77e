"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolcraft.llm import tokens
from poolcraft.session import load


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(load(spark, d, "documents", "doc_id", "text"))


def p7_tokens_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens per language tag as written."""
    counted = load(spark, d, "documents", "lang", "text").select("lang", tokens.token_counts(spark, F.col("text")).alias("n"))
    return counted.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))


QUERIES = {"p7_ids": p7_ids, "p7_tokens_by_lang": p7_tokens_by_lang}
SQL: dict[str, str] = {}
