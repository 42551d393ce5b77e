"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolcraft.llm import personal
from poolcraft.session import load


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return personal.texts_of(load(spark, d, "parsed", "id", "markdown"), load(spark, d, "redacted", "id", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_data(_texts(spark, d), load(spark, d, "candidates", "first_name", "last_name"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with placeholders in place of personal data, and the number of replacements per kind."""
    done = personal.redact(_texts(spark, d), load(spark, d, "candidates", "first_name", "last_name"))
    return done.select("src", "id", "text", F.to_json("kinds").alias("kinds"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
SQL: dict[str, str] = {}
