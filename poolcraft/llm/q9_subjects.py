"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolcraft.llm import subjects
from poolcraft.session import load


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of_documents(load(spark, d, "documents", "doc_id", "text"), load(spark, d, "subject_areas"), load(spark, d, "subject_labels", "doc_id", "subject"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents per subject."""
    return p9_found(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
SQL: dict[str, str] = {}
